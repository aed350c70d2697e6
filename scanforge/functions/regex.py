"""RE2 -> java.util.regex dialect adaptation.

Rule patterns are written for RE2 (leftmost-first, linear time). Spark runs
java.util.regex. The differences that change results on real text:

* ``.`` and ``$``: Java treats CR, U+0085, U+2028/9 as line ends; ``(?d)``
  (UNIX_LINES) leaves only LF, as in RE2.
* ``(?i)``: RE2 folds Unicode case (K KELVIN SIGN ~ k, LONG S ~ s); Java folds
  ASCII only unless ``u`` (UNICODE_CASE) is added.
* ``\\b``: written out with ASCII word-class look-arounds, as RE2 defines it.
* ``\\s``: Java includes vertical tab; RE2 is ``[\\t\\n\\f\\r ]``.
* ``\\w`` under ``(?i)``: RE2 folds the class, Java does not; written as an
  explicit range it folds in both.

Everything else used by the rule tables (classes, alternation, counted
repetition, ``\\xNN``) means the same in both.
"""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
# RE2's \b looks at ASCII word characters and ignores case folding.
_BOUNDARY = f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?-iu:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"


# RE2's POSIX classes and Perl classes are ASCII
_POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
          "graph": "!-~", "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z",
          "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_PERL = {"d": "0-9", "s": r"\t\n\f\r\x20", "w": "0-9A-Za-z_"}


class UnsupportedPattern(ValueError):
    """A construct that RE2 does not have."""


def _flags(text: str) -> str:
    """Inline flags in Java's spelling: folding reaches all of Unicode, U (ungreedy) is not translated."""
    if "U" in text:
        raise UnsupportedPattern("flag U")
    return text.replace("i", "iu")


def _class_item(pattern: str, i: int) -> tuple[str, int]:
    """One item of a class at ``i``: Java text and the place behind it."""
    m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
    if m and m.group(2) in _POSIX:
        inner = _POSIX[m.group(2)]
        return (f"[^{inner}]" if m.group(1) else inner), i + m.end()
    c = pattern[i]
    if c != "\\":
        return ("\\" + c if c in "[&^~" else c), i + 1  # plain in RE2, special in Java
    nxt = pattern[i + 1:i + 2]
    if nxt in _PERL:
        return _PERL[nxt], i + 2
    if nxt.lower() in _PERL and nxt:
        return f"[^{_PERL[nxt.lower()]}]", i + 2
    text, j = _escape(pattern, i)
    return text, j


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """An escape outside the Perl classes."""
    nxt = pattern[i + 1:i + 2]
    if nxt in "pP" and nxt:
        m = re.match(r"\\[pP](?:\{(\^?)(\w+)\}|(\w))", pattern[i:])
        if not m:
            raise UnsupportedPattern(pattern[i:i + 3])
        name, negated = m.group(2) or m.group(3), (nxt == "P") != bool(m.group(1))
        name = name if len(name) <= 2 else f"Is{name}"
        return (r"\P{" if negated else r"\p{") + name + "}", i + m.end()
    m = re.match(r"\\x\{([0-9A-Fa-f]+)\}|\\x[0-9A-Fa-f]{2}|\\([0-7]{1,3})|\\(.)", pattern[i:], re.S)
    if not m:
        raise UnsupportedPattern("trailing backslash")
    if m.group(2):
        if m.group(2)[0] != "0" and len(m.group(2)) < 3:
            raise UnsupportedPattern(f"back-reference {m.group(0)}")
        return rf"\x{{{int(m.group(2), 8):x}}}", i + m.end()
    if m.group(3) and (m.group(3).isalnum() and m.group(3) not in "aftnrvAzQECbB"):
        raise UnsupportedPattern(f"escape {m.group(0)}")
    if m.group(3) == "v":
        return r"\x0B", i + m.end()
    if m.group(3) in ("C",):
        raise UnsupportedPattern(r"\C")
    return m.group(0), i + m.end()


def to_java(pattern: str) -> str:
    """Translate an RE2 pattern to an equivalent java.util.regex pattern; raises for what RE2 does not have."""
    out, i, n = [], 0, len(pattern)
    lead = re.match(r"\(\?([imsU]+)\)", pattern)
    flags = "d"
    if lead:
        flags += _flags(lead.group(1))
        i = lead.end()
    while i < n:
        c = pattern[i]
        if pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i + 2)
            end = n if end < 0 else end
            out.append("".join("\\" + x if not x.isalnum() and not x.isspace() and x.isascii() else x for x in pattern[i + 2:end]))
            i = min(n, end + 2)
        elif c == "\\":
            nxt = pattern[i + 1:i + 2]
            if nxt == "b":
                out.append(_BOUNDARY)
            elif nxt == "B":
                out.append(_NO_BOUNDARY)
            elif nxt in _PERL and nxt:
                out.append(f"[{_PERL[nxt]}]")
            elif nxt and nxt.lower() in _PERL:
                out.append(f"[^{_PERL[nxt.lower()]}]")
            else:
                text, i = _escape(pattern, i)
                out.append(text)
                continue
            i += 2
        elif c == "[":
            j = i + 1
            out.append("[")
            if pattern[j:j + 1] == "^":
                out.append("^")
                j += 1
            first = True
            while True:
                if j >= n:
                    raise UnsupportedPattern("missing ]")
                if pattern[j] == "]" and not first:
                    break
                if pattern[j] == "]":
                    text, j = r"\]", j + 1
                else:
                    text, j = _class_item(pattern, j)
                out.append(text)
                first = False
            out.append("]")
            i = j + 1
        elif c == "(" and pattern[i + 1:i + 2] == "?":
            m = re.match(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*)(?:-([imsU]+))?([:)]))", pattern[i:])
            if not m:
                raise UnsupportedPattern(pattern[i:i + 4])
            if m.group(1):
                out.append("(")  # names are not used; Java allows fewer of them
            else:
                off = "-" + _flags(m.group(3)) if m.group(3) else ""
                out.append(f"(?{_flags(m.group(2))}{off}{m.group(4)}")
            i += m.end()
        elif c in "*+?}" and pattern[i + 1:i + 2] == "+":
            raise UnsupportedPattern(f"possessive {pattern[i:i + 2]}")
        else:
            out.append(c)
            i += 1
    return f"(?{flags})" + "".join(out)


def literal_first(java: str) -> str:
    """A translation (``to_java``) that begins with a word boundary and a word, with the boundary asked for behind the word.

    It matches the same, but the JVM looks for the word (from four letters on it skips through the line) instead of
    asking for a boundary at every place, and compiles it sooner."""
    head = "(?d)" + _BOUNDARY
    m = re.match(f"({_WORD}+)([*+?{{]?)", java[len(head):]) if java.startswith(head) else None
    word = m.group(1)[:-1] if m and m.group(2) else m.group(1) if m else ""  # a repeat is of the last letter only
    if len(word) < 4:
        return java
    behind = java[len(head) + len(word):]
    if behind.startswith(_BOUNDARY):  # where a word letter stands before it
        behind = r"(?!\w)" + behind[len(_BOUNDARY):]
    return rf"(?d){word}(?<!\w{word}){behind}"  # Java's \w is ASCII


def whole_word(pattern: str) -> str | None:
    """The word, lower-cased, of a pattern that is nothing but a word between word boundaries."""
    m = re.fullmatch(rf"\\b({_WORD}+)\\b", pattern)
    return m.group(1).lower() if m else None


def literal_hints(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds one, read off the pattern's own structure; None where there is none.

    A sequence needs its longest literal run; an alternation needs one of each
    branch. Runs shorter than three letters are no help.
    """
    from re import _constants as C, _parser as P

    try:
        tree = P.parse(re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", re.sub(r"^\(\?[imsU]+\)", "", pattern)))
    except Exception:  # noqa: BLE001 - not readable here: no hints
        return None

    folding = "kKsS" if re.search(r"\(\?[a-zA-Z]*i", pattern) else ""  # those fold outside of ASCII

    def need(items) -> list[str] | None:
        best, run = None, ""

        def offer(found):
            nonlocal best
            if found and min(map(len, found)) >= 3 and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, arg in [*items, (None, None)]:
            if op is C.LITERAL and chr(arg).isascii() and chr(arg) not in folding:
                run += chr(arg).lower()
                continue
            offer([run])
            run = ""
            if op is C.SUBPATTERN:
                offer(need(arg[3]))
            elif op is C.BRANCH:
                branches = [need(b) for b in arg[1]]
                offer([x for b in branches for x in b] if all(branches) else None)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                offer(need(arg[2]))
        return best

    return need(list(tree))
