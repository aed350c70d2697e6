"""One line per rule that it must find, and one next to it that it may miss.

The lines are made from the patterns: every construct is replaced by the
shortest text it accepts. The second line has the middle of the first replaced,
so it tests that both sides of a comparison agree on what no longer matches.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

from scanforge.constants import EXTENSION_LANGUAGE, IAC_EXTENSION_LANGUAGE
from scanforge.operators.rules import builtin_rule_rows, leak_rule_rows

_CATEGORY = {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " ", C.CATEGORY_WORD: "w", C.CATEGORY_NOT_SPACE: "x", C.CATEGORY_NOT_DIGIT: "x", C.CATEGORY_NOT_WORD: " "}
#: letters of a repeated class, in turn, so that long secrets are not one letter
_TURN = "a7B3c9D1e5F2g8H4"


def _one(items, turn: int) -> str:
    if items[0][0] is C.NEGATE:
        banned = re.compile("[" + "".join(_spell(x) for x in items[1:]) + "]")
        return next(c for c in _TURN[turn % 16] + "xyz019 _-.,;" if not banned.match(c))
    allowed = re.compile("[" + "".join(_spell(x) for x in items) + "]")
    if allowed.match(_TURN[turn % 16]):
        return _TURN[turn % 16]
    op, arg = items[0]
    return chr(arg) if op is C.LITERAL else chr(arg[0]) if op is C.RANGE else _CATEGORY[arg]


def _spell(item) -> str:
    op, arg = item
    if op is C.LITERAL:
        return re.escape(chr(arg))
    if op is C.RANGE:
        return f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}"
    return {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_SPACE: r"\s", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_NOT_DIGIT: r"\D",
            C.CATEGORY_NOT_WORD: r"\W"}[arg]


def _text(items, turn: int = 0) -> str:
    out = ""
    for op, arg in items:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += "x" if chr(arg) != "x" else "y"
        elif op is C.ANY:
            out += "x"
        elif op is C.IN:
            out += _one(arg, turn)
        elif op is C.SUBPATTERN:
            out += _text(arg[3], turn)
        elif op is C.BRANCH:
            out += _text(arg[1][0], turn)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(_text(arg[2], turn + k) for k in range(arg[0]))
    return out


def positive(pattern: str) -> str:
    return _text(list(P.parse(pattern)))


def near_miss(text: str) -> str:
    at = len(text) // 2
    return text[:at] + "·" + text[at + 1:]


def samples() -> list[tuple[int, str, str]]:
    """(slot, extension, line): for every rule its line and its near miss, in a file of its language."""
    ext = {}
    for mapping in (EXTENSION_LANGUAGE, IAC_EXTENSION_LANGUAGE):
        for e, lang in mapping.items():
            ext.setdefault(lang, e)
    rows = []
    for r in builtin_rule_rows():
        line = positive(r[4])
        rows += [(ext.get(r[1], ".py"), line), (ext.get(r[1], ".py"), near_miss(line))]
    for r in leak_rule_rows():
        line = positive(r[2])
        rows += [(".env", line), (".env", near_miss(line))]
    return [(i, e, line) for i, (e, line) in enumerate(rows)]
