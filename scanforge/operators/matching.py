"""Lines x rules: the regex theta-join, planned as native expressions.

A rule table is small (hundreds of rows, bounded by the rule-file caps), so
it is turned into expressions on the driver: for every line one array of
``CASE WHEN <literal prefilter> THEN struct(rule, regexp_instr/extract) END``
per language. Patterns are literals, so each task compiles every regex once;
the whole pass (split, explode, match) is one narrow stage with no shuffle and
no Python in the executors. The rules stand in a projection outside the
whole-stage code (``explode_hits``). A ``contains`` test on the lower-cased
line (``rule_hints``) keeps most lines away from the regex engine.

The work grows linearly with the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.regex import to_java

HIT_TYPE = "struct<k:int,pos:int,m:string>"


@dataclass(frozen=True)
class Rule:
    k: int                      # position in the rule catalog
    rule_id: str
    language: str | None        # None for secret rules (all languages)
    pattern: str                # RE2 syntax
    anti_pattern: str | None
    hints: tuple | None


def lower_for_hints(line: Column) -> Column:
    """Lower-case a line the way RE2 case folding reaches ASCII literals
    (KELVIN SIGN lower-cases to 'k'; LONG S is mapped to 's')."""
    return F.replace(F.lower(line), F.lit("\u017f"), F.lit("s"))  # translate() walks every character, replace() only looks for one


# The match expressions are generated as SQL text and parsed once by the
# JVM: one call instead of thousands of Python->JVM round trips per rule.

def sql_str(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hint_sql(lc: str, hints) -> str | None:
    if not hints:
        return None
    return "(" + " OR ".join(f"contains({lc}, {sql_str(h)})" for h in hints) + ")"


def _sast_item_sql(r: Rule, line: str, lc: str) -> str:
    item = (f"named_struct('k', {r.k}, 'pos', regexp_instr({line}, {sql_str(to_java(r.pattern))}), "
            f"'m', CAST(NULL AS STRING))")
    conds = [c for c in (_hint_sql(lc, r.hints),) if c]
    if r.anti_pattern:
        conds.append(f"NOT ({line} RLIKE {sql_str(to_java(r.anti_pattern))})")
    return f"CASE WHEN {' AND '.join(conds)} THEN {item} END" if conds else item


def _leak_item_sql(r: Rule, line: str, lc: str) -> str:
    item = (f"named_struct('k', {r.k}, 'pos', CAST(NULL AS INT), "
            f"'m', regexp_extract({line}, {sql_str(to_java(r.pattern))}, 0))")
    cond = _hint_sql(lc, r.hints)
    return f"CASE WHEN {cond} THEN {item} END" if cond else item


EMPTY_HITS_SQL = f"CAST(array() AS array<{HIT_TYPE}>)"


def sast_hits_sql(specs: list[Rule], line: str, lc: str, language: str) -> str:
    """SQL for array<struct<k,pos,m>> of candidate SAST hits of one line: the
    rules of the file's language, then the Generic rules (written once)."""
    generic = [r for r in specs if r.language == "Generic"]
    langs = sorted({r.language for r in specs if r.language and r.language != "Generic"})

    def arr(rs):
        rs = sorted(rs, key=lambda r: r.k)
        return ("array(" + ", ".join(_sast_item_sql(r, line, lc) for r in rs) + ")") if rs else EMPTY_HITS_SQL

    whens = [f"WHEN {language} = {sql_str(lang)} THEN {arr([r for r in specs if r.language == lang])}"
             for lang in langs]
    own = ("CASE " + " ".join(whens) + f" ELSE {EMPTY_HITS_SQL} END") if whens else EMPTY_HITS_SQL
    return f"CASE WHEN {language} IS NOT NULL THEN concat({own}, {arr(generic)}) END"


def leak_hits_sql(specs: list[Rule], line: str, lc: str) -> str:
    if not specs:
        return EMPTY_HITS_SQL
    return "array(" + ", ".join(_leak_item_sql(r, line, lc) for r in sorted(specs, key=lambda r: r.k)) + ")"


def sast_hits_expr(specs: list[Rule], line: str, lc: str, language: str) -> Column:
    return F.expr(sast_hits_sql(specs, line, lc, language))


def leak_hits_expr(specs: list[Rule], line: str, lc: str) -> Column:
    return F.expr(leak_hits_sql(specs, line, lc))


def explode_hits(rows: DataFrame, hits: Column, present: str, columns: list, name: str = "_h") -> DataFrame:
    """``columns`` of ``rows`` with each element of ``hits`` as ``name`` (NULL: none), for rows whose ``present`` is not NULL.

    Whole-stage code holds an operator's expressions in one method, and the JVM leaves methods above 8,000 bytes of code
    uncompiled: hundreds of rules run several times slower there. A lambda keeps this projection out of it; the
    projection's own code is cut into small methods. ``present`` stands in it twice, so a computed one also keeps the
    projection apart from the one below. The outer form: the optimizer would infer size(hits) > 0 from the other and
    match every line once more for it."""
    here = F.exists(F.array(F.col(present)), lambda x: x == F.col(present))
    matched = rows.select(*columns, F.when(here, hits).alias("_rule_hits"))
    return matched.select(*columns, F.explode_outer("_rule_hits").alias(name))


def sast_line(line: Column) -> Column:
    """Line as a line scanner returns it: one trailing CR removed."""
    return F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)


def overlong_cut(lines_arr: Column, content: Column, limit: int) -> Column:
    """1-based number of the first line of >= ``limit`` bytes (0 if none).

    A line scanner with a ``limit``-byte token buffer stops there: that line
    and every later line of the file are not scanned. Only files of at least
    ``limit`` bytes need the per-line check.
    """
    first = F.array_position(F.transform(lines_arr, lambda x: F.octet_length(x) >= limit), True)
    return F.when(F.octet_length(content) >= limit, first).otherwise(F.lit(0)).cast("int")


def explode_lines(files: DataFrame, content_col: str = "content", keep_array: bool = False,
                  final_empty: bool = True) -> DataFrame:
    """content -> (line_no from 1, line); split on LF, every piece kept.
    ``final_empty=False`` drops an empty last piece, as a line scanner does.
    Other columns are carried."""
    others = [c for c in files.columns if c != content_col]
    arr = F.split(F.col(content_col), "\n", -1)
    sel = [F.col(c) for c in others]
    if keep_array:
        sel.append(arr.alias("lines"))
    if not final_empty:
        arr = F.when(F.col(content_col).endswith("\n") | (F.col(content_col) == ""), F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)
    df = files.select(*sel, F.posexplode(arr).alias("pos", "line"))
    return df.withColumn("line_no", (F.col("pos") + 1).cast("int")).drop("pos")


def skip_leak_line(line: Column, max_bytes: int | None = None) -> Column:
    """True for lines secret scanning skips: blank, comment (#) and, with
    ``max_bytes``, longer ones."""
    from scanforge.functions.text import trim_space
    t = trim_space(line)
    skip = (t == "") | t.startswith("#")
    return skip if max_bytes is None else skip | (F.octet_length(line) > max_bytes)


def match_files(files: DataFrame, sast_specs: list[Rule] | None, leak_specs: list[Rule] | None,
                key_cols: list[str], overlong_limit: int | None = None,
                leak_line_cap: int | None = None, with_snippet: bool = True, context: int = 3,
                sast_max_line_bytes: int | None = None, rule_language_col: str = "language",
                deps: Column | None = None) -> DataFrame:
    """One pass over file contents producing every rule hit.

    ``files`` carries ``key_cols``, ``content``, ``language`` (NULL: no SAST)
    and ``leak_ok`` (secret scanning admitted). Output: key columns,
    ``line_no``, ``engine`` ('sast'/'leak'), ``k`` (catalog position),
    ``col`` (1-based byte column, SAST), ``m`` (first match, leaks),
    ``code`` (+/- ``context`` lines, SAST).

    Nothing is cut by default. ``overlong_limit`` ends a file's SAST at the
    first line of that many bytes, ``leak_line_cap`` leaves longer lines out of
    the secret search. ``sast_max_line_bytes`` skips SAST
    matching on longer lines: java.util.regex backtracks where RE2 is
    linear, so adversarial minified lines can be kept from stalling a task.

    ``deps`` (an expression over a file row, array<struct<name,version>>) is
    given out in the same pass: its elements come with the file's first line as
    rows of engine 'dep' with ``dep_name`` and ``dep_version``. Files that
    neither engine searches are not split then.
    """
    content = F.col("content")
    arr = F.split(content, "\n", -1)
    sel = [F.col(c) for c in key_cols] + [F.col(rule_language_col).alias("_rule_lang"), F.col("leak_ok")]
    also = []
    if deps is not None:
        arr = F.when(F.col(rule_language_col).isNotNull() | F.col("leak_ok"), arr).otherwise(F.array(F.lit("")))
        sel.append(deps.alias("deps"))
        dep_hits = F.transform("deps", lambda d, i: F.struct(F.lit(-1).alias("k"), (i + 1).alias("pos"), F.lit(None).cast("string").alias("m")))
        also = [F.col("deps"), dep_hits.alias("dep_hits")]
    cut = overlong_cut(F.col("lines"), content, overlong_limit) if (sast_specs and overlong_limit) else F.lit(0)
    base = files.select(*sel, arr.alias("lines"), content)
    base = base.select(*[F.col(c) for c in key_cols], "_rule_lang", "leak_ok", "lines",
                       F.size("lines").alias("n_lines"), cut.alias("cut"), *also)
    # the outer form: the optimizer would infer size(lines) > 0 from the other and split every content once more for it
    exploded = base.select("*", F.posexplode_outer("lines").alias("pos0", "line"))
    # What the hits need of the file is taken here, in the whole-stage code of the explode, where the file's arrays are
    # not copied: a row that leaves it holds its line and what belongs to it.
    n = (F.col("pos0") + 1).cast("int")
    line = F.col("line")
    carry = [n.alias("line_no"), lower_for_hints(line).alias("lc")]
    out_cols = []
    parts = []
    if sast_specs:
        sast_ok = F.col("_rule_lang").isNotNull() & ((F.col("cut") == 0) | (n < F.col("cut")))
        # a line scanner returns no line after the last line end
        sast_ok = sast_ok & ((n < F.col("n_lines")) | (line != ""))
        if sast_max_line_bytes is not None:
            sast_ok = sast_ok & (F.octet_length("line") <= sast_max_line_bytes)
        carry += [sast_line(line).alias("sline"), F.when(sast_ok, F.col("_rule_lang")).alias("sast_lang")]
        out_cols.append("sline")
        if with_snippet:
            carry.append(F.when(sast_ok, snippet_of(F.col("lines"), n, F.col("n_lines"), context)).alias("snippet"))
            out_cols.append("snippet")
        parts.append(sast_hits_expr(sast_specs, "sline", "lc", "sast_lang"))
    if leak_specs:
        carry += [line, (F.col("leak_ok") & ~skip_leak_line(line, leak_line_cap)).alias("searched")]
        parts.append(F.when(F.col("searched"), leak_hits_expr(leak_specs, "line", "lc")))
    if deps is not None:
        carry += [F.when(F.col("pos0") == 0, F.col(c)).alias(c) for c in ("deps", "dep_hits")]
        out_cols.append("deps")
        parts.append(F.col("dep_hits"))
    prepared = exploded.select(*[F.col(c) for c in key_cols], *carry)
    empty = F.array().cast(f"array<{HIT_TYPE}>")
    all_hits = F.concat(*[F.coalesce(p, empty) for p in parts]) if len(parts) > 1 else F.coalesce(parts[0], empty)
    hits = explode_hits(prepared, all_hits, "line_no", [*[F.col(c) for c in key_cols], "line_no", *out_cols], "h")
    hits = hits.where(F.col("h").isNotNull() & ((F.col("h.pos") > 0) | (F.col("h.m") != "")))
    is_dep = F.col("h.k") < 0 if deps is not None else F.lit(False)
    is_sast = F.col("h.pos").isNotNull() & ~is_dep
    column = F.octet_length(F.col("sline").substr(F.lit(1), F.col("h.pos") - 1)) + 1 if sast_specs else F.lit(None).cast("int")
    out = [F.col(c) for c in key_cols] + [
        F.col("line_no"),
        F.when(is_dep, F.lit("dep")).when(is_sast, F.lit("sast")).otherwise(F.lit("leak")).alias("engine"),
        F.col("h.k").alias("k"),
        F.when(is_sast, column).alias("col"),
        F.col("h.m").alias("m"),
    ]
    if with_snippet:
        out.append(F.when(is_sast, F.col("snippet") if sast_specs else F.lit(None).cast("string")).alias("code"))
    if deps is not None:
        dep = F.when(is_dep, F.get("deps", F.col("h.pos") - 1))
        out += [dep["name"].alias("dep_name"), dep["version"].alias("dep_version")]
    return hits.select(*out)


def snippet_of(lines_arr, line_no, n_lines, context: int = 3):
    lo = F.greatest(line_no - context, F.lit(1))
    hi = F.least(line_no + context, n_lines)
    return F.array_join(F.slice(lines_arr, lo, hi - lo + 1), "\n")


def skip_leak_lines(lines: DataFrame, line_col: str = "line", max_bytes: int | None = None) -> DataFrame:
    """Drop the lines secret scanning skips (blank, '#' comments, longer than ``max_bytes``)."""
    return lines.where(~skip_leak_line(F.col(line_col), max_bytes))
