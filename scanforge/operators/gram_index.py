"""Rule matching through an inverted index of grams, for large rule tables.

``match_rules`` and ``match_secrets`` evaluate every rule of a line's language
on the line, so their work grows with the rules. Here the rules become an
index: each literal that a match must contain (``hints``, or those read off
the pattern) is filed under the one of its three-letter grams that the fewest
lines hold. A line's grams meet only the literals that are filed there, and
only the rules of the literals it holds have their pattern evaluated on it.

* The index is made from the rule rows on the driver, in parts of at most
  ``BROADCAST_CATALOG_BYTES``. Each part is looked up in one narrow pass over
  the lines, without a shuffle: Arrow tasks get the lower-cased line and give
  back the numbers of its rules (``operators.literals``); the patterns stand in
  a broadcast table and are evaluated by the JVM, once a line and rule.
* The counts of the grams are taken over all lines (``gram_counts``), or given.
* A rule with several literals meets a line once, whichever of them it holds.
* Rules without a literal of three letters are evaluated on every line as
  before, in the pass of the first part.

Results are those of the expression plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.functions.regex import literal_first, literal_hints, to_java, whole_word
from scanforge.operators.catalog import BROADCAST_CATALOG_BYTES, Catalog
from scanforge.operators.literals import Literals
from scanforge.operators.matching import Rule, explode_hits, leak_hits_expr, lower_for_hints, sast_hits_expr, sast_line

GRAM = 3


def grams_of(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def split_rules(specs: list[Rule]) -> tuple[list[tuple[Rule, list[str]]], list[Rule]]:
    """(rule, its literals) for rules that the index can hold, and the others."""
    held, rest = [], []
    for r in specs:
        hints = list(r.hints) if r.hints else literal_hints(r.pattern)
        if hints and min(map(len, hints)) >= GRAM:
            held.append((r, hints))
        else:
            rest.append(r)
    return held, rest


def _parts(rows: Iterable[tuple], limit: int) -> Iterable[list[tuple]]:
    part, size = [], 0
    for row in rows:
        n = sum(len(str(v).encode()) + 16 for v in row)
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append(row)
        size += n
    if part:
        yield part


def gram_counts(lines: DataFrame, grams: Iterable[str], line_col: str = "line", limit: int = BROADCAST_CATALOG_BYTES) -> dict[str, int]:
    """In how many lines each of the rules' grams occurs (as many rows as the rules have grams)."""
    out: dict[str, int] = {}
    low = lines.select(lower_for_hints(F.col(line_col)).alias("_lc"))
    for part in _parts(((g,) for g in sorted(grams)), limit):
        names = [g for g, in part]
        counted = low.mapInArrow(_counter(names), "_gram int, n bigint").groupBy("_gram").agg(F.sum("n").alias("n"))
        out |= {names[r["_gram"]]: r["n"] for r in counted.collect()}
    return out


def _counter(grams: list[str]):
    held = Literals([(g, g, i, False) for i, g in enumerate(grams)], len(grams))

    def count(batches):
        total = sum((held.counts(b.column(0)) for b in batches), held.counts(pa.array([], pa.string())))
        some = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["_gram", "n"])
    return count


def index_rows(held: list[tuple[Rule, list[str]]], counts: dict[str, int]) -> list[tuple]:
    """One row a literal, filed under its rarest gram (ties: by letters); a rule's rows stand together. A word that is
    all of its pattern between two word boundaries needs no look at lines that hold it only inside other words."""
    rows = []
    for r, hints in held:
        rx, anti = literal_first(to_java(r.pattern)), to_java(r.anti_pattern) if r.anti_pattern else None
        word = whole_word(r.pattern)
        for h in dict.fromkeys(hints):
            gram = min(grams_of(h), key=lambda g: (counts.get(g, 0), g))
            rows.append((gram, r.k, r.language, h, rx, anti, h == word))
    return rows


def _finder(entries: list[tuple[str, str, int, bool]], rules: list[int]):
    """Of a lower-cased line, the rules (``k``) of which it holds a literal."""
    held, ks = Literals(entries, len(rules)), pa.array(rules, pa.int32())

    @F.arrow_udf("array<int>")
    def find(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lines:
            found = held.lists(batch)
            yield pa.ListArray.from_arrays(found.offsets, ks.take(found.values))
    return find


def candidates(pre: DataFrame, rows: list[tuple], limit: int = BROADCAST_CATALOG_BYTES, also: Column | None = None) -> DataFrame | None:
    """``pre`` (with the lower-cased line in _lc) x the index: each (line, rule) whose literal the line holds, once.

    ``_h`` has the rule (``k``), ``_lang``, ``_rx`` and ``_anti`` what decides. ``also`` (an array of hits, never NULL) comes
    out of the same pass, with ``pos`` or ``m`` in ``_h``."""
    out = None
    keep = pre.columns
    for part in _parts(([*r] for _, r in groupby(rows, key=lambda r: r[1])), limit):
        rules = [r[0][1] for r in part]
        entries = [(hint, gram, i, apart) for i, r in enumerate(part) for gram, _, _, hint, _, _, apart in r]
        found = pre.select("*", _finder(entries, rules)("_lc").alias("_found"))
        hits = F.transform("_found", lambda k: F.struct(k.alias("k"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("m")))
        met = explode_hits(found, hits if also is None else F.concat(hits, also), "_lc", keep).where(F.col("_h").isNotNull())
        decide = F.broadcast(pre.sparkSession.createDataFrame([(r[0][1], r[0][2], *r[0][4:6]) for r in part], "_k int, _lang string, _rx string, _anti string"))
        met = met.join(decide, F.col("_h.k") == F.col("_k"), "inner" if also is None else "left").select(*keep, "_h", "_lang", "_rx", "_anti")
        out, also = met if out is None else out.unionAll(met), None
    return out


def _once(hits: DataFrame, value: Column, name: str, *columns) -> DataFrame:
    """``columns`` and ``value``, which no filter behind it works out again."""
    return hits.select(*columns, F.explode_outer(F.array(value)).alias(name))


def _index(lines: DataFrame, specs: list[Rule], counts: dict[str, int] | None, line_col: str, limit: int) -> tuple[list[tuple], list[Rule]]:
    held, rest = split_rules(specs)
    if counts is None and held:
        counts = gram_counts(lines, set().union(*(grams_of(h) for _, hints in held for h in hints)), line_col, limit)
    return index_rows(held, counts or {}), rest


def match_rules_indexed(lines: DataFrame, rules: DataFrame | None = None, counts: dict[str, int] | None = None,
                        limit: int = BROADCAST_CATALOG_BYTES) -> DataFrame:
    """``match_rules`` for rule tables of any size: lines(…, language, line_no, line) -> (…, rule_id, column)."""
    cat = Catalog(lines.sparkSession, sast_rules=rules, leaks=False)
    rows, rest = _index(lines, cat.sast_specs, counts, "line", limit)
    keep = lines.columns
    pre = lines.where(F.col("language").isNotNull()).select("*", lower_for_hints(F.col("line")).alias("_lc"), sast_line(F.col("line")).alias("_sline"))
    also = sast_hits_expr(rest, "_sline", "_lc", "language") if rest else None
    met = candidates(pre, rows, limit, also)
    if met is not None:
        mine = ((F.col("_lang") == "Generic") | (F.col("_lang") == F.col("language"))) & (F.col("_anti").isNull() | ~F.rlike("_sline", F.col("_anti")))
        pos = F.coalesce("_h.pos", F.when(mine, F.regexp_instr("_sline", F.col("_rx"))))
        hits = _once(met, pos, "_pos", *keep, "_sline", F.col("_h.k").alias("k"))
    elif rest:
        hits = explode_hits(pre, also, "_sline", [*keep, "_sline"]).where(F.col("_h").isNotNull())
        hits = hits.select(*keep, "_sline", F.col("_h.k").alias("k"), F.col("_h.pos").alias("_pos"))
    else:
        return pre.where(F.lit(False)).select(*keep, F.lit("").alias("rule_id"), F.lit(0).alias("column"))
    hits = hits.where(F.col("_pos") > 0).join(cat.df().select("k", "rule_id"), "k")
    col = F.octet_length(F.col("_sline").substr(F.lit(1), F.col("_pos") - 1)) + 1
    return hits.select(*keep, "rule_id", col.alias("column"))


def match_secrets_indexed(lines: DataFrame, rules: DataFrame | None = None, line_col: str = "line", counts: dict[str, int] | None = None,
                          limit: int = BROADCAST_CATALOG_BYTES) -> DataFrame:
    """``match_secrets`` for rule tables of any size: (…, rule_id, leak_type, severity, description, entropy_gated, match)."""
    cat = Catalog(lines.sparkSession, leak_rules=rules, sast=False)
    rows, rest = _index(lines, cat.leak_specs, counts, line_col, limit)
    keep = lines.columns
    pre = lines.select("*", lower_for_hints(F.col(line_col)).alias("_lc"))
    also = leak_hits_expr(rest, f"`{line_col}`", "_lc") if rest else None
    met = candidates(pre, rows, limit, also)
    columns = ["rule_id", "leak_type", "severity", "description", "entropy_gated"]
    if met is not None:
        hits = _once(met, F.coalesce("_h.m", F.expr(f"regexp_extract(`{line_col}`, _rx, 0)")), "match", *keep, F.col("_h.k").alias("k"))
    elif rest:
        hits = explode_hits(pre, also, "_lc", keep).where(F.col("_h").isNotNull())
        hits = hits.select(*keep, F.col("_h.k").alias("k"), F.col("_h.m").alias("match"))
    else:
        return pre.where(F.lit(False)).select(*keep, *(F.lit(None).cast("string").alias(c) for c in [*columns[:4], "match"]))
    return hits.where(F.col("match") != "").join(cat.df().select("k", *columns), "k").select(*keep, *columns, "match")
