"""Secret detection: line matching, entropy gate, redaction, ignore-file
downgrade, history scan with first-commit dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.constants import ENTROPY_MIN
from scanforge.functions.regex import to_java
from scanforge.functions.text import redact, shannon_entropy, trim_space
from scanforge.operators.catalog import Catalog
from scanforge.operators.matching import explode_hits, leak_hits_expr, lower_for_hints, match_files, sast_line
from scanforge.sources.files import binary_flag, drop_media_extensions, is_binary

# FIXED VALUES: suffix of a finding in an ignored file.
IGNORED_SUFFIX = (" — file is listed in .gitignore; severity downgraded to INFO. "
                  "If this file was ever committed historically, run the history scan to check.")


def match_secrets(lines: DataFrame, rules: DataFrame | None = None, line_col: str = "line") -> DataFrame:
    """Every secret rule on every line: (…, rule_id, leak_type, severity,
    description, entropy_gated, match) — match is the first match text."""
    cat = Catalog(lines.sparkSession, leak_rules=rules, sast=False)
    pre = lines.select("*", lower_for_hints(F.col(line_col)).alias("_lc"))
    hits = explode_hits(pre, leak_hits_expr(cat.leak_specs, f"`{line_col}`", "_lc"), "_lc", [F.col(f"`{c}`") for c in lines.columns])
    hits = hits.where(F.col("_h").isNotNull() & (F.col("_h.m") != ""))
    c = cat.df().select("k", "rule_id", "leak_type", "severity", "description", "entropy_gated")
    return hits.join(c, F.col("_h.k") == F.col("k")).withColumn("match", F.col("_h.m")).drop("_h", "k")


def entropy_gate(hits: DataFrame, min_entropy: float = ENTROPY_MIN, match_col: str = "match") -> DataFrame:
    """Rules named Generic / High Entropy keep a hit only with entropy >= min;
    other rules report entropy 0."""
    ent = F.when(F.col("entropy_gated"), shannon_entropy(F.col(match_col))).otherwise(F.lit(0.0))
    return hits.withColumn("entropy", ent).where(~F.col("entropy_gated") | (F.col("entropy") >= min_entropy))


def redact_corpus(files: DataFrame, rules: DataFrame | None = None, content_col: str = "content",
                  mask: str = "***REDACTED***") -> DataFrame:
    """The corpus with every secret match masked in place, line by line.

    One projection per rule over the file's line array (a higher-order
    ``transform``), run only for files whose lower-cased text contains one of
    the rule's literals. The file never leaves its row: no shuffle, no
    re-assembly."""
    cat = Catalog(files.sparkSession, leak_rules=rules, sast=False)
    c = F.col(content_col)
    df = files.withColumn("_lines", F.split(c, "\n", -1)).withColumn("_lc", lower_for_hints(c))
    lc = F.col("_lc")
    def masker(rx):
        return lambda line: F.regexp_replace(line, rx, mask)

    for r in cat.leak_specs:
        replaced = F.transform(F.col("_lines"), masker(to_java(r.pattern)))
        if r.hints:
            cond = None
            for h in r.hints:
                cond = lc.contains(h) if cond is None else (cond | lc.contains(h))
            df = df.withColumn("_lines", F.when(cond, replaced).otherwise(F.col("_lines")))
        else:
            df = df.withColumn("_lines", replaced)
    return df.withColumn(content_col, F.when(c.isNull(), c).otherwise(F.array_join("_lines", "\n"))).drop(
        "_lines", "_lc")


# ------------------------------------------------------------ ignore files

def ignore_patterns_from_files(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(repo, ord, pattern) from each repository's root ignore file."""
    ig = files.where(F.col("path") == name).select("repo", F.posexplode(F.split("content", "\n", -1)).alias("ord", "raw"))
    return ig.select("repo", "ord", F.col("raw").alias("pattern"))


# a range whose first letter stands behind its last one, for every printable ASCII letter
_REVERSED = "|".join(f"\\x{{{c:x}}}-[\\x{{21}}-\\x{{{c - 1:x}}}]" for c in range(0x22, 0x7F))


def glob_to_regex(pattern: Column) -> tuple[Column, Column]:
    """Translate ignore-file lines to (regex over the relative path, negated).

    Native string functions only. Semantics: ``!`` negates; a trailing ``/``
    matches directories only (a path under it); a pattern containing ``/`` is
    anchored at the root, otherwise it matches any path segment; ``*`` and
    ``?`` stay within one segment, ``**`` spans segments.
    """
    p = trim_space(pattern)
    neg = p.startswith("!")
    p = F.when(neg, p.substr(F.lit(2), F.length(p))).otherwise(p)
    p = F.rtrim(p)
    dir_only = p.endswith("/")
    p = F.when(dir_only, p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)
    anchored = p.contains("/")
    p = F.regexp_replace(p, r"^/", "")
    # [abc], [!abc], [^abc] become regex classes; an unclosed '[' makes a pattern that matches nothing
    body = p
    for plain, mark in ((r"\\\*", "\uE010"), (r"\\\?", "\uE011"), (r"\\\[", "\uE012")):  # escaped: themselves
        body = F.regexp_replace(body, plain, mark)
    body = F.regexp_replace(body, r"\\(.)", "$1")
    closed = F.regexp_replace(body, r"\[[!^]?\]?[^\]]*\]", "")
    reversed_range = body.rlike(r"\[[!^]?\]?[^\]]*(?:" + _REVERSED + ")")  # such a class matches nothing
    body = F.regexp_replace(body, r"\[[!^](\]?[^\]]*)\]", "\uE002$1\uE003")
    body = F.regexp_replace(body, r"\[(\]?[^\]]*)\]", "\uE004$1\uE003")
    body = F.regexp_replace(body, r"([.+(){}|^$\\&~\[\]])", r"\\$1")
    body = F.regexp_replace(body, r"\*\*/", "\u0001")      # leading/middle **/
    body = F.regexp_replace(body, r"/\*\*$", "\u0002")     # trailing /**
    body = F.regexp_replace(body, r"\*\*", "\u0003")
    body = F.regexp_replace(body, r"\*", "[^/]*")
    body = F.regexp_replace(body, r"\?", "[^/]")
    body = F.regexp_replace(body, "\u0001", "(?:[^/]+/)*")
    body = F.regexp_replace(body, "\u0002", "(?:/.*)?")
    body = F.regexp_replace(body, "\u0003", ".*")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "\uE002", "[^/"), "\uE004", "["), "\uE003", "]")
    for mark, literal in (("\uE010", r"\\*"), ("\uE011", r"\\?"), ("\uE012", r"\\[")):
        body = F.regexp_replace(body, mark, literal)
    body = F.when(closed.contains("[") | reversed_range, F.lit("(?!)")).otherwise(body)
    tail = F.when(dir_only, F.lit("/")).otherwise(F.lit("(?:/|$)"))
    head = F.when(anchored, F.lit("^")).otherwise(F.lit("(?:^|/)"))
    return F.concat(head, body, tail), neg


def gitignore_match(paths: DataFrame, patterns: DataFrame, path_col: str = "path") -> DataFrame:
    """paths(repo, path) -> (repo, path, ignored): the last matching pattern of
    the repository's ignore file decides (negated -> not ignored); blank and
    ``#`` lines are skipped; no ignore file -> False.

    The patterns of a repository become one ordered array (one ignore file a
    repository); every distinct path joins its repository's array and folds
    over it, so no (path, pattern) pairs are materialised and only keys move.
    A pattern that is no valid expression matches nothing."""
    t = trim_space(F.col("pattern"))
    pats = patterns.where((t != "") & ~t.startswith("#"))
    rx, neg = glob_to_regex(F.col("pattern"))
    per_repo = (pats.select("repo", F.struct(F.col("ord").alias("ord"), rx.alias("rx"), neg.alias("neg")).alias("p"))
                .groupBy("repo").agg(F.sort_array(F.collect_list("p")).alias("_pats")))
    keys = paths.select("repo", F.col(path_col).alias("path")).distinct()
    j = keys.join(per_repo, "repo", "left")
    empty = F.array().cast("array<struct<ord:int,rx:string,neg:boolean>>")
    decide = F.aggregate(F.coalesce(F.col("_pats"), empty), F.lit(False),
                         lambda acc, p: F.when(F.regexp(F.col("path"), p["rx"]), ~p["neg"]).otherwise(acc))
    return j.select("repo", "path", decide.alias("ignored"))


def downgrade_ignored(leaks: DataFrame, ignored: DataFrame | None) -> DataFrame:
    """Leak findings in ignored files: severity INFO, description tagged.

    ``ignored`` is the output of ``gitignore_match`` (repo, path, ignored)."""
    if ignored is None:
        return leaks
    ig_paths = ignored.where("ignored").select(F.col("repo").alias("_ig_repo"), F.col("path").alias("_ig_path"),
                                               F.lit(True).alias("_ig"))
    j = leaks.join(ig_paths, (F.col("repo") == F.col("_ig_repo")) & (F.col("file") == F.col("_ig_path")), "left")
    ig = F.coalesce(F.col("_ig"), F.lit(False)) & (F.col("engine") == "Leaks")
    return (j.withColumn("severity", F.when(ig, F.lit("INFO")).otherwise(F.col("severity")))
            .withColumn("description", F.when(ig, F.concat(F.lit("[.gitignore] "), F.col("description"),
                                                           F.lit(IGNORED_SUFFIX))).otherwise(F.col("description")))
            .drop("_ig_repo", "_ig_path", "_ig"))


# ------------------------------------------------------------ findings

def leak_findings_from_hits(hits: DataFrame, catalog: DataFrame, min_entropy: float = ENTROPY_MIN,
                            extra_cols=()) -> DataFrame:
    j = hits.where(F.col("engine") == "leak").join(catalog, "k")
    j = entropy_gate(j, min_entropy, match_col="m")
    return j.select(
        "repo", F.lit("Leaks").alias("engine"), "rule_id", "severity",
        F.col("leak_type").alias("title"), "description",
        F.col("path").alias("file"), F.col("line_no").alias("line"),
        redact(F.col("m")).alias("match"), F.round("entropy", 6).alias("entropy"),
        F.lit(False).alias("in_git_history"), F.lit(None).cast("string").alias("commit_hash"),
        F.lit("").alias("ai_remediation"), *extra_cols,
    )


def leak_scan(files: DataFrame, rules: DataFrame | None = None, patterns: DataFrame | None = None,
              max_bytes: int | None = None, min_entropy: float = ENTROPY_MIN, line_cap: int | None = None) -> DataFrame:
    """binary skip -> lines -> comment/blank skip -> match -> entropy gate ->
    redact -> ignore-file downgrade. One narrow stage up to the (broadcast)
    catalog join. ``max_bytes`` (per file) and ``line_cap`` (per line) are off
    unless given."""
    cat = Catalog(files.sparkSession, leak_rules=rules, sast=False)
    ok = ~binary_flag(files)
    if max_bytes is not None:
        ok = ok & ((F.col("size") if "size" in files.columns else F.octet_length("content")) <= max_bytes)
    f = files.select("repo", "path", "content", F.lit(None).cast("string").alias("language"), ok.alias("leak_ok"))
    f = f.where("leak_ok")
    hits = match_files(f, None, cat.leak_specs, ["repo", "path"], with_snippet=False, leak_line_cap=line_cap)
    return downgrade_by_patterns(leak_findings_from_hits(hits, cat.df(), min_entropy), patterns)


def downgrade_by_patterns(findings: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """Downgrade secret findings by ignore-file patterns. Only the (repo, file)
    pairs that have secret findings are decided, never the whole corpus."""
    if patterns is None:
        return findings
    keys = findings.where(F.col("engine") == "Leaks").select("repo", F.col("file").alias("path"))
    return downgrade_ignored(findings, gitignore_match(keys, patterns))


def scan_lines(texts: DataFrame, rules: DataFrame | None = None, text_col: str = "text",
               key_cols=("id",)) -> DataFrame:
    """Bare variant: every rule on every line of a text column (line scanner
    semantics: CR stripped), no comment skip, no gate, no entropy."""
    lines = texts.select(*key_cols, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    lines = lines.select(*key_cols, (F.col("pos") + 1).alias("line_no"), sast_line(F.col("raw")).alias("line"))
    hits = match_secrets(lines, rules)
    return hits.select(*key_cols, "line_no", F.col("leak_type").alias("type"), redact("match").alias("match"),
                       "rule_id", "severity", "description")


def _commit_threshold(blobs: DataFrame, max_commits: int, salts: int = 64) -> DataFrame:
    """Per repo: the oldest (commit_seq, commit_hash) among its ``max_commits``
    most recent commits. Exact two-level top-k: rank inside (repo, salt)
    buckets first, so one huge repository is ranked by many tasks."""
    commits = blobs.select("repo", "commit_seq", "commit_hash").distinct()
    commits = commits.withColumn("_salt", F.abs(F.hash("commit_hash")) % salts)
    order = [F.col("commit_seq").desc(), F.col("commit_hash").desc()]
    w1 = Window.partitionBy("repo", "_salt").orderBy(*order)
    local = commits.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= max_commits)
    w2 = Window.partitionBy("repo").orderBy(*order)
    top = local.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= max_commits)
    return top.groupBy("repo").agg(F.min(F.struct("commit_seq", "commit_hash")).alias("_min_commit"))


def history_hits(blobs: DataFrame, leak_specs, max_commits: int | None = None, max_bytes: int | None = None,
                 line_cap: int | None = None) -> DataFrame:
    """Secret hits of every file version (media and binary files skipped).
    With ``max_commits`` only the most recent commits of each repository count;
    the threshold joins the hits, so file contents never shuffle."""
    ok = ~is_binary(F.col("content"))
    if max_bytes is not None:
        ok = ok & (F.octet_length("content") <= max_bytes)
    f = drop_media_extensions(blobs).select("repo", "path", "commit_seq", "commit_hash", "content",
                                            F.lit(None).cast("string").alias("language"), ok.alias("leak_ok"))
    hits = match_files(f.where("leak_ok"), None, leak_specs, ["repo", "path", "commit_seq", "commit_hash"], with_snippet=False,
                       leak_line_cap=line_cap)
    if max_commits is not None:
        hits = hits.join(_commit_threshold(blobs, max_commits), "repo").where(
            F.struct("commit_seq", "commit_hash") >= F.col("_min_commit")).drop("_min_commit")
    return hits


def distinct_contents(versions: DataFrame) -> DataFrame:
    """Contents by address (_h: SHA-256, _len: bytes), each once. A content that
    many versions share is collapsed before the shuffle."""
    return versions.groupBy("_h", "_len").agg(F.first("content").alias("content"))


def content_hits(contents: DataFrame, leak_specs, line_cap: int | None = None) -> DataFrame:
    """Secret hits of addressed contents: every content is matched once, however many versions have it."""
    f = contents.select("_h", "_len", "content", F.lit(None).cast("string").alias("language"), F.lit(True).alias("leak_ok"))
    return match_files(f, None, leak_specs, ["_h", "_len"], with_snippet=False, leak_line_cap=line_cap)


def history_scan(blobs: DataFrame, rules: DataFrame | None = None, max_commits: int | None = None,
                 max_bytes: int | None = None, min_entropy: float = ENTROPY_MIN, line_cap: int | None = None) -> DataFrame:
    """Every version of every file: one finding per (rule, path, line, match),
    credited to the first commit, dedup applied before the entropy gate.
    ``commit_hash`` is whole, ``commit_short`` its first eight characters.
    The limits are off unless given.

    Versions are addressed by content: distinct contents are scanned once and
    their hits go to the (repository, path) pairs that have them, each with
    the first commit of that content, so work on contents grows with what is
    new in a history, not with its commits."""
    cat = Catalog(blobs.sparkSession, leak_rules=rules, sast=False)
    ok = ~is_binary(F.col("content"))
    if max_bytes is not None:
        ok = ok & (F.octet_length("content") <= max_bytes)
    versions = drop_media_extensions(blobs).where(ok)
    if max_commits is not None:
        versions = versions.join(_commit_threshold(blobs, max_commits), "repo").where(F.struct("commit_seq", "commit_hash") >= F.col("_min_commit"))
    address = [F.sha2(F.col("content").cast("binary"), 256).alias("_h"), F.octet_length("content").alias("_len")]
    versions = versions.select("repo", "path", "commit_seq", "commit_hash", "content", *address)
    first = versions.groupBy("_h", "_len", "repo", "path").agg(F.min(F.struct("commit_seq", "commit_hash")).alias("_c"))
    first = first.select("_h", "_len", "repo", "path", "_c.commit_seq", "_c.commit_hash")
    found = content_hits(distinct_contents(versions), cat.leak_specs, line_cap)
    hits = history_dedup(found.join(first, ["_h", "_len"]))
    out = leak_findings_from_hits(hits, cat.df(), min_entropy, extra_cols=("commit_hash_full",))
    return (out.withColumn("in_git_history", F.lit(True)).withColumn("commit_hash", F.col("commit_hash_full"))
            .withColumn("commit_short", F.col("commit_hash_full").substr(1, 8)).drop("commit_hash_full"))


def history_dedup(hits: DataFrame) -> DataFrame:
    """Keep the first commit's hit per (repo, rule, path, line, match). An
    aggregation (``min_by``) rather than a window: partial aggregation
    collapses a secret repeated in many commits map-side."""
    first = F.min_by(F.struct("commit_hash", "engine", "col"), F.struct("commit_seq", "commit_hash"))
    out = hits.groupBy("repo", "k", "path", "line_no", "m").agg(first.alias("_f"))
    return out.select("repo", "k", "path", "line_no", F.col("_f.engine").alias("engine"),
                      F.col("_f.col").alias("col"), "m", F.col("_f.commit_hash").alias("commit_hash_full"))
