"""JSON and SARIF reports: one document per scan, written line by line.

A document is emitted as ordered lines (head, one line per finding, foot) and
the lines of a repository are brought together and sorted, so a report of any
size is streamed to its file: no finding is collected into an array or on the
driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.functions.text import relative_path, sarif_level
from scanforge.sources.tree import local_root, write_lines

TOOL_NAME = "scanforge"
TOOL_VERSION = "0.1.0"
TOOL_URI = "https://example.invalid/scanforge"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

# (JSON name, finding column, value when NULL; None: the field is left out when empty)
SAST_JSON = [("id", "finding_id", ""), ("type", "engine", ""), ("language", "language", ""), ("severity", "severity", ""), ("title", "title", ""),
             ("description", "description", ""), ("file", "file", ""), ("line", "line", 0), ("column", "column", 0), ("code", "code", ""),
             ("rule_id", "rule_id", ""), ("owasp", "owasp", ""), ("cwe", "cwe", ""), ("cvss", "cvss", 0.0), ("references", "references", None),
             ("remediation", "remediation", ""), ("ai_remediation", "ai_remediation", None), ("false_positive", "false_positive", False)]
SCA_JSON = [("package_name", "package_name", ""), ("package_version", "package_version", ""), ("fixed_version", "fixed_version", None),
            ("ecosystem", "ecosystem", ""), ("manifest_file", "file", ""), ("severity", "severity", ""), ("cve", "cve", ""), ("cvss", "cvss", 0.0),
            ("description", "description", ""), ("advisory_url", "advisory_url", ""), ("owasp", "owasp", "")]
LEAK_JSON = [("type", "title", ""), ("file", "file", ""), ("line", "line", 0), ("match", "match", ""), ("rule_id", "rule_id", ""),
             ("severity", "severity", ""), ("description", "description", ""), ("entropy", "entropy", None), ("in_git_history", "in_git_history", None),
             ("commit_hash", "commit_hash", None), ("ai_remediation", "ai_remediation", None)]
SECTIONS = [("sast_findings", "SAST", SAST_JSON), ("sca_findings", "SCA", SCA_JSON), ("leak_findings", "Leaks", LEAK_JSON)]
_EMPTY = {"entropy": 0.0, "in_git_history": False, "references": None}


def _object(fields) -> Column:
    cols = []
    for name, column, default in fields:
        c = F.col(column)
        if default is None:  # left out when empty (NULL fields are not written)
            empty = _EMPTY.get(column, "")
            c = c if empty is None else F.when(c != F.lit(empty), c)
        else:
            c = F.coalesce(c, F.lit(default))
        cols.append(c.alias(name))
    return F.to_json(F.struct(*cols))


def _lines(repos: DataFrame, items: DataFrame, order: list, head: Column, between: dict[int, str], foot: str) -> DataFrame:
    """(repo, _part, _n, value): head, the items of each part with commas, the text between the parts, foot.

    ``items`` has repo, _part (from 1), value and the order columns; ``between``
    gives the text in front of each part."""
    w = Window.partitionBy("repo", "_part").orderBy(*order)
    rows = items.withColumn("_n", F.row_number().over(w).cast("long"))
    rows = rows.select("repo", "_part", "_n", F.when(F.col("_n") == 1, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    fixed = [F.struct(F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_n"), head.alias("value")),
             *[F.struct(F.lit(k).alias("_part"), F.lit(0).cast("long").alias("_n"), F.lit(text).alias("value")) for k, text in between.items()],
             F.struct(F.lit(max(between) + 1).alias("_part"), F.lit(0).cast("long").alias("_n"), F.lit(foot).alias("value"))]
    frame = repos.select("repo", F.explode(F.array(*fixed)).alias("_f")).select("repo", "_f.*")
    return rows.unionByName(frame)


def _write_lines(lines: DataFrame, out_dir: str, mode: str, keys: list[str]) -> None:
    (lines.repartition(*keys).sortWithinPartitions(*keys, "_part", "_n").select(*keys, "value")
     .write.mode(mode).partitionBy(*keys).text(out_dir))


_FINDING_ORDER = ["file", "line", "rule_id", "value"]


def json_lines(findings: DataFrame, stats: DataFrame, scan_time=None, duration: str = "0s") -> DataFrame:
    """Ordered lines of the JSON documents: version, time, target, stats and the three finding arrays."""
    # UTC wall time, independent of the session time zone
    utc = (F.lit(scan_time).cast("timestamp_ntz") if scan_time is not None
           else F.convert_timezone(None, F.lit("UTC"), F.current_timestamp()))
    ts = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stat_cols = [c for c in stats.columns if c != "repo"]
    doc = F.to_json(F.struct(F.lit(TOOL_VERSION).alias("version"), ts.alias("scan_time"), F.lit(duration).alias("duration"),
                             F.col("repo").alias("target"), F.struct(*stat_cols).alias("stats")))
    head = F.substring(doc, 1, F.length(doc) - 1)
    engine = F.col("engine")
    value, part = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (_, name, fields) in enumerate(SECTIONS, 1):
        value, part = F.when(engine == name, _object(fields)).otherwise(value), F.when(engine == name, F.lit(k)).otherwise(part)
    items = findings.select("repo", "file", "line", "rule_id", part.alias("_part"), value.alias("value"))
    between = {k: ("," if k == 1 else "],") + f'"{name}":[' for k, (name, _, _) in enumerate(SECTIONS, 1)}
    return _lines(stats, items, _FINDING_ORDER, head, between, "]}")


def write_json(findings: DataFrame, stats: DataFrame, out_dir: str, mode: str = "overwrite", scan_time=None, duration: str = "0s") -> None:
    """One JSON document per repository below ``out_dir/repo=...``; repositories without findings (in ``stats`` only) get theirs too."""
    _write_lines(json_lines(findings, stats, scan_time, duration), out_dir, mode, ["repo"])


def sarif_results(findings: DataFrame, root: str = "") -> DataFrame:
    """SARIF result objects: SAST and secret findings (dependency findings are
    not part of SARIF); column only for SAST."""
    f = findings.where(F.col("engine").isin("SAST", "Leaks"))
    sast = F.col("engine") == "SAST"
    msg = F.when(sast, F.concat(F.col("title"), F.lit(" - "), F.coalesce(F.col("remediation"), F.lit(""))))\
        .otherwise(F.concat(F.lit("Secret detected: "), F.col("title")))
    region = F.struct(F.col("line").alias("startLine"), F.when(sast, F.col("column")).alias("startColumn"))
    loc = F.struct(F.struct(F.struct(relative_path(F.col("file"), root).alias("uri")).alias("artifactLocation"),
                            region.alias("region")).alias("physicalLocation"))
    res = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
                   F.struct(msg.alias("text")).alias("message"), F.array(loc).alias("locations"))
    return f.select("repo", "engine", "file", "line", "rule_id", F.to_json(res).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules per scan (repo, engine, rule_id, value), first occurrence
    wins, SAST before secrets. An aggregation per (scan, rule): bounded by the
    rule catalog."""
    f = findings.where(F.col("engine").isin("SAST", "Leaks"))
    sast = F.col("engine") == "SAST"
    # fields that are NULL are not written: a secret's properties hold the severity only
    props = F.struct("severity", F.when(sast, F.col("owasp")).alias("owasp"), F.when(sast, F.col("cwe")).alias("cwe"), F.when(sast, F.col("cvss")).alias("cvss"))
    rule = F.struct(F.col("rule_id").alias("id"), F.regexp_replace("title", " ", "").alias("name"),
                    F.struct(F.col("title").alias("text")).alias("shortDescription"),
                    F.struct(F.col("description").alias("text")).alias("fullDescription"), props.alias("properties"))
    first = F.min_by(F.struct("engine", F.to_json(rule).alias("value")), F.struct(F.when(sast, 0).otherwise(1), F.col("file"), F.col("line")))
    return f.groupBy("repo", "rule_id").agg(first.alias("_r")).select("repo", "rule_id", "_r.engine", "_r.value")


def sarif_lines(findings: DataFrame, repos: DataFrame | None = None, root: str = "") -> DataFrame:
    """Ordered lines of the SARIF documents (one run each). ``repos`` adds scans without findings."""
    order = F.when(F.col("engine") == "SAST", 0).otherwise(1).alias("_e")
    rules = sarif_rules(findings).select("repo", F.lit(1).alias("_part"), order, F.lit("").alias("file"), F.lit(0).alias("line"), "rule_id", "value")
    results = sarif_results(findings, root).select("repo", F.lit(2).alias("_part"), order, "file", "line", "rule_id", "value")
    scans = (repos if repos is not None else findings).select("repo").distinct()
    head = F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version")))
    head = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"runs":[{"tool":{"driver":'))
    tool = F.to_json(F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(TOOL_VERSION).alias("version"), F.lit(TOOL_URI).alias("informationUri")))
    head = F.concat(head, F.substring(tool, 1, F.length(tool) - 1))
    return _lines(scans, rules.unionByName(results), ["_e", *_FINDING_ORDER], head, {1: ',"rules":[', 2: ']}},"results":['}, "]}]}")


def write_sarif(findings: DataFrame, out_dir: str, root: str = "", mode: str = "overwrite", repos: DataFrame | None = None) -> None:
    """One SARIF document per repository below ``out_dir/repo=...``."""
    _write_lines(sarif_lines(findings, repos, root), out_dir, mode, ["repo"])


def stamped_name(base: str, branch, scan_ts) -> Column:
    """``base_branch_yyyyMMdd-HHmmss.ext`` for a report file name."""
    stem, ext = os.path.splitext(base)
    return F.concat(F.lit(stem + "_"), branch, F.lit("_"), F.date_format(scan_ts, "yyyyMMdd-HHmmss"), F.lit(ext))


def stamped_output(findings: DataFrame, out_dir: str, base: str = "report.json", mode: str = "append") -> None:
    """Findings as JSON lines in one folder per scan, named
    ``report=<stamped name>``; a later scan never overwrites it."""
    named = findings.withColumn("report", stamped_name(base, F.col("branch"), F.col("scan_ts")))
    folder = local_root(out_dir)
    if folder is not None and mode == "append":  # a folder a report: tasks write the files themselves
        line = F.to_json(F.struct(*[c for c in named.columns if c not in ("repo", "report")]))
        write_lines(named.select("repo", "report", line.alias("_line")), folder, ["repo", "report"], ".json")
        return
    named.repartition("repo", "report").write.mode(mode).partitionBy("repo", "report").json(out_dir)
