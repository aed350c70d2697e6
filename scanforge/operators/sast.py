"""SAST / infrastructure rule matching and SAST findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.constants import IAC_EXTENSION_LANGUAGE
from scanforge.functions.text import base_name
from scanforge.operators.catalog import Catalog
from scanforge.operators.findings import min_severity as _min_severity
from scanforge.operators.matching import (Rule, explode_hits, explode_lines, lower_for_hints, match_files,
                                          sast_hits_expr, sast_line, snippet_of)
from scanforge.sources.files import detect_language, ignore_paths, language_of


def match_rules(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """lines(…, language, line_no, line) x rules -> hits (…, rule_id, column).

    A rule applies when its language equals the file's or is Generic, its
    pattern occurs in the line and its anti-pattern (if any) does not."""
    cat = Catalog(lines.sparkSession, sast_rules=rules, leaks=False)
    line = sast_line(F.col("line"))
    pre = lines.select("*", lower_for_hints(F.col("line")).alias("_lc"), line.alias("_sline"))
    hits = explode_hits(pre, sast_hits_expr(cat.sast_specs, "_sline", "_lc", "language"), "_sline", [F.col(f"`{c}`") for c in lines.columns] + ["_sline"])
    hits = hits.where(F.col("_h").isNotNull() & (F.col("_h.pos") > 0))
    hits = hits.join(cat.df().select("k", "rule_id"), F.col("_h.k") == F.col("k"))
    col = F.octet_length(F.col("_sline").substr(F.lit(1), F.col("_h.pos") - 1)) + 1
    return hits.withColumn("column", col).drop("_sline", "_h", "k")


def finding_id(rule_id, path, line_no):
    return F.concat_ws("-", rule_id, base_name(path), line_no.cast("string"))


def sast_findings_from_hits(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    j = hits.where(F.col("engine") == "sast").join(catalog, "k")
    return j.select(
        "repo",
        F.lit("SAST").alias("engine"),
        finding_id(F.col("rule_id"), F.col("path"), F.col("line_no")).alias("finding_id"),
        "rule_id", "severity", "title", "description",
        F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("col").alias("column"),
        "code", "language", "owasp", "cwe", "cvss", "references", "remediation",
        F.lit("").alias("ai_remediation"), F.lit(False).alias("false_positive"),
    )


def sast_scan(files: DataFrame, rules: DataFrame | None = None, min_severity: str = "LOW",
              extension_map: dict | None = None, extra_ignores=(), overlong_limit: int | None = None,
              max_line_bytes: int | None = None) -> DataFrame:
    """files(repo, path, content) -> SAST findings.

    One narrow stage: language lookup (literal map), split + explode, literal
    regex arrays per language, then a broadcast join with the rule catalog."""
    spark = files.sparkSession
    cat = Catalog(spark, sast_rules=rules, leaks=False)
    f = ignore_paths(files, extra_ignores)
    f = detect_language(f, extension_map).where(F.col("language").isNotNull())
    f = f.select("repo", "path", "content", "language", F.lit(False).alias("leak_ok"))
    hits = match_files(f, cat.sast_specs, None, ["repo", "path", "language"], overlong_limit=overlong_limit,
                       sast_max_line_bytes=max_line_bytes)
    return _min_severity(sast_findings_from_hits(hits, cat.df()), min_severity)


def iac_scan(files: DataFrame, rules: DataFrame | None = None, min_severity: str = "LOW") -> DataFrame:
    """Terraform and Kubernetes rules; YAML manifests map to Kubernetes here."""
    spark = files.sparkSession
    from scanforge.operators.rules import builtin_rules
    r = rules if rules is not None else builtin_rules(spark)
    r = r.where(F.col("language").isin("Terraform", "Kubernetes"))
    lang = language_of(F.col("path"), IAC_EXTENSION_LANGUAGE)
    f = files.where(lang.isin("Terraform", "Kubernetes"))
    return sast_scan(f, r, min_severity, extension_map=IAC_EXTENSION_LANGUAGE)


def stop_at_overlong_line(files: DataFrame, limit: int = 65536, content_col: str = "content") -> DataFrame:
    """files -> lines before the first line of >= ``limit`` bytes. The cut is
    found in the file's own row, before the lines are exploded: no shuffle."""
    arr = F.split(F.col(content_col), "\n", -1)
    cut = F.array_position(F.transform(arr, lambda x: F.octet_length(x) >= limit), True)
    kept = F.when(cut > 0, F.slice(arr, 1, (cut - 1).cast("int"))).otherwise(arr)
    others = [F.col(c) for c in files.columns if c != content_col]
    out = files.select(*others, F.posexplode(kept).alias("_pos", "line"))
    return out.withColumn("line_no", (F.col("_pos") + 1).cast("int")).drop("_pos")


__all__ = ["match_rules", "sast_scan", "iac_scan", "finding_id", "stop_at_overlong_line",
           "explode_lines", "snippet_of", "Rule"]
