"""Findings: unified schema, severity filter, combination, statistics, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.constants import SEVERITIES
from scanforge.functions.text import severity_weight

# Unified finding columns (SAST, Leaks, SCA). Engine-specific columns are
# NULL for other engines.
FINDING_COLUMNS = [
    ("repo", "string"), ("engine", "string"), ("finding_id", "string"), ("rule_id", "string"),
    ("severity", "string"), ("title", "string"), ("description", "string"), ("file", "string"),
    ("line", "int"), ("column", "int"), ("code", "string"), ("language", "string"),
    ("owasp", "string"), ("cwe", "string"), ("cvss", "double"), ("references", "array<string>"),
    ("remediation", "string"), ("match", "string"), ("entropy", "double"),
    ("in_git_history", "boolean"), ("commit_hash", "string"), ("package_name", "string"),
    ("package_version", "string"), ("fixed_version", "string"), ("ecosystem", "string"),
    ("cve", "string"), ("advisory_url", "string"), ("ai_remediation", "string"),
    ("false_positive", "boolean"),
]


def conform(df: DataFrame) -> DataFrame:
    """Select the unified columns (missing ones as typed NULLs)."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FINDING_COLUMNS])


def min_severity(findings: DataFrame, level: str = "LOW", severity_col: str = "severity") -> DataFrame:
    """Keep findings whose severity weight is at least that of ``level``."""
    w = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}.get(level.upper(), 0)
    return findings.where(severity_weight(F.col(severity_col)) >= w)


def combine_findings(*parts: DataFrame) -> DataFrame:
    """One finding table from the engines' tables (union by name)."""
    parts = [p for p in parts if p is not None]
    out = conform(parts[0])
    for p in parts[1:]:
        out = out.unionByName(conform(p))
    return out


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("int")


def finding_stats(findings: DataFrame, group_cols=("repo",)) -> DataFrame:
    """Totals per severity (unknown -> info) and per engine (per repo).

    A grouped aggregation with map-side partial aggregation: the shuffle moves
    one small row per group and map task, whatever the number of findings."""
    sev = F.col("severity")
    eng = F.col("engine")
    aggs = [
        F.count(F.lit(1)).cast("int").alias("total_findings"),
        _count_if(sev == "CRITICAL").alias("critical"),
        _count_if(sev == "HIGH").alias("high"),
        _count_if(sev == "MEDIUM").alias("medium"),
        _count_if(sev == "LOW").alias("low"),
        _count_if(~F.coalesce(sev, F.lit("")).isin(*SEVERITIES[:4])).alias("info"),
        _count_if(eng == "SAST").alias("sast_count"),
        _count_if(eng == "SCA").alias("sca_count"),
        _count_if(eng == "Leaks").alias("leaks_count"),
    ]
    if group_cols:
        return findings.groupBy(*group_cols).agg(*aggs)
    return findings.agg(*aggs)


def verdict(stats: DataFrame) -> DataFrame:
    v = (F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high")
         .when(F.col("total_findings") == 0, "clean").otherwise("low/medium"))
    return stats.withColumn("verdict", v)


def gate(stats: DataFrame) -> DataFrame:
    """Pass/fail per scan: fail when any critical or high finding."""
    keys = [c for c in stats.columns if c in ("repo", "branch", "scan_ts")]
    return stats.select(*keys, ((F.col("critical") > 0) | (F.col("high") > 0)).alias("failed"))
