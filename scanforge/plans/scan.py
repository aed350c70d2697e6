"""The flagship scan: files -> all enabled engines -> unified findings.

Plan shape (per file split): scan -> admission filters -> split + explode ->
literal-prefiltered regex arrays for the file's language and for secrets ->
explode hits -> broadcast join with the rule catalog -> one projection into
the unified finding schema. SAST and secret hits come out of the same pass,
so the expensive part runs once; manifests are parsed where they are split,
and their dependencies travel through the same rows to the advisory join: the
files are read once for all engines. Statistics are a grouped aggregation with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.constants import ENTROPY_MIN, EXTENSION_LANGUAGE, LEAK_ONLY_EXTENSIONS
from scanforge.functions.text import extension, redact, severity_weight, shannon_entropy
from scanforge.operators.catalog import Catalog
from scanforge.operators.findings import FINDING_COLUMNS, combine_findings, conform
from scanforge.operators.matching import match_files
from scanforge.operators.sast import finding_id
from scanforge.operators.sca import (ADVISORY_URL, SUPPLY_CHAIN, advisory_intervals, affected, dependency_array, ecosystem_of, is_manifest,
                                     known_affected, manifest_format, sca_scan)
from scanforge.operators.secrets import downgrade_by_patterns, history_scan
from scanforge.sources.files import binary_flag, ignored_path, language_of

SEVERITY_MIN = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def prepare_files(files: DataFrame, sast: bool = True, leaks: bool = True, extra_ignores=(),
                  languages=None, leak_max_bytes: int | None = None,
                  extension_map: dict | None = None, manifests: bool = False) -> DataFrame:
    """Admission: ignored paths out; known extension (or config extension with
    secret scanning on); SAST language; secret-scan eligibility. With
    ``manifests`` those stay too, and ``_fmt`` names their format (NULL: none)."""
    ext = extension(F.col("path"))
    m = extension_map or EXTENSION_LANGUAGE
    admitted = ext.isin(*m.keys())
    if leaks:
        admitted = admitted | ext.isin(*LEAK_ONLY_EXTENSIONS)
    admitted = admitted & ~ignored_path(extra_ignores)
    also = []
    if manifests:
        fmt = F.when(is_manifest(extra_ignores), manifest_format("path"))
        f = files.where(admitted | fmt.isNotNull())
        also = [fmt.alias("_fmt")]
    else:
        f = files.where(admitted)
    lang = language_of(F.col("path"), m) if sast else F.lit(None).cast("string")
    if sast and languages:
        lang = F.when(lang.isin(*languages), lang)
    leak_ok = ~binary_flag(files) if leaks else F.lit(False)
    if leaks and leak_max_bytes is not None:
        leak_ok = leak_ok & ((F.col("size") if "size" in files.columns else F.octet_length("content")) <= leak_max_bytes)
    if manifests:  # a manifest may be none of the code engines' files
        lang, leak_ok = F.when(admitted, lang), F.coalesce(admitted & leak_ok, F.lit(False))
    return f.select("repo", "path", "content", lang.alias("language"), leak_ok.alias("leak_ok"), *also)


def code_findings(files: DataFrame, sast_rules: DataFrame | None = None, leak_rules: DataFrame | None = None,
                  sast: bool = True, leaks: bool = True, min_severity: str = "LOW",
                  patterns: DataFrame | None = None, extra_ignores=(), languages=None,
                  min_entropy: float = ENTROPY_MIN, overlong_limit: int | None = None,
                  leak_max_bytes: int | None = None, leak_line_cap: int | None = None,
                  sast_max_line_bytes: int | None = None, rule_language_aliases: dict | None = None) -> DataFrame:
    """SAST and secret findings of a file table, from one matching pass."""
    return _findings(files, sast_rules, leak_rules, sast, leaks, False, None, min_severity, patterns, extra_ignores, languages, min_entropy,
                     overlong_limit, leak_max_bytes, leak_line_cap, sast_max_line_bytes, rule_language_aliases)


def _findings(files, sast_rules, leak_rules, sast, leaks, sca, advisories, min_severity, patterns, extra_ignores, languages, min_entropy,
              overlong_limit=None, leak_max_bytes=None, leak_line_cap=None, sast_max_line_bytes=None, rule_language_aliases=None) -> DataFrame:
    """Findings of the code engines and, with ``sca``, of the dependencies: one row per hit or dependency leaves
    the contents, meets the rule catalog, then the advisories. No second branch reads the files."""
    spark = files.sparkSession
    cat = Catalog(spark, sast_rules, leak_rules, sast=sast, leaks=leaks)
    f = prepare_files(files, sast, leaks, extra_ignores, languages, leak_max_bytes, manifests=sca)
    sel_col = "language"
    if rule_language_aliases:
        # e.g. {"TypeScript": "JavaScript"}: which rules a file gets; findings
        # keep the file's own language
        sel = F.col("language")
        for src, dst in rule_language_aliases.items():
            sel = F.when(F.col("language") == src, F.lit(dst)).otherwise(sel)
        f = f.withColumn("_sel_lang", sel)
        sel_col = "_sel_lang"
    hits = match_files(f, cat.sast_specs, cat.leak_specs, ["repo", "path", "language"],
                       overlong_limit=overlong_limit, leak_line_cap=leak_line_cap, sast_max_line_bytes=sast_max_line_bytes,
                       rule_language_col=sel_col, deps=dependency_array() if sca else None)
    j = hits.join(cat.df().drop("engine"), "k", "left" if sca else "inner")
    is_sast = F.col("engine") == "sast"
    gated = F.coalesce(F.col("entropy_gated"), F.lit(False))
    ent = F.when(is_sast, F.lit(None).cast("double")).when(gated, shannon_entropy(F.col("m"))).otherwise(F.lit(0.0))
    j = j.withColumn("entropy", ent)
    keep = ((is_sast & (severity_weight(F.col("severity")) >= SEVERITY_MIN.get(min_severity.upper(), 0)))
            | (~is_sast & (~gated | (F.col("entropy") >= min_entropy))))
    j = j.where(keep)
    if sca:
        return _with_dependencies(j, advisories, min_severity, patterns if leaks else None)
    out = conform(j.select(*_code_columns(is_sast)))
    return conform(downgrade_by_patterns(out, patterns)) if leaks else out


def _with_dependencies(rows: DataFrame, advisories: DataFrame | None, min_severity: str, patterns: DataFrame | None) -> DataFrame:
    """Rule hits and dependency rows -> findings; a dependency that no advisory names leaves."""
    is_dep = F.col("engine") == "dep"
    rows = rows.withColumn("dep_ecosystem", F.when(is_dep, ecosystem_of("path")))
    if advisories is None:
        j = known_affected(rows, "dep_name", "dep_version", outer=True)
    else:
        j = affected(rows, advisory_intervals(advisories), "dep_name", "dep_version", "dep_ecosystem", ["repo", "path", "line_no", "k", "dep_version"], outer=True)
    j = j.where(~is_dep | F.col("_adv").isNotNull() & (severity_weight(F.col("_adv.severity")) >= SEVERITY_MIN.get(min_severity.upper(), 0)))
    sca = {"engine": F.lit("SCA"), "file": F.col("path"), "package_name": F.col("dep_name"), "package_version": F.col("dep_version"),
           "fixed_version": F.col("_adv.fixed_version"), "ecosystem": F.col("dep_ecosystem"), "severity": F.col("_adv.severity"),
           "cve": F.col("_adv.cve"), "cvss": F.col("_adv.cvss"), "description": F.col("_adv.description"),
           "advisory_url": F.concat(F.lit(ADVISORY_URL), F.col("_adv.adv_id")), "owasp": F.lit(SUPPLY_CHAIN),
           "rule_id": F.col("_adv.cve"), "title": F.col("dep_name")}
    code = j.select("*", F.struct(*_code_columns(F.col("engine") == "sast")).alias("_c"))
    has = set(code.schema["_c"].dataType.names)
    cols = []
    for name, kind in FINDING_COLUMNS:
        own = F.col("_c")[name] if name in has else F.lit(None)
        own = F.col("repo") if name == "repo" else F.when(is_dep, sca.get(name, F.lit(None))).otherwise(own)
        cols.append(own.cast(kind).alias(name))
    out = code.select(*cols)
    return conform(downgrade_by_patterns(out, patterns)) if patterns is not None else out


def _code_columns(is_sast: Column) -> list[Column | str]:
    """The finding columns of a rule hit with its catalog row."""
    return [
        "repo",
        F.when(is_sast, F.lit("SAST")).otherwise(F.lit("Leaks")).alias("engine"),
        F.when(is_sast, finding_id(F.col("rule_id"), F.col("path"), F.col("line_no"))).alias("finding_id"),
        "rule_id", "severity", "title", "description",
        F.col("path").alias("file"), F.col("line_no").alias("line"), F.col("col").alias("column"), "code",
        F.when(is_sast, F.col("language")).alias("language"),
        "owasp", "cwe", "cvss", "references", "remediation",
        F.when(~is_sast, redact(F.col("m"))).alias("match"),
        F.when(~is_sast, F.round("entropy", 6)).alias("entropy"),
        F.when(~is_sast, F.lit(False)).alias("in_git_history"),
        F.lit("").alias("ai_remediation"),
        F.when(is_sast, F.lit(False)).alias("false_positive"),
    ]


def scan(files: DataFrame, sast_rules: DataFrame | None = None, leak_rules: DataFrame | None = None,
         enable_sast: bool = True, enable_leaks: bool = True, enable_sca: bool = True,
         min_severity: str = "LOW", patterns: DataFrame | None = None, advisories: DataFrame | None = None,
         extra_ignores=(), languages=None, sast_max_line_bytes: int | None = None,
         min_entropy: float = ENTROPY_MIN, rule_language_aliases: dict | None = None,
         blobs: DataFrame | None = None) -> DataFrame:
    """Flagship: every enabled engine over a file table -> unified findings.

    Engines that are off are simply not part of the plan. ``blobs`` (file
    versions over commits) adds the findings of the history. ``languages``
    restricts SAST to those languages, ``extra_ignores`` adds ignored path
    names, ``min_entropy`` sets the secret entropy gate: settings the
    original tool documents but does not apply are real parameters here."""
    parts = []
    code = enable_sast or enable_leaks
    if code and enable_sca:  # one read of the files for all engines
        parts.append(_findings(files, sast_rules, leak_rules, enable_sast, enable_leaks, True, advisories, min_severity, patterns,
                               extra_ignores, languages, min_entropy, sast_max_line_bytes=sast_max_line_bytes,
                               rule_language_aliases=rule_language_aliases))
    elif code:
        parts.append(code_findings(files, sast_rules, leak_rules, enable_sast, enable_leaks, min_severity,
                                   patterns, extra_ignores, languages, min_entropy=min_entropy,
                                   sast_max_line_bytes=sast_max_line_bytes,
                                   rule_language_aliases=rule_language_aliases))
    if enable_leaks and blobs is not None:
        parts.append(conform(history_scan(blobs, leak_rules, min_entropy=min_entropy)))
    if enable_sca and not code:
        parts.append(sca_scan(files, advisories, min_severity=min_severity, extra_ignores=extra_ignores))
    return combine_findings(*parts)
