"""Rule tables as DataFrames: built-ins, normalisation, merging, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanforge.constants import LANGUAGE_ALIASES
from scanforge.functions.regex import literal_hints, to_java
from scanforge.operators.rule_hints import HINTS
from scanforge.operators.rules_data import LEAK_RULES, OWASP_NAMES, SAST_RULES

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("language", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("anti_pattern", T.StringType(), True),
    T.StructField("severity", T.StringType(), False),
    T.StructField("owasp", T.StringType(), True),
    T.StructField("cwe", T.StringType(), True),
    T.StructField("cvss", T.DoubleType(), True),
    T.StructField("references", T.ArrayType(T.StringType()), True),
    T.StructField("remediation", T.StringType(), True),
    T.StructField("hints", T.ArrayType(T.StringType()), True),
    T.StructField("rule_source", T.StringType(), False),
    T.StructField("rule_ord", T.IntegerType(), False),
])

LEAK_RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("hints", T.ArrayType(T.StringType()), True),
    T.StructField("rule_ord", T.IntegerType(), False),
])


def builtin_rule_rows() -> list[tuple]:
    rows = []
    for i, (rid, lang, sev, ow, cwe, cvss, title, pat, anti, desc, rem, refs) in enumerate(SAST_RULES):
        hints = HINTS.get(rid)
        rows.append((rid, lang, title, desc, pat, anti, sev, OWASP_NAMES[ow], cwe, float(cvss),
                     list(refs), rem, list(hints) if hints else None, "builtin", i))
    return rows


def leak_rule_rows() -> list[tuple]:
    rows = []
    for i, (rid, name, sev, conf, pat, desc) in enumerate(LEAK_RULES):
        hints = HINTS.get(rid)
        rows.append((rid, name, pat, sev, desc, conf, list(hints) if hints else None, i))
    return rows


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The 102 built-in SAST / infrastructure rules (a small broadcastable table)."""
    return spark.createDataFrame(builtin_rule_rows(), RULE_SCHEMA)


def leak_rules(spark: SparkSession) -> DataFrame:
    """The 35 built-in secret rules."""
    return spark.createDataFrame(leak_rule_rows(), LEAK_RULE_SCHEMA)


def _alias_map():
    return F.create_map(*[x for k, v in LANGUAGE_ALIASES.items() for x in (F.lit(k), F.lit(v))])


def normalize_language(c) -> "F.Column":
    return F.coalesce(F.element_at(_alias_map(), F.lower(c)), F.lit("Generic"))


def normalize_severity(c) -> "F.Column":
    u = F.upper(F.coalesce(c, F.lit("")))
    return F.when(u.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), u).otherwise(F.lit("MEDIUM"))


def normalize_owasp(c) -> "F.Column":
    s = F.coalesce(c, F.lit(""))
    out = s
    for code in reversed(sorted(OWASP_NAMES)):
        out = F.when(s.contains(code), F.lit(OWASP_NAMES[code])).otherwise(out)
    return out


def normalize_rules(raw: DataFrame) -> DataFrame:
    """Apply the rule-file aliases: language (unknown -> Generic), severity
    (unknown, and INFO, -> MEDIUM), OWASP by code substring A01..A10 (first
    match in that order, else verbatim)."""
    cols = raw.columns
    out = raw.withColumn("language", normalize_language(F.col("language")))
    out = out.withColumn("severity", normalize_severity(F.col("severity")))
    out = out.withColumn("owasp", normalize_owasp(F.col("owasp")))
    return out.select(*cols)


def merge_rules(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in rules followed by custom ones; duplicate ids are kept (both fire)."""
    n = len(SAST_RULES)
    custom = custom.withColumn("rule_ord", F.col("rule_ord") + F.lit(n))
    return builtin.unionByName(custom, allowMissingColumns=True)


def rules_by_language(rules: DataFrame) -> DataFrame:
    """Rule count per language, plus a total row (language NULL -> 'TOTAL')."""
    g = rules.rollup("language").agg(F.count(F.lit(1)).alias("n_rules"))
    return g.select(F.coalesce(F.col("language"), F.lit("TOTAL")).alias("language"), "n_rules")


def rules_by_owasp(rules: DataFrame) -> DataFrame:
    return rules.groupBy("owasp").agg(F.count(F.lit(1)).alias("n_rules"))


def load_rules(spark: SparkSession, rules_dir: str, max_bytes: int | None = None):
    """Load YAML rule files under ``rules_dir`` (recursively; .yaml/.yml only).

    Returns ``(rules, errors)``. Files are read by ``binaryFile`` and parsed in
    the executors with PyYAML via ``mapInPandas``. Each entry needs an id and a
    pattern that RE2 has and whose translation java.util.regex compiles; that
    is tried here, on the driver, where the rules go anyway. Bad entries become
    rows of ``errors`` and the rest are used. ``max_bytes`` leaves larger files
    out (also a row of ``errors``). Hints are read off the patterns.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .load(rules_dir)
             .select("path", "length", "content"))
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1))
    files = files.where(ext.isin(".yaml", ".yml"))
    cap = (1 << 62) if max_bytes is None else max_bytes
    too_big = files.where(F.col("length") > cap).select(
        "path", F.lit(None).cast("string").alias("rule_id"),
        F.format_string("rule file exceeds %d bytes (got %d)", F.lit(cap), F.col("length")).alias("error"))
    ok = files.where(F.col("length") <= cap).select("path", "content")

    out_schema = ("path string, rule_id string, language string, title string, description string, "
                  "pattern string, severity string, owasp string, cwe string, cvss double, "
                  "references array<string>, remediation string, error string, entry_ord int")

    def parse(batches):
        import pandas as pd
        import yaml
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
                    doc = yaml.load(bytes(content).decode("utf-8"), Loader=loader) or {}
                    entries = doc.get("rules") or [] if isinstance(doc, dict) else []
                except Exception as e:  # noqa: BLE001 - reported as a row
                    out.append((path, None, None, None, None, None, None, None, None, None, None, None,
                                f"parse: {e}".splitlines()[0], -1))
                    continue
                for k, e in enumerate(entries):
                    e = e if isinstance(e, dict) else {}
                    rid = str(e.get("id") or "")
                    pat = str(e.get("pattern") or "")
                    err = None
                    if not rid:
                        err = "missing id"
                    elif not pat:
                        err = "missing pattern"
                    refs = e.get("references")
                    try:
                        cvss = float(e.get("cvss") or 0.0)
                    except (TypeError, ValueError):
                        cvss = 0.0
                    out.append((path, rid or None, str(e.get("language") or ""), str(e.get("title") or ""),
                                str(e.get("description") or ""), pat, str(e.get("severity") or ""),
                                str(e.get("owasp") or ""), str(e.get("cwe") or ""), cvss,
                                [str(r) for r in refs] if isinstance(refs, list) else None,
                                str(e.get("remediation") or ""), err, k))
            yield pd.DataFrame(out, columns=["path", "rule_id", "language", "title", "description", "pattern",
                                             "severity", "owasp", "cwe", "cvss", "references", "remediation",
                                             "error", "entry_ord"])

    entries = [r.asDict() for r in ok.mapInPandas(parse, out_schema).collect()]  # a rule table, as every scan collects it
    for e in entries:
        if e["error"] is None:
            e["error"] = pattern_error(spark, e["pattern"])
    names = RULE_SCHEMA.fieldNames()
    good = []
    for e in sorted((e for e in entries if e["error"] is None), key=lambda e: (e["path"], e["entry_ord"])):
        row = {**e, "anti_pattern": None, "hints": literal_hints(e["pattern"]), "rule_source": "custom", "rule_ord": len(good)}
        good.append(tuple(row[n] for n in names))
    errors = spark.createDataFrame([(e["path"], e["rule_id"], e["error"]) for e in entries if e["error"] is not None],
                                   "path string, rule_id string, error string").unionByName(too_big)
    return normalize_rules(spark.createDataFrame(good, RULE_SCHEMA)), errors


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern can't be used: not RE2, or its translation does not compile."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(to_java(pattern))
    except Exception as ex:  # noqa: BLE001 - one rule must not end the load
        text = str(getattr(ex, "java_exception", None) or ex).splitlines()[0]
        return f"invalid pattern {pattern!r}: {text}"
    return None
