from pyspark.sql import functions as F

from scanforge.operators.findings import finding_stats, gate, verdict
from scanforge.operators.rules import normalize_rules
from tests.conftest import files_df


def test_stats_verdict_gate(spark):
    rows = [("r1", "SAST", "HIGH"), ("r1", "Leaks", "INFO"), ("r1", "SCA", "WEIRD"), ("r2", "SAST", "LOW"),
            ("r3", "Leaks", "CRITICAL")]
    f = spark.createDataFrame(rows, "repo string, engine string, severity string")
    st = {r.repo: r for r in verdict(finding_stats(f)).collect()}
    assert (st["r1"].total_findings, st["r1"].high, st["r1"].info, st["r1"].sca_count) == (3, 1, 2, 1)
    assert (st["r1"].verdict, st["r2"].verdict, st["r3"].verdict) == ("high", "low/medium", "critical")
    assert {r.repo: r.failed for r in gate(finding_stats(f)).collect()} == {"r1": True, "r2": False, "r3": True}


def test_verdict_clean(spark):
    st = spark.createDataFrame([("r", 0, 0, 0)], "repo string, total_findings int, critical int, high int")
    assert verdict(st).collect()[0].verdict == "clean"


def test_normalize_rules(spark):
    raw = spark.createDataFrame([("a", "golang", "info", "A08:2025"), ("b", "COBOL", "", "see A10 and A01"),
                                 ("c", "K8s", "critical", "custom")],
                                "rule_id string, language string, severity string, owasp string")
    got = {r.rule_id: (r.language, r.severity, r.owasp) for r in normalize_rules(raw).collect()}
    assert got["a"] == ("Go", "MEDIUM", "A08:2025 - Software or Data Integrity Failures")
    assert got["b"] == ("Generic", "MEDIUM", "A01:2025 - Broken Access Control")   # first code in order A01..A10
    assert got["c"] == ("Kubernetes", "CRITICAL", "custom")


def test_stop_at_overlong_line_standalone(spark):
    from scanforge.operators.sast import stop_at_overlong_line
    files = files_df(spark, [("a", "x\n" + "y" * 50 + "\nz"), ("b", "ok")])
    kept = sorted((r.path, r.line_no) for r in stop_at_overlong_line(files, limit=50).collect())
    assert kept == [("a", 1), ("b", 1)]


def test_levels_and_weights(spark):
    from scanforge.functions.text import sarif_level, severity_weight
    sev = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "other", None]
    df = spark.createDataFrame([(s,) for s in sev], "s string")
    rows = df.select(sarif_level("s").alias("l"), severity_weight("s").alias("w")).collect()
    assert [r.l for r in rows] == ["error", "error", "warning", "note", "note", "note", "note"]
    assert [r.w for r in rows] == [4, 3, 2, 1, 0, 0, 0]
