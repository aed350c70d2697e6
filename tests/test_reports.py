import json

import pytest
from pyspark.sql import functions as F

from scanforge.functions.text import safe_url
from scanforge.plans.scan import scan
from tests.conftest import API_KEY_LINE, files_df


@pytest.mark.parametrize("url,out", [
    ("https://osv.dev/vulnerability/GHSA-xxxx", "https://osv.dev/vulnerability/GHSA-xxxx"),
    ("http://example.com/advisory", "http://example.com/advisory"),
    ("javascript:alert(1)", "#"), ("data:text/html,<script>alert(1)</script>", "#"), ("vbscript:msgbox(1)", "#"),
    ("file:///etc/passwd", "#"), ("JaVaScRiPt:alert(1)", "#"), ("  javascript:alert(1)  ", "#"),
    ("", "#"), ("/path/only", "#"), ("//evil.com/x", "#"),
    ("HTTPS://EXAMPLE.COM", "https://EXAMPLE.COM"), ("  https://padded.example  ", "https://padded.example"),
    ("http://x/%zz", "#"), ("https://x/a?q=100%", "https://x/a?q=100%"), ("https://x/?q=%z#%41", "https://x/?q=%z#%41"), ("https://x/?q#%z", "#"),
])
def test_safe_url(spark, url, out):
    assert spark.createDataFrame([(url,)], "u string").select(safe_url("u")).collect()[0][0] == out


def _read(spark, folder):
    return {r.repo: json.loads(r.value) for r in spark.read.text(str(folder), wholetext=True).collect()}


def _findings(spark):
    rows = [("a.py", "pickle.loads(x)\npickle.loads(y)"), ("b.env", API_KEY_LINE), ("requirements.txt", "django==3.2.12\n")]
    f = scan(files_df(spark, rows))
    return f.unionByName(scan(files_df(spark, [("z.js", 'eval("\\u2028 \\"quoted\\" \n")')], repo="r2/x")))


def test_sarif_documents(spark, tmp_path):
    from scanforge.sinks.reports import write_sarif
    f = _findings(spark)
    empty = spark.createDataFrame([("r",), ("r2/x",), ("none",)], "repo string")
    write_sarif(f, str(tmp_path / "sarif"), repos=empty)
    docs = _read(spark, tmp_path / "sarif")
    assert set(docs) == {"r", "r2/x", "none"} and docs["none"]["runs"][0]["results"] == []
    run = docs["r"]["runs"][0]
    assert docs["r"]["version"] == "2.1.0" and run["tool"]["driver"]["name"] == "scanforge"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["PY-007", "LEAK-121"]   # SAST first
    assert [r["ruleId"] for r in run["results"]] == ["PY-007", "PY-007", "LEAK-121"]
    sast, leak = run["tool"]["driver"]["rules"]
    assert set(sast["properties"]) == {"severity", "owasp", "cwe", "cvss"} and set(leak["properties"]) == {"severity"}
    region = [r["locations"][0]["physicalLocation"]["region"] for r in run["results"]]
    assert region[0] == {"startLine": 1, "startColumn": 1} and set(region[2]) == {"startLine"}


def test_json_documents(spark, tmp_path):
    from scanforge.operators.findings import finding_stats
    from scanforge.sinks.reports import write_json
    f = _findings(spark)
    stats = finding_stats(f)
    write_json(f, stats, str(tmp_path / "json"), scan_time="2026-01-01 00:00:00", duration="3s")
    doc = _read(spark, tmp_path / "json")["r"]
    assert list(doc) == ["version", "scan_time", "duration", "target", "stats", "sast_findings", "sca_findings", "leak_findings"]
    assert (doc["scan_time"], doc["duration"], doc["target"], doc["stats"]["total_findings"]) == ("2026-01-01T00:00:00Z", "3s", "r", 4)
    assert [len(doc[k]) for k in ("sast_findings", "sca_findings", "leak_findings")] == [2, 1, 1]
    assert {"id", "type", "rule_id", "column", "false_positive"} <= set(doc["sast_findings"][0]) and "ai_remediation" not in doc["sast_findings"][0]
    assert doc["sca_findings"][0]["manifest_file"] == "requirements.txt" and doc["leak_findings"][0]["type"] == "Hardcoded API Key (Generic)"
    assert "commit_hash" not in doc["leak_findings"][0]


def test_stamped_output(spark, tmp_path):
    import datetime as dt
    import os

    from scanforge.sinks.reports import stamped_output
    f = _findings(spark).where("repo = 'r'").withColumn("branch", F.lit("main")).withColumn("scan_ts", F.lit(dt.datetime(2026, 1, 2, 3, 4, 5)))
    stamped_output(f, str(tmp_path / "s"))
    assert os.listdir(tmp_path / "s" / "repo=r") == ["report=report_main_20260102-030405.json"]
    assert spark.read.json(str(tmp_path / "s")).count() == 4
