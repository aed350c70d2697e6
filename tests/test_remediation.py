import hashlib

from pyspark.sql import functions as F

from scanforge.functions.text import cache_key, cache_key_short
from scanforge.operators.remediation import attach_remediation, remediation_worklist, render_prompt


def test_cache_key_matches_python(spark):
    parts = ["prov", "model", "PY-001", "HIGH", "code\nline"]
    df = spark.createDataFrame([tuple(parts)], "a string, b string, c string, d string, e string")
    got = df.select(cache_key("a", "b", "c", "d", "e")).collect()[0][0]
    assert got == hashlib.sha256("\n".join(parts).encode()).hexdigest()
    assert df.select(cache_key_short(cache_key("a", "b", "c", "d", "e"))).collect()[0][0] == got[:16]


def test_worklist_top_five_leaks(spark):
    rows = [("r", "SAST", "PY-1", "HIGH", "a.py", 1), ("r", "SAST", "PY-2", "LOW", "a.py", 2)]
    rows += [("r", "Leaks", f"LEAK-{i}", "CRITICAL" if i % 2 else "HIGH", f"f{i}.env", i) for i in range(8)]
    f = spark.createDataFrame(rows, "repo string, engine string, rule_id string, severity string, file string, line int")
    assert sum(r.engine == "Leaks" for r in remediation_worklist(f).collect()) == 8
    w = remediation_worklist(f, max_leaks=5).collect()
    assert sum(r.engine == "SAST" for r in w) == 1
    leaks = sorted(r.rule_id for r in w if r.engine == "Leaks")
    # CRITICAL first (f1, f3, f5, f7), then the first HIGH by file (f0)
    assert leaks == ["LEAK-0", "LEAK-1", "LEAK-3", "LEAK-5", "LEAK-7"]


def test_render_prompt_and_attach(spark):
    rows = [("k1", "SQL Injection", "HIGH", "Python", "A05:2025 - Injection", "CWE-89", 9.8, "x = 1", "a.py", 3, "")]
    f = spark.createDataFrame(rows, "cache_key string, title string, severity string, language string, owasp string, "
                                    "cwe string, cvss double, code string, file string, line int, ai_remediation string")
    p = render_prompt(f).collect()[0].prompt
    assert p.startswith("## Security Vulnerability Found\n\n**Vulnerability:** SQL Injection\n")
    assert "**CVSS Score:** 9.8\n\n**Vulnerable Code:**\n```\nx = 1\n```\n\n**File:** a.py (line 3)\n" in p
    answers = spark.createDataFrame([("k1", "use parameters")], "cache_key string, response string")
    assert attach_remediation(f, answers).collect()[0].ai_remediation == "use parameters"


def test_prompt_of_a_secret_names_type_and_file_only(spark):
    from scanforge.operators.remediation import render_prompts
    rows = [("Leaks", "Token", "a/b.env", 3, "HIGH", "abcd****"), ("SAST", "Injection", "x.py", 1, "HIGH", None)]
    got = render_prompts(spark.createDataFrame(rows, "engine string, title string, file string, line int, severity string, match string"))
    assert got.columns == ["engine", "title", "file", "line", "severity", "match", "prompt"]
    secret, finding = [r.prompt for r in got.collect()]
    assert secret.startswith("A Token was detected in the file: a/b.env\n\nPlease provide:\n1. The immediate steps") and secret.endswith("Be concise and actionable.")
    assert "abcd" not in secret and finding.startswith("## Security Vulnerability Found\n\n**Vulnerability:** Injection")
