"""Property checks: redaction never reveals a long match, entropy is bounded
by log2(distinct characters), custom rules merge with the built-ins."""

import math
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanforge.functions.text import redact, shannon_entropy

TEXT = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=60)


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_redaction_and_entropy_bounds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", redact("s").alias("r"), shannon_entropy("s").alias("e")).collect()
    for r in rows:
        n = len(r.s.encode())
        if n >= 20:
            assert r.s not in r.r and r.r.endswith("*" * (n - 3))
        else:
            assert r.r == "***REDACTED***"
        distinct = len(set(r.s))
        assert r.e <= math.log2(max(distinct, 1)) + 1e-9 + (0 if n == len(r.s) else math.log2(n))


def test_custom_rules_merge_and_fire(spark, tmp_path):
    from scanforge.operators.rules import builtin_rules, load_rules, merge_rules
    from scanforge.operators.sast import sast_scan
    (tmp_path / "r.yml").write_text(textwrap.dedent("""
        rules:
          - id: PY-007
            language: py
            title: duplicate id fires too
            pattern: "pickle\\\\.loads"
            severity: high
          - id: RB-1
            language: rb
            pattern: "Marshal\\\\.load"
            severity: CRITICAL
        """))
    custom, errors = load_rules(spark, str(tmp_path))
    assert errors.count() == 0
    merged = merge_rules(builtin_rules(spark), custom)
    files = spark.createDataFrame([("r", "a.py", "x = pickle.loads(b)"), ("r", "b.rb", "Marshal.load(x)")],
                                  "repo string, path string, content string")
    got = sorted((r.file, r.rule_id, r.severity) for r in sast_scan(files, merged).collect())
    assert got == [("a.py", "PY-007", "CRITICAL"), ("a.py", "PY-007", "HIGH"), ("b.rb", "RB-1", "CRITICAL")]


def _py_key(v):
    import re as _re
    v = _re.sub(r"^[vV]", "", v)
    out = []
    for part in v.split("."):
        m = _re.match(r"^([0-9]+)", part)
        out.append(int(m.group(1)) if m else 0)
    return out


VERSION = st.lists(st.one_of(st.integers(0, 30).map(str), st.sampled_from(["0-beta", "rc1", "x", "10a"])),
                   min_size=1, max_size=4).map(".".join)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(VERSION, VERSION), min_size=30, max_size=60))
def test_version_key_order(spark, pairs):
    from scanforge.operators.sca import version_key
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", (version_key(F.col("a")) < version_key(F.col("b"))).alias("lt")).collect()
    for r in rows:
        assert r.lt == (_py_key(r.a) < _py_key(r.b)), (r.a, r.b)
