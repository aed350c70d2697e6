import datetime as dt
import textwrap

from pyspark.sql import functions as F

from tests.conftest import files_df
from scanforge.functions.text import hmac_sha256_hex
from scanforge.operators.remediation import cache_lookup, clean_response
from scanforge.operators.rules import load_rules
from scanforge.sources.files import read_corpus


def test_load_rules(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.yaml").write_text(textwrap.dedent("""
        rules:
          - id: OK-1
            language: golang
            title: t
            pattern: "md5\\\\.New"
            severity: INFO
            owasp: A08:2025
          - language: python
            pattern: x
          - id: NOPAT
          - id: BADRX
            pattern: "(unclosed"
        """))
    (tmp_path / "notes.txt").write_text("rules: []")
    rules, errors = load_rules(spark, str(tmp_path))
    r = rules.collect()
    assert [(x.rule_id, x.language, x.severity, x.owasp[:3]) for x in r] == [("OK-1", "Go", "MEDIUM", "A08")]
    errs = sorted(e.error.split(" ")[0] for e in errors.collect())
    assert errs == ["invalid", "missing", "missing"]


def test_read_corpus_binary_file(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("eval(x)\n")
    (tmp_path / "b.js").write_text("ok\n")
    df = read_corpus(spark, str(tmp_path), repo="r")
    assert sorted(r.path for r in df.collect()) == ["b.js", "src/a.py"]


def test_hmac_matches_python(spark):
    import hashlib
    import hmac
    df = spark.createDataFrame([("payload",), ("",)], "m string")
    out = [r[0] for r in df.select(hmac_sha256_hex("key", F.col("m"))).collect()]
    assert out == [hmac.new(b"key", m.encode(), hashlib.sha256).hexdigest() for m in ["payload", ""]]


def test_cache_lookup(spark):
    now = dt.datetime(2026, 1, 8)
    resp = "fix it"
    good = spark.createDataFrame([("x",)], "m string").select(hmac_sha256_hex("k", F.lit(resp))).collect()[0][0]
    cache = spark.createDataFrame([
        ("fresh", now - dt.timedelta(days=1), 168, resp, good),
        ("expired", now - dt.timedelta(days=8), 168, resp, good),
        ("tampered", now - dt.timedelta(days=1), 168, resp, "00"),
        ("unsigned", now - dt.timedelta(days=1), 168, resp, ""),
    ], "key string, created timestamp, ttl_hours int, response string, integrity string")
    items = spark.createDataFrame([(k,) for k in ["fresh", "expired", "tampered", "unsigned", "none"]], "cache_key string")
    again = cache.where("key = 'fresh'").withColumn("response", F.lit("older")).withColumn("created", F.col("created") - F.expr("INTERVAL 1 DAY")).withColumn(
        "integrity", F.lit(""))
    found = cache_lookup(items, cache.unionByName(again), now, integrity_key="k").collect()
    assert sorted(r.cache_key for r in found if r.hit) == ["fresh", "unsigned"]  # two valid entries of a key give one row
    assert sorted(r.cache_key for r in found if not r.hit) == ["expired", "none", "tampered"]
    assert {r.cached_response for r in found if r.hit} == {resp}


def test_clean_response(spark):
    raw = "Sure, here you go\n<s>Step 1  \n\n\n\nStep 2\t\n</s>"
    out = spark.createDataFrame([(raw,)], "t string").select(clean_response("t")).collect()[0][0]
    assert out == "Step 1\n\nStep 2"
    long = ("x" * 99 + "\n") * 40
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(clean_response("t")).collect()[0][0] == long.strip()
    out = df.select(clean_response("t", max_bytes=3000)).collect()[0][0]
    assert out.endswith("[... output truncated]") and len(out.encode()) < 3100


def test_read_corpus_survives_binary_files(spark, tmp_path):
    from scanforge.plans.scan import scan
    (tmp_path / "img.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\xff\xfe")
    (tmp_path / "blob.json").write_bytes(b"\x00\x01\x02\xff" * 100)
    (tmp_path / "a.py").write_text("pickle.loads(x)\n")
    f = scan(read_corpus(spark, str(tmp_path), repo="r")).collect()
    assert [(r.file, r.rule_id) for r in f] == [("a.py", "PY-007")]


def test_load_rules_rejects_non_re2(spark, tmp_path):
    (tmp_path / "r.yaml").write_text('rules:\n  - id: LA\n    pattern: "a(?=b)"\n  - id: OK\n    pattern: "a+b"\n')
    rules, errors = load_rules(spark, str(tmp_path))
    assert [r.rule_id for r in rules.collect()] == ["OK"]
    assert [e.rule_id for e in errors.collect()] == ["LA"]


def test_load_rules_translates_re2(spark, tmp_path):
    from scanforge.operators.rules import builtin_rules, merge_rules
    from scanforge.operators.sast import sast_scan
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.yml").write_text(
        "rules:\n  - {id: N, language: js, pattern: '(?P<n>eval)\\('}\n  - {id: C, language: js, pattern: 'x[a[]'}\n"
        "  - {id: P, language: js, pattern: '[[:alpha:]]{9}'}\n  - {id: L, language: js, pattern: 'q(?i)Z\\pL'}\n"
        "  - {id: W, language: js, pattern: '^\\W\\S$'}\n  - {id: BAD, pattern: 'a(b'}\n  - {id: REF, pattern: '(a)\\1'}\n")
    rules, errors = load_rules(spark, str(tmp_path))
    assert sorted(e.rule_id for e in errors.collect()) == ["BAD", "REF"]
    files = files_df(spark, [("a.js", "eval(\nx[\nabcdefghi\nqzé\n-x\nnone")])
    got = {(r.rule_id, r.line) for r in sast_scan(files, merge_rules(builtin_rules(spark), rules)).collect() if len(r.rule_id) == 1}
    assert got == {("N", 1), ("C", 2), ("P", 3), ("L", 4), ("W", 5)}


def test_hints_hold_for_every_match(spark):
    """Literals read off a pattern stand in every line it matches."""
    from scanforge.functions.regex import literal_hints
    from scanforge.sources.rule_samples import positive
    from scanforge.operators.rules import builtin_rule_rows, leak_rule_rows
    found = 0
    for p in [r[4] for r in builtin_rule_rows()] + [r[2] for r in leak_rule_rows()]:
        hints = literal_hints(p)
        if hints:
            found += 1
            assert any(h in positive(p).lower() for h in hints), p
    assert found > 80


def test_every_rule_has_a_line(spark):
    import re

    from scanforge.operators.rules import builtin_rule_rows, leak_rule_rows
    from scanforge.sources.rule_samples import positive
    missing = [r[0] for r in builtin_rule_rows() if "\n" in positive(r[4]) or not re.search(r[4], positive(r[4])) or (r[5] and re.search(r[5], positive(r[4])))]
    missing += [r[0] for r in leak_rule_rows() if not re.search(r[2], positive(r[2]))]
    assert missing == ["PY-024"]  # it needs two lines, and lines are matched one by one
