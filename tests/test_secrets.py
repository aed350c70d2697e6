import pytest
from pyspark.sql import functions as F

from scanforge.functions.text import redact, shannon_entropy
from scanforge.operators.secrets import gitignore_match, leak_scan, scan_lines
from tests.conftest import API_KEY_LINE, COMMENTED_PASSWORD_LINE, LOW_ENTROPY_KEY_LINE, files_df

# token-shaped strings are assembled from parts
AWS = "AK" + "IA" + "IOSFODNN7" + "EXAMPLE"
GHP = "gh" + "p_" + "a" * 20 + "B" * 16
RSA = "-----BEGIN RSA " + "PRIVATE KEY-----"
STRIPE = "sk" + "_live_" + "4eC39HqLyjWDarjtT1zdp7dc"
JWT = "ey" + "JhbGciOiJIUzI1NiJ9" + "." + "eyJzdWIiOiIxMjM0NTY3ODkwIn0" + "." + "dozjgNryP4J3jVmNHl0w5N"


@pytest.mark.parametrize("line,rule,severity", [
    ("key = " + AWS, "LEAK-001", "CRITICAL"),
    ("token: " + GHP, "LEAK-020", "CRITICAL"),
    (RSA, "LEAK-080", "CRITICAL"),
    ("stripe = " + STRIPE, "LEAK-030", "CRITICAL"),
    ("auth " + JWT, "LEAK-100", "HIGH"),
])
def test_leak_cases(spark, line, rule, severity):
    df = spark.createDataFrame([("1", line)], "id string, text string")
    rows = scan_lines(df).collect()
    hit = [r for r in rows if r.rule_id == rule]
    assert hit and hit[0].severity == severity
    assert not any(r.match and line[3:] in r.match for r in rows)


def test_benign_lines(spark):
    df = spark.createDataFrame([("1", "hello world"), ("2", "x = 42"), ("3", "print('ok')")], "id string, text string")
    assert scan_lines(df).count() == 0


@pytest.mark.parametrize("s,bits", [("", 0.0), ("aaaa", 0.0), ("aabbccdd", 2.0),
                                    ('api_key = "abcdefghijklmnop1234"', 4.5625)])
def test_entropy(spark, s, bits):
    df = spark.createDataFrame([(s,)], "s string")
    assert abs(df.select(shannon_entropy("s")).collect()[0][0] - bits) < 1e-9


def test_redact(spark):
    df = spark.createDataFrame([("a" * 19,), ("abcdefghijklmnopqrst",), ("é" + "b" * 20,)], "s string")
    out = [r[0] for r in df.select(redact("s")).collect()]
    assert out[0] == "***REDACTED***"
    assert out[1] == "abc" + "*" * 17
    assert out[2] == "éb" + "*" * 19          # 3 bytes kept, one star per remaining byte


def test_entropy_gate_and_comment_skip(spark):
    rows = [("a.env", COMMENTED_PASSWORD_LINE + "\n" + LOW_ENTROPY_KEY_LINE + "\n" + API_KEY_LINE)]
    f = leak_scan(files_df(spark, rows)).collect()
    got = [(r.rule_id, r.line) for r in f]
    assert ("LEAK-121", 3) in got and ("LEAK-121", 2) not in got
    assert not any(line == 1 for _, line in got)
    gated = [r for r in f if r.rule_id == "LEAK-121"][0]
    assert gated.entropy >= 3.5


IGNORE = [".env", ".env.*", "!.env.example", "config/secrets/"]


@pytest.mark.parametrize("path,expected", [
    (".env", True), (".env.local", True), (".env.production", True), (".env.example", False),
    ("config/secrets/keys.yaml", True), ("src/app.go", False), ("README.md", False),
])
def test_gitignore(spark, path, expected):
    pats = spark.createDataFrame([("r", i, p) for i, p in enumerate(IGNORE)], "repo string, ord int, pattern string")
    paths = spark.createDataFrame([("r", path)], "repo string, path string")
    assert gitignore_match(paths, pats).collect()[0].ignored is expected


def test_gitignore_missing_file(spark):
    pats = spark.createDataFrame([], "repo string, ord int, pattern string")
    paths = spark.createDataFrame([("r", ".env")], "repo string, path string")
    assert gitignore_match(paths, pats).collect()[0].ignored is False


def test_downgrade_ignored(spark):
    pats = spark.createDataFrame([("r", 0, ".env")], "repo string, ord int, pattern string")
    rows = [(".env", "key = " + AWS), ("a.yaml", "key = " + AWS)]
    f = {r.file: r for r in leak_scan(files_df(spark, rows), patterns=pats).collect()}
    assert f[".env"].severity == "INFO" and f[".env"].description.startswith("[.gitignore] ")
    assert f["a.yaml"].severity == "CRITICAL"


def test_history_dedup_first_commit(spark):
    from scanforge.operators.secrets import history_scan
    rows = [("r", "c%012d" % i, i, "src/a.py", "key = " + AWS) for i in range(3)]
    rows.append(("r", "c%012d" % 9, 9, "img/a.png", "key = " + AWS))
    b = spark.createDataFrame(rows, "repo string, commit_hash string, commit_seq long, path string, content string")
    h = history_scan(b).collect()
    assert [(r.file, r.commit_hash, r.in_git_history) for r in h] == [("src/a.py", "c000000000000", True)]
    assert h[0].commit_short == "c0000000"


def test_a_content_in_many_commits_is_matched_once(spark):
    from scanforge.operators.secrets import distinct_contents, history_scan
    rows = [("r", "c%012d" % i, i, f"p{i % 2}.py", "key = " + AWS + ("\nnew" if i == 700 else "")) for i in range(1000)]
    rows += [("other", "d%012d" % i, i, "p0.py", "key = " + AWS) for i in range(5, 9)]
    b = spark.createDataFrame(rows, "repo string, commit_hash string, commit_seq long, path string, content string").repartition(8)
    addressed = b.selectExpr("content", "sha2(cast(content as binary), 256) as _h", "octet_length(content) as _len")
    assert distinct_contents(addressed).count() == 2
    found = sorted((r.repo, r.file, r.commit_hash) for r in history_scan(b).collect())
    assert found == [("other", "p0.py", "d%012d" % 5), ("r", "p0.py", "c%012d" % 0), ("r", "p1.py", "c%012d" % 1)]
    plan = history_scan(b)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("posexplode"):]
    assert "first(content" in below  # lines are split from the distinct contents


def test_history_commit_cap(spark):
    from scanforge.operators.secrets import history_scan
    rows = [("r", "c%012d" % i, i, f"f{i}.py", "key = " + AWS) for i in range(5)]
    b = spark.createDataFrame(rows, "repo string, commit_hash string, commit_seq long, path string, content string")
    files = sorted(r.file for r in history_scan(b, max_commits=2).collect())
    assert files == ["f3.py", "f4.py"]


def test_redact_corpus(spark):
    from scanforge.operators.secrets import redact_corpus
    df = files_df(spark, [("a", "x\nkey = " + AWS + "\ny")])
    out = redact_corpus(df).collect()[0].content
    assert AWS not in out and out.startswith("x\nkey = ***REDACTED***")


def test_ignore_patterns_with_classes(spark):
    lines = ["[!a].env", "x[0-9].key", "a[", "lit\\*.txt", "q?.md", "[z-a].rev", "[a-Z].rev", "[+--].ok"]
    pats = spark.createDataFrame([("r", i, p) for i, p in enumerate(lines)], "repo string, ord int, pattern string")
    cases = {"b.env": True, "a.env": False, "x1.key": True, "xa.key": False, "a[": False, "a": False, "lit*.txt": True, "litx.txt": False, "q1.md": True, "q.md": False, "z.rev": False, "a.rev": False, ",.ok": True}
    paths = spark.createDataFrame([("r", p) for p in cases], "repo string, path string")
    assert {r.path: r.ignored for r in gitignore_match(paths, pats).collect()} == cases


def test_nothing_is_cut_by_default(spark):
    from scanforge.plans.scan import scan
    key = "key = " + AWS
    files = files_df(spark, [("long.js", "x" * 70000 + "\neval(z)\n"), ("wide.env", "p" * 12000 + " " + key), ("big.env", "#\n" * 3_000_000 + key),
                             ("tail.py", "a" * 9000 + "\n" + key)])
    found = {(r.file, r.rule_id) for r in scan(files).collect()}
    assert ("long.js", "JS-001") in found
    assert {f for f, r in found if r.startswith("LEAK")} >= {"wide.env", "big.env", "tail.py"}
    capped = {r.file for r in leak_scan(files, max_bytes=5 * 1024 * 1024, line_cap=10000).collect()}
    assert capped == {"tail.py"}
