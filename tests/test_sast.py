import pytest

from scanforge.operators.sast import sast_scan
from scanforge.plans.scan import scan
from tests.conftest import API_KEY_LINE, JAVA_PASSWORD_LINE, files_df

ENGINE_CASES = [
    ("app/db.py", 'cursor.execute("SELECT * FROM users WHERE id = %s" % uid)', "PY-001"),
    ("app/s.py", "obj = pickle.loads(data)", "PY-007"),
    ("src/A.java", JAVA_PASSWORD_LINE, "JAVA-003"),
    ("web/a.js", "const r = eval(userInput);", "JS-001"),
    ("cmd/m.go", "tls.Config{InsecureSkipVerify: true}", "GO-005"),
]


@pytest.mark.parametrize("path,line,rule", ENGINE_CASES)
def test_engine_cases(spark, path, line, rule):
    f = sast_scan(files_df(spark, [(path, "x = 1\n" + line + "\n")]))
    rows = f.collect()
    assert rule in {r.rule_id for r in rows}
    hit = [r for r in rows if r.rule_id == rule][0]
    assert hit.line == 2 and hit.cwe and hit.finding_id == f"{rule}-{path.split('/')[-1]}-2"


@pytest.mark.parametrize("line,fires", [
    ('<input type="password" name="p">', True),
    ('<input type="password" autocomplete="off">', False),
    ('<input type="password" autocomplete="new-password">', False),
    ('<input type="password" autocomplete="current-password">', False),
    ('<input type="password" autocomplete="on">', True),
])
def test_html_autocomplete(spark, line, fires):
    f = sast_scan(files_df(spark, [("p.html", line)]))
    assert ("HTML-003" in {r.rule_id for r in f.collect()}) is fires


def test_anti_pattern_js(spark):
    f = sast_scan(files_df(spark, [("a.js", "fetch(u).then(f)\nfetch(u).then(f).catch(g)\n")]))
    rows = [(r.rule_id, r.line) for r in f.collect() if r.rule_id == "JS-014"]
    assert rows == [("JS-014", 1)]


def test_column_is_byte_offset_and_snippet(spark):
    content = "a\nb\nc\nd\néé eval(x)\ne\nf\ng\nh"
    f = sast_scan(files_df(spark, [("x.js", content)])).where("rule_id = 'JS-001'").collect()[0]
    assert f.line == 5 and f.column == 6          # 2 two-byte chars + space -> byte 6
    assert f.code == "b\nc\nd\néé eval(x)\ne\nf\ng"


def test_language_gating_and_generic(spark):
    rows = [("a.ts", "eval(x)\n// TODO: fix auth"), ("b.txt", "// TODO: fix auth"), ("c.py", "// TODO: fix auth")]
    f = sast_scan(files_df(spark, rows)).collect()
    got = {(r.file, r.rule_id) for r in f}
    assert ("a.ts", "GEN-003") in got and ("c.py", "GEN-003") in got
    assert not any(p == "b.txt" for p, _ in got)      # no language -> no SAST
    assert ("a.ts", "JS-001") not in got              # TypeScript has no rules of its own


def test_overlong_line_stops_scanner(spark):
    content = "eval(a)\n" + "x" * 70000 + "\neval(b)"
    files = files_df(spark, [("a.js", content)])
    assert sorted(r.line for r in sast_scan(files).where("rule_id = 'JS-001'").collect()) == [1, 3]
    assert [r.line for r in sast_scan(files, overlong_limit=65536).where("rule_id = 'JS-001'").collect()] == [1]


def test_no_line_after_the_last_line_end(spark):
    from scanforge.operators.rules import RULE_SCHEMA
    rule = ("X-1", "JavaScript", "t", "d", "^$", None, "HIGH", "o", "c", 1.0, None, "", None, "custom", 0)
    rules = spark.createDataFrame([rule], RULE_SCHEMA)
    got = sorted(r.line for r in sast_scan(files_df(spark, [("a.js", "x\n\ny\n")]), rules).collect())
    assert got == [2]


def test_ignored_and_min_severity(spark):
    rows = [("node_modules/x/a.py", "pickle.loads(x)"), ("src/a.py", "pickle.loads(x)\nexcept:")]
    f = sast_scan(files_df(spark, rows), min_severity="HIGH").collect()
    assert {(r.file, r.rule_id) for r in f} == {("src/a.py", "PY-007")}


def test_stats_add_up(spark):
    rows = [("a.py", "pickle.loads(x)\nexcept:\n" + "aws_access_key_id = " + "AK" + "IA" + "IOSFODNN7EXAMPLE"),
            ("b.env", API_KEY_LINE)]
    from scanforge.operators.findings import finding_stats
    f = scan(files_df(spark, rows))
    st = finding_stats(f).collect()[0]
    assert st.total_findings == st.critical + st.high + st.medium + st.low + st.info
    assert st.total_findings == st.sast_count + st.sca_count + st.leaks_count
    assert st.sast_count == 2 and st.leaks_count == 2


def test_optional_sast_line_guard(spark):
    content = "eval(a)\n" + "x" * 5000 + " eval(b)"
    f = files_df(spark, [("a.js", content)])
    assert sorted(r.line for r in sast_scan(f).where("rule_id = 'JS-001'").collect()) == [1, 2]
    assert [r.line for r in sast_scan(f, max_line_bytes=1000).where("rule_id = 'JS-001'").collect()] == [1]


def test_scan_parameters(spark):
    rows = [("a.py", "pickle.loads(x)"), ("b.js", "eval(x)"), ("c.env", API_KEY_LINE)]
    f = files_df(spark, rows)
    only_py = {(r.file, r.rule_id) for r in scan(f, languages=["Python"], enable_leaks=False).collect()}
    assert only_py == {("a.py", "PY-007")}
    strict = [r for r in scan(f, min_entropy=5.0).collect() if r.engine == "Leaks"]
    assert strict == []


def test_rule_language_aliases(spark):
    f = files_df(spark, [("a.ts", "const r = eval(userInput);")])
    assert {r.rule_id for r in scan(f).collect()} == set()           # default: TypeScript has no rules
    got = [(r.rule_id, r.language) for r in scan(f, rule_language_aliases={"TypeScript": "JavaScript"}).collect()]
    assert got == [("JS-001", "TypeScript")]


def test_scan_includes_dependency_findings(spark):
    rows = [("svc/requirements.txt", "django==3.2.12\nrequests>=2.31.0\n"),
            ("web/package.json", '{"dependencies": {"lodash": "^4.17.15"}}'),
            ("node_modules/x/package.json", '{"dependencies": {"lodash": "4.17.15"}}')]
    f = scan(files_df(spark, rows))
    sca = sorted((r.file, r.package_name, r.cve, r.severity) for r in f.where("engine = 'SCA'").collect())
    assert sca == [("svc/requirements.txt", "django", "CVE-2022-28347", "HIGH"),
                   ("web/package.json", "lodash", "CVE-2021-23337", "HIGH")]
