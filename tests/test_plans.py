import pytest

from scanforge.plans.queries import corpus
from scanforge.plans.scan import code_findings, scan
from tests.conftest import API_KEY_LINE, SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_is_native(spark):
    f = code_findings(corpus(spark, SF001))
    plan = _plan(f)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Generate" in plan
    # contents are matched where they are read: the only exchange is the small rule catalog's
    assert "Exchange hashpartitioning" not in plan and "RoundRobin" not in plan


def test_findings_invariant_under_repartitioning(spark):
    c = corpus(spark, SF001)
    a = sorted(map(tuple, code_findings(c).select("file", "line", "rule_id").collect()))
    b = sorted(map(tuple, code_findings(c.repartition(13, "path")).select("file", "line", "rule_id").collect()))
    assert a == b and len(a) > 0


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "rule_id" in df.columns


def _mixed_files(spark):
    rows = [("a", "src/x.py", "import os\nsession = pickle.loads(data)\n"), ("a", "requirements.txt", "django==3.2.12\nrequests==2.27.0\n\nflask==1.0\n" + API_KEY_LINE),
            ("a", "package.json", '{"dependencies": {"lodash": "^4.17.15", "left": "1.0.0"}}'), ("b", "go.mod", "require x/y v1.0.0\nrequire log4j-core 2.14.1\n"),
            ("b", "vendor/package.json", '{"dependencies": {"lodash": "4.17.15"}}'), ("b", "sub/Gemfile.lock", "GEM\n  specs:\n    rack (2.0.1)\n"),
            ("c", "pom.xml", None), ("c", "empty.py", ""), ("c", "requirements.txt", ""), ("c", None, "eval(x)"), ("c", "package.json", "no json")]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def _advisories(spark):
    rows = [("A1", "django", "PyPI", "1.0", "4.0", 9.8), ("A1", "django", "PyPI", "3.0", "3.2.13", 9.8), ("A2", "requests", "pypi", None, "2.31.0", 0.5),
            ("A3", "lodash", "npm", "4.0.0", "4.17.21", 7.2), ("A4", "rack", "rubygems", "2.0.0", None, 5.0), ("A5", "x/y", "go", "0", "0.5", 9.9)]
    return spark.createDataFrame(rows, "id string, name string, ecosystem string, introduced string, fixed string, score double")


@pytest.mark.parametrize("kw, known, broadcast", [
    ({}, False, "-1"), ({"enable_sast": False, "min_severity": "INFO"}, False, "10485760"),
    ({"enable_leaks": False, "min_severity": "HIGH"}, True, "10485760"), ({"extra_ignores": ["sub"]}, True, "-1")])
def test_one_pass_gives_what_the_engines_give_alone(spark, kw, known, broadcast):
    from scanforge.operators.findings import FINDING_COLUMNS, combine_findings
    from scanforge.operators.sca import sca_scan
    files, adv = _mixed_files(spark), None if known else _advisories(spark)
    code = {{"enable_sast": "sast", "enable_leaks": "leaks"}.get(k, k): v for k, v in kw.items()}
    dep = {k: v for k, v in kw.items() if not k.startswith("enable")}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = scan(files, advisories=adv, **kw)
        alone = combine_findings(code_findings(files, **code), sca_scan(files, adv, **dep))
        assert got.dtypes == [(n, t) for n, t in FINDING_COLUMNS]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, alone.collect()))
        assert sum(r.engine == "SCA" for r in got.collect()) >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scan_reads_the_files_once(spark, tmp_path):
    _mixed_files(spark).write.parquet(str(tmp_path / "files"))
    plan = _plan(scan(spark.read.parquet(str(tmp_path / "files")), advisories=_advisories(spark)))
    assert plan.count("FileScan parquet") == 1
