import re

import pytest
from pyspark.sql import functions as F

from scanforge.operators.matching import explode_lines
from scanforge.operators.sast import match_rules
from scanforge.operators.secrets import match_secrets
from scanforge.plans.scan import code_findings, scan
from tests.conftest import files_df


@pytest.fixture
def plain(spark):
    """Plans as the planner leaves them."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _plan(df):
    return df._jdf.queryExecution().executedPlan()


def _nodes(node):
    below = [node.children().apply(i) for i in range(node.children().size())]
    return [node, *(x for c in below for x in _nodes(c))]


def _adv(spark):
    return spark.createDataFrame([("A-1", "pypi", "django", "1.0", "4.0")], "id string, ecosystem string, name string, introduced string, fixed string")


def test_rules_stay_out_of_whole_stage_code(spark, plain):
    """In one generated method with the explode the rules exceed what the JVM compiles."""
    files = files_df(spark, [("a.py", "pickle.loads(x)"), ("requirements.txt", "django==3.2.12\n")])
    lines = explode_lines(files).withColumn("language", F.lit("Python"))
    for df in (code_findings(files), scan(files, advisories=_adv(spark)), match_rules(lines), match_secrets(lines)):
        matching = [x for x in _plan(df).toString().split("\n") if "named_struct(k," in x]
        assert matching and not [x[:80] for x in matching if re.match(r"[\s:|+-]*\*\(", x)]
    assert {(r.engine, r.line) for r in scan(files, advisories=_adv(spark)).collect()} == {("SAST", 1), ("SCA", None)}


def test_rows_before_the_rules_hold_no_array_of_lines(spark, plain):
    """A copy of the file's lines in each of its rows would be work quadratic in them, also for a single rule."""
    files = files_df(spark, [("a.py", "x\nneedle\ny")])
    rule = spark.createDataFrame([("R", "Generic", "needle", "LOW", 0)], "rule_id string, language string, pattern string, severity string, rule_ord int")
    for df in (scan(files, sast_rules=rule, advisories=_adv(spark)), code_findings(files, sast_rules=rule, leaks=False).select("rule_id", "code")):
        rules = next(x for x in _nodes(_plan(df)) if x.nodeName() == "Project" and "_hits#" in x.output().mkString(" "))
        under = rules.children().apply(0)
        assert under.nodeName().startswith("WholeStageCodegen")  # the explode and what is taken from its arrays
        assert "line_no#" in under.output().mkString(" ") and "lines#" not in under.output().mkString(" ")
        assert [r.code for r in df.collect() if r.rule_id == "R"] == ["x\nneedle\ny"]
