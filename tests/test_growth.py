"""Steps that grow with the dependencies do each thing once."""

from pyspark.sql import functions as F

from scanforge.operators import sca
from scanforge.operators.matching import lower_for_hints


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _npm(spark, *contents):
    return spark.createDataFrame([("r", f"a{i}/package.json", c) for i, c in enumerate(contents)], "repo string, path string, content string")


def test_json_manifest_is_parsed_once(spark):
    """the root once and each section once (three times before, and once more to learn if there is anything)."""
    plan = _plan(sca.deps_npm(_npm(spark, "{}")))
    assert plan.count("from_json(") == 2


def test_json_manifest_sections(spark):
    found = sca.deps_npm(_npm(
        spark,
        '{"dependencies": {"a": "^1.0", "b": null}, "DevDependencies": {"c": "~2"}}',
        '{"dependencies": {"a": 1}, "devDependencies": {"c": "2"}}',  # a version that is no text
        '{"dependencies": "x", "devDependencies": {"c": "2"}}',  # a section that is no map
        '{"dependencies": {}}', '{"dependencies": null, "devDependencies": {"d": "3"}}', "{}", "no json", None))
    assert sorted((r.file, r.name, r.version) for r in found.collect()) == [
        ("a0/package.json", "a", "1.0"), ("a0/package.json", "b", ""), ("a0/package.json", "c", "2"), ("a4/package.json", "d", "3")]


def _advisories(spark):
    return spark.createDataFrame([("A1", "p", "pypi", "0", "1.5"), ("A1", "p", "pypi", "2.0", "3.0"), ("A0", "p", "pypi", "0", "9"), ("B", "q", "pypi", "1", None)],
                                 "id string, name string, ecosystem string, introduced string, fixed string")


def _deps(spark):
    return spark.createDataFrame([("r", "f", "p", "1.0", "pypi"), ("r", "f", "p", "2.1", "pypi"), ("r", "f", "q", "0.1", "pypi"), ("r", "f", "x", "1", "pypi"), ("r", "f", None, "1", "pypi")],
                                 "repo string, file string, name string, version string, ecosystem string")


def test_packages_are_not_copied(spark):
    """F16: every package was sent sixteen times."""
    found = sca.match_advisories(_deps(spark), _advisories(spark))
    assert "sequence(" not in _plan(found) and _plan(found).count("Generate explode") == 1
    rows = sorted((r.package_name, r.package_version, r.rule_id, r.fixed_version) for r in found.collect())
    assert rows == [("p", "1.0", "A0", "9"), ("p", "1.0", "A1", "1.5"), ("p", "2.1", "A0", "9"), ("p", "2.1", "A1", "3.0")]
    salted = sca.match_advisories(_deps(spark), _advisories(spark), salts=4)
    assert sorted(salted.collect()) == sorted(found.collect())


def test_hints_are_folded_without_translate(spark):
    """F5 to F12: translate() took a quarter of the matching stage."""
    lines = spark.createDataFrame([("PAſſWORD toKen",), ("",), (None,)], "line string").select(lower_for_hints(F.col("line")).alias("lc"))
    assert "translate(" not in _plan(lines)
    assert [r.lc for r in lines.collect()] == ["password token", "", None]
