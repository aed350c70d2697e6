import pytest
from pyspark.sql import functions as F

from scanforge.functions.text import cvss_score_from_text, strip_version_prefix
from scanforge.functions.text import cvss_severity
from scanforge.operators import sca
from tests.conftest import files_df


def _deps(df):
    return sorted((r.name, r.version, r.ecosystem) for r in df.collect())


def test_npm(spark):
    m = files_df(spark, [("package.json", '{"dependencies": {"lodash": "^4.17.15"}, "devDependencies": {"jest": "~29.0.0"}}'),
                         ("x/package.json", "{not json")])
    assert _deps(sca.deps_npm(m)) == [("jest", "29.0.0", "npm"), ("lodash", "4.17.15", "npm")]


def test_composer(spark):
    m = files_df(spark, [("composer.json", '{"require": {"php": ">=8.1", "monolog/monolog": "^2.0"}, "require-dev": {"phpunit/phpunit": "9.5"}}')])
    assert _deps(sca.deps_composer(m)) == [("monolog/monolog", "2.0", "packagist"), ("phpunit/phpunit", "9.5", "packagist")]


def test_requirements(spark):
    m = files_df(spark, [("requirements.txt", "# c\n-r base.txt\ndjango==3.2.12\nrequests>=2.27.0,<3\nflask\nfoo<2\nbar ~= 1.4\n")])
    assert _deps(sca.deps_requirements(m)) == [("bar", "1.4", "pypi"), ("django", "3.2.12", "pypi"),
                                               ("requests", "2.27.0", "pypi")]


def test_gemfile(spark):
    m = files_df(spark, [("Gemfile.lock", "GIT\n  x (1.0)\nGEM\n  remote: r\n  specs:\n    rails (7.0.4)\n    rack (>= 2.2)\n")])
    assert _deps(sca.deps_gemfile(m)) == [("rack", ">=", "rubygems"), ("rails", "7.0.4", "rubygems")]


def test_gomod(spark):
    m = files_df(spark, [("go.mod", "module m\n\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0 // indirect\n\t// note here\n)\n")])
    assert _deps(sca.deps_gomod(m)) == [("//", "note", "go"), ("github.com/a/b", "v1.2.3", "go"),
                                        ("github.com/c/d", "v0.1.0", "go")]


def test_pom(spark):
    pom = ("<project>\n<artifactId>app</artifactId>\n<version>${revision}</version>\n<dependency>\n"
           "<artifactId>log4j-core</artifactId>\n<version>2.14.1</version>\n</dependency>\n"
           "<dependency><artifactId>junit</artifactId><version>4.13</version></dependency>\n</project>")
    m = files_df(spark, [("pom.xml", pom)])
    assert _deps(sca.deps_pom(m)) == [("junit", "4.13", "maven"), ("log4j-core", "2.14.1", "maven")]


def test_pubspec(spark):
    m = files_df(spark, [("pubspec.yaml", "dependencies:\n  flutter:\n    sdk: flutter\n  http: ^0.13.0\n  path: {path: ../x}\n"
                                           "dev_dependencies:\n  lints: '>=2.0.0'\n")])
    assert _deps(sca.deps_pubspec(m)) == [("http", "0.13.0", "pub"), ("lints", "2.0.0", "pub"), ("path", "", "pub")]


@pytest.mark.parametrize("raw,expected", [("^1.0", "1.0"), (">= 2", "2"), ("~>3", "3"), ("^>=1.0", ">=1.0"), ("1", "1")])
def test_strip_version_prefix(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "v string").select(strip_version_prefix("v")).collect()[0][0] == expected


@pytest.mark.parametrize("score,sev", [(9.0, "CRITICAL"), (8.9, "HIGH"), (7.0, "HIGH"), (6.9, "MEDIUM"), (4.0, "MEDIUM"),
                                       (0.1, "LOW"), (0.0, "HIGH")])
def test_cvss_severity(spark, score, sev):
    assert spark.createDataFrame([(score,)], "s double").select(cvss_severity(F.col("s"))).collect()[0][0] == sev


@pytest.mark.parametrize("text,score", [("7.5", 7.5), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N", 9.0), ("AV:N/AC:H", 7.5),
                                        ("AV:L/AC:L", 5.0), ("11", 5.0)])
def test_cvss_score_text(spark, text, score):
    assert spark.createDataFrame([(text,)], "s string").select(cvss_score_from_text(F.col("s"))).collect()[0][0] == score


def test_known_vulnerable_all_rows(spark):
    rows = [("r", n, v, "pypi", "requirements.txt") for n, v, *_ in sca.KNOWN_VULNERABLE]
    d = spark.createDataFrame(rows, "repo string, name string, version string, ecosystem string, file string")
    f = sca.match_known_vulnerable(d).collect()
    assert len(f) == 14 and all(r.owasp.startswith("A03") for r in f)
    assert all(r.advisory_url.endswith(r.cve) for r in f)


def test_match_advisories_range(spark):
    d = spark.createDataFrame([("r", "p", v, "npm", "package.json") for v in ["1.1.9", "1.2.0", "1.9.0", "1.10.0", "1.10.1"]],
                              "repo string, name string, version string, ecosystem string, file string")
    a = spark.createDataFrame([("ADV-1", "p", "npm", "1.2.0", "1.10.1", 7.5)],
                              "id string, name string, ecosystem string, introduced string, fixed string, score double")
    got = sorted(r.package_version for r in sca.match_advisories(d, a).collect())
    assert got == ["1.10.0", "1.2.0", "1.9.0"]


def test_normalize_advisory(spark):
    j = ('{"id":"GHSA-1","aliases":["GHSA-x","CVE-2021-1"],"summary":"","details":"' + "d" * 250 + '",'
         '"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N"}],'
         '"affected":[{"ranges":[{"events":[{"introduced":"0"},{"fixed":""},{"fixed":"2.0"}]}]}]}')
    r = sca.normalize_advisory(spark.createDataFrame([(j,)], "json string")).collect()[0]
    assert (r.cve, r.fixed, r.cvss, r.severity) == ("CVE-2021-1", "2.0", 9.0, "CRITICAL")
    assert r.description == "d" * 250 and r.short_description == "d" * 200 + "..."


def test_versions_by_hand(spark):
    """(version, introduced, fixed, last_affected, affected)."""
    cases = [("1.2", "1.2.0", "2.0.0", None, True), ("2.0", "1.2.0", "2.0.0", None, False), ("1.2.0", "1.2", "2.0", None, True), ("1.10.0", "1.9", "1.11", None, True),
             ("1.0.0-rc1", "1.0.0", "2.0.0", None, False), ("2.0.0-rc1", "1.0.0", "2.0.0", None, True), ("2.0.0rc1", "1.0", "2.0", None, True), ("v1.5.0", "1.5", None, None, True),
             ("1.5.1", "0", None, "1.5.0", False), ("1.5", "0", None, "1.5.0", True), ("1.0.0-rc2", "1.0.0-rc10", None, None, False), ("31.1-jre", "31.1", "32.0", None, True),
             ("1.0.0+build5", "1.0.0", "1.0.1", None, True), ("0.0.0", "0", "0.0.1", None, True), ("20240101.1", "0", "99999999999999999999", None, True)]
    deps = spark.createDataFrame([("r", f"p{i}", v, "npm", "f") for i, (v, *_) in enumerate(cases)], sca.DEPS_SCHEMA)
    adv = spark.createDataFrame([(f"A{i}", f"p{i}", "npm", a, b, c) for i, (_, a, b, c, _) in enumerate(cases)],
                                "id string, name string, ecosystem string, introduced string, fixed string, last_affected string")
    got = {r.package_name for r in sca.match_advisories(deps, adv).collect()}
    assert got == {f"p{i}" for i, c in enumerate(cases) if c[-1]}


def test_advisory_documents(spark):
    doc = ('{"id":"A","aliases":["CVE-1"],"summary":"s","affected":[{"package":{"name":"p","ecosystem":"PyPI"},"ranges":[{"type":"ECOSYSTEM","events":['
           '{"introduced":"0"},{"fixed":"1.0"},{"introduced":"2.0"},{"last_affected":"2.5"},{"introduced":"4"}]},{"type":"GIT","events":[{"introduced":"0"}]}]},'
           '{"package":{"name":"q","ecosystem":"PyPI"},"versions":["7.7","7.8"]}]}')
    raw = spark.createDataFrame([(doc,), ("broken",)], "json string")
    rows = {(r.name, r.introduced, r.fixed, r.last_affected) for r in sca.explode_advisories(raw).collect()}
    assert rows == {("p", "0", "1.0", None), ("p", "2.0", None, "2.5"), ("p", "4", None, None), ("q", None, None, None)}
    files = files_df(spark, [("requirements.txt", "p==0.9\np==1.0\np==2.5\np==3.0\np==4.1\nq==7.7\nq==7.9\n"), ("skip/requirements.txt", "p==0.1")])
    found = sca.sca_scan(files, raw, extra_ignores=["skip"]).collect()
    assert sorted((r.package_name, r.package_version) for r in found) == [("p", "0.9"), ("p", "2.5"), ("p", "4.1"), ("q", "7.7")]
    assert {r.cve for r in found} == {"CVE-1"}


def test_json_manifest_types(spark):
    def names(text, path="package.json"):
        return sorted((r.name, r.version) for r in sca.dependency_inventory(files_df(spark, [(path, text)])).collect())
    assert names('{"dependencies": {"a": "^1.0"}, "devDependencies": {"b": "~2"}}') == [("a", "1.0"), ("b", "2")]
    assert names('{"Dependencies": {"a": "1"}}') == [("a", "1")]
    assert names('{"dependencies": {"a": "1", "b": {"x": 1}}}') == [] and names('{"dependencies": {"a": "1", "c": 3}}') == []
    assert names('{"dependencies": {"a": "1"}, "devDependencies": ["b"]}') == []
    assert names('{"dependencies": {"a": null}, "devDependencies": null}') == [("a", "")]
    assert names("not json") == [] and names("") == []
    assert names('{"require": {"php": ">=8", "x/y": "^2"}}', "composer.json") == [("x/y", "2")]


def test_pubspec_shapes(spark):
    text = ("name: app\nversion: 1.0.0\nenvironment:\n  sdk: '>=3.0.0'\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.2.0  # net\n"
            "  path: '>=1.8.0 <2.0.0'\n  \"quoted\": \"~> 3.1\"\n  any_one: any\n  number: 2\n  local:\n    path: ../local\n  flow: {git: x}\n  empty:\n"
            "# comment\n\ndev_dependencies: {lints: ^3.0.0, test: any}\nother:\n  nope: 1.0.0\n")
    got = sorted((r.name, r.version) for r in sca.deps_pubspec(files_df(spark, [("pubspec.yaml", text)])).collect())
    assert got == [("any_one", "any"), ("empty", ""), ("flow", ""), ("http", "1.2.0"), ("lints", "3.0.0"), ("local", ""), ("number", ""),
                   ("path", "1.8.0 <2.0.0"), ("quoted", "3.1"), ("test", "any")]


def test_building_a_plan_runs_no_job(spark):
    """No job and no cached table before an action."""
    from scanforge.plans.scan import scan
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "building plans")
    files = files_df(spark, [("requirements.txt", "p==0.9"), ("a.py", "eval(x)")])
    blobs = spark.createDataFrame([("r", "c", 1, "a.py", "x")], "repo string, commit_hash string, commit_seq long, path string, content string")
    scan(files, blobs=blobs)
    sca.dependency_inventory(sca.find_manifests(files))
    assert list(tracker.getJobIdsForGroup("plan-only")) == []


def test_strict_manifest_flags(spark):
    gm = files_df(spark, [("go.mod", "require (\n\tgithub.com/c/d v0.1.0\n\t// note here\n)\n")])
    assert _deps(sca.deps_gomod(gm, strict=True)) == [("github.com/c/d", "v0.1.0", "go")]
    gl = files_df(spark, [("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.4)\n    rack (>= 2.2)\n")])
    assert _deps(sca.deps_gemfile(gl, strict=True)) == [("rails", "7.0.4", "rubygems")]


def test_q6_map_ecosystem_both_spellings(spark):
    d = spark.createDataFrame([("a", "pypi"), ("b", "pip"), ("c", "packagist"), ("d", "Composer"), ("e", "cobol")],
                              "name string, ecosystem string")
    got = {r.name: r.db_ecosystem for r in sca.map_ecosystem(d).collect()}
    assert got == {"a": "PyPI", "b": "PyPI", "c": "Packagist", "d": "Packagist"}


def test_cvss_score_entries(spark):
    from scanforge.functions.text import cvss_score
    rows = [([],), ([("CVSS_V4", "9.9"), ("CVSS_V2", "6.4")],), ([("CVSS_V3", "AV:N/AC:H")],)]
    df = spark.createDataFrame(rows, "sev array<struct<type:string,score:string>>")
    got = [r[0] for r in df.select(cvss_score(F.col("sev"))).collect()]
    assert got == [0.0, 6.4, 7.5]
