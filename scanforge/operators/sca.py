"""Dependencies and vulnerabilities.

Manifest "parsers" are native array expressions over one file row: text of a
format -> array of (name, version). One pass over the manifests serves every
format (``CASE format``), so a file is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanforge.constants import DEFAULT_IGNORE_PATHS, ECOSYSTEM_DB_NAME, MANIFEST_NAMES
from scanforge.functions.text import (UNICODE_SPACES, base_name, cvss_score, cvss_severity,
                                      strip_version_prefix, trim_space, utf8_byte_prefix)
from scanforge.operators.findings import min_severity as _min_severity
from scanforge.operators.rules_data import OWASP_NAMES

DEP_COLS = ["repo", "name", "version", "ecosystem", "file"]

# FIXED VALUES: built-in known-vulnerable versions used when no advisory
# table is available: (package, version, cve, severity, cvss, fixed, description).
KNOWN_VULNERABLE = [
    ("log4j-core", "2.14.1", "CVE-2021-44228", "CRITICAL", 10.0, "2.17.1",
     "Log4Shell: Remote code execution via JNDI lookup in log messages"),
    ("log4j-core", "2.14.0", "CVE-2021-44228", "CRITICAL", 10.0, "2.17.1",
     "Log4Shell: Remote code execution via JNDI lookup"),
    ("lodash", "4.17.15", "CVE-2021-23337", "HIGH", 7.2, "4.17.21", "Command injection via template function"),
    ("lodash", "4.17.19", "CVE-2020-28500", "MEDIUM", 5.3, "4.17.21", "Regular expression DoS (ReDoS) vulnerability"),
    ("node-fetch", "2.6.0", "CVE-2022-0235", "HIGH", 8.8, "2.6.7",
     "Exposure of sensitive information to unauthorized actors"),
    ("express", "4.17.1", "CVE-2022-24999", "HIGH", 7.5, "4.18.2", "Open redirect vulnerability in express.static"),
    ("django", "3.2.12", "CVE-2022-28347", "HIGH", 9.8, "3.2.13", "SQL injection via QuerySet.explain() on MySQL"),
    ("django", "4.0.3", "CVE-2022-28347", "HIGH", 9.8, "4.0.4", "SQL injection vulnerability"),
    ("struts2-core", "2.3.34", "CVE-2017-5638", "CRITICAL", 10.0, "2.3.35",
     "RCE via Jakarta Multipart parser (Equifax breach vector)"),
    ("jackson-databind", "2.9.8", "CVE-2019-14379", "CRITICAL", 9.8, "2.9.9.3",
     "Deserialization flaw allows remote code execution"),
    ("requests", "2.27.0", "CVE-2023-32681", "MEDIUM", 6.1, "2.31.0", "Unintended leak of Proxy-Authorization header"),
    ("pillow", "9.0.0", "CVE-2023-44271", "MEDIUM", 7.5, "10.0.1", "Uncontrolled resource consumption in PIL.ImageFont"),
    ("moment", "2.29.1", "CVE-2022-24785", "HIGH", 7.5, "2.29.2", "Path traversal vulnerability"),
    ("moment", "2.29.3", "CVE-2022-31129", "HIGH", 7.5, "2.29.4", "ReDoS vulnerability in parsing logic"),
]

ADVISORY_URL = "https://osv.dev/vulnerability/"
SUPPLY_CHAIN = OWASP_NAMES["A03"]


_SPACE_RUN = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in UNICODE_SPACES) + "]+"


def _fields(c: Column) -> Column:
    """Fields separated by runs of Unicode white space (no empty strings)."""
    return F.filter(F.split(trim_space(c), _SPACE_RUN), lambda x: x != "")


DEPS_SCHEMA = "repo string, name string, version string, ecosystem string, file string"
_ARRAY = "array<struct<name:string,version:string>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {_ARRAY})")


def _dep(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value worked out once: a column named several times in an expression is worked out as often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


# ------------------------------------------------------------ manifests

def find_manifests(files: DataFrame, max_bytes: int | None = None, extra_ignores=()) -> DataFrame:
    """Manifest files by base name; ignored directories pruned (the defaults
    and ``extra_ignores``); ``max_bytes`` leaves larger files out."""
    f = files.where(is_manifest(extra_ignores))
    if max_bytes is not None:
        f = f.where((F.col("size") if "size" in files.columns else F.octet_length("content")) <= max_bytes)
    return f.select("repo", "path", "content")


def is_manifest(extra_ignores=()) -> Column:
    names = [n for ns in MANIFEST_NAMES.values() for n in ns]
    segs = F.split(F.col("path"), "/")
    ignored = F.arrays_overlap(F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(1))),
                               F.array(*[F.lit(x) for x in [*DEFAULT_IGNORE_PATHS, *extra_ignores]])) & (F.size(segs) > 1)
    return base_name(F.col("path")).isin(*names) & ~ignored


def _json_deps(content: Column, keys: tuple, exclude=()) -> Column:
    """Sections of a JSON manifest. Keys match without case; a section or a
    version of the wrong type rejects the file."""
    root = F.map_entries(F.from_json(content, "map<string,string>"))
    wanted = F.filter(root, lambda e: F.lower(e["key"]).isin(*[k.lower() for k in keys]) & e["value"].isNotNull())
    sections = F.transform(wanted, lambda e: F.map_entries(F.from_json(e["value"], "map<string,variant>")))
    # kinds and texts are read off a value once; everything behind it is bound to them
    entries = _bound(sections, lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), F.flatten(found)))
    kept = F.transform(entries, lambda r: F.struct(
        r["key"].alias("key"), r["value"].try_cast("string").alias("text"),
        F.coalesce(F.call_function("schema_of_variant", r["value"]), F.lit("VOID")).isin("STRING", "VOID").alias("good")))

    def deps(rows):
        own = F.filter(rows, lambda r: ~r["key"].isin(*exclude)) if exclude else rows
        made = F.transform(own, lambda r: _dep(r["key"], strip_version_prefix(F.coalesce(r["text"], F.lit("")))))
        return F.when(F.forall(rows, lambda r: r["good"]), made)

    return _bound(kept, deps)


def _requirements(content: Column) -> Column:
    lines = F.filter(F.transform(_split_lines(content), trim_space),
                     lambda t: (t != "") & ~t.startswith("#") & ~t.startswith("-"))

    def cut(t):
        at, width = F.lit(0), F.lit(0)
        for sep in reversed(["==", ">=", "<=", "~=", "!=", ">"]):
            pos = F.instr(t, sep)
            at = F.when(pos > 0, pos).otherwise(at)
            width = F.when(pos > 0, F.lit(len(sep))).otherwise(width)
        return F.struct(t.alias("t"), at.alias("at"), width.alias("width"))

    def dep(x):
        rest = trim_space(F.substr(x["t"], x["at"] + x["width"]))
        return _dep(trim_space(F.substr(x["t"], F.lit(1), x["at"] - 1)), F.split(rest, ",", 2).getItem(0))

    return F.transform(F.filter(F.transform(lines, cut), lambda x: x["at"] > 0), dep)


def _gemfile(content: Column) -> Column:
    lines = _split_lines(content)
    start = F.array_position(F.transform(lines, lambda x: trim_space(x) == "GEM"), True).cast("int")
    part = F.when(start > 0, F.slice(lines, start, F.size(lines) - start + 1))
    rows = F.filter(F.transform(F.filter(part, lambda x: x.contains("(") & x.contains(")")), _fields), lambda f: F.size(f) >= 2)
    return F.transform(rows, lambda f: _dep(f[0], F.regexp_replace(f[1], r"^[()]+|[()]+$", "")))


_BLANKS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in UNICODE_SPACES if ch != "\n") + "]*"


def _gomod(content: Column) -> Column:
    """'require x v' lines and 'require ( ... )' blocks: the text is cut at
    block starts, every part at its first ')' line."""
    parts = F.split(content, rf"(?md)^{_BLANKS}require \({_BLANKS}$", -1)
    cut = F.transform(parts, lambda p: F.split(p, rf"(?md)^{_BLANKS}\){_BLANKS}$", 2))
    inner = F.flatten(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda c: _split_lines(c[0])))
    outer = F.flatten(F.transform(cut, lambda c, k: F.concat(
        F.when(k == 0, _split_lines(c[0])).otherwise(F.array().cast("array<string>")),
        F.when(F.size(c) > 1, _split_lines(c[1])).otherwise(F.array().cast("array<string>")))))
    single = F.filter(F.transform(outer, trim_space), lambda t: t.startswith("require ") & (t != "require ("))
    lines = F.concat(F.transform(inner, trim_space), single)
    lines = F.transform(lines, lambda t: F.when(t.startswith("require "), F.substr(t, F.lit(9))).otherwise(t))
    rows = F.filter(F.transform(lines, _fields), lambda f: F.size(f) >= 2)
    return F.transform(rows, lambda f: _dep(f[0], f[1]))


def _xml_tag(line: Column, tag: str) -> Column:
    o, c = f"<{tag}>", f"</{tag}>"
    s = F.instr(line, o)
    e = F.instr(line, c)
    inner = line.substr(s + len(o), e - s - len(o))
    return F.when((s > 0) & (e > 0) & (e >= s + len(o)), trim_space(inner)).otherwise(F.lit(""))


def _pom(content: Column) -> Column:
    """Lines from one <artifactId> to the next form a group; its first
    <version> (non-empty, not ${...}) is the artifact's."""
    lines = _split_lines(content)
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("<artifactId>"), i + 1)), lambda i: i.isNotNull())
    groups = F.transform(at, lambda p, k: F.slice(lines, p, F.coalesce(F.get(at, k + 1), F.size(lines) + 1) - p))

    def dep(g):
        versions = F.transform(F.filter(g, lambda x: x.contains("<version>")), lambda x: _xml_tag(x, "version"))
        return _dep(_xml_tag(g[0], "artifactId"), F.get(F.filter(versions, lambda v: (v != "") & ~v.startswith("${")), F.lit(0)))

    return F.filter(F.transform(groups, dep), lambda d: (d["name"] != "") & d["version"].isNotNull())


_YAML_PLAIN_OTHER = r"(?i)^(~|null|true|false|yes|no|on|off|[-+]?(\d[\d_]*)?\.?\d+(e[-+]?\d+)?|[-+]?\d+\.?|0x[0-9a-f]+|\.inf|\.nan)?$"


def _yaml_scalar(v: Column) -> Column:
    """Text of a YAML scalar that is a string; '' for any other value."""
    v = trim_space(F.regexp_replace(trim_space(v), r"^(\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'|[^\"'#][^#]*?(?:[^\s]#[^#]*?)*)\s+#.*$", "$1"))
    quoted = v.rlike(r"^(\".*\"|'.*')$")
    plain = ~v.rlike(r"^[{\[&*|>!#%@`]") & ~v.rlike(_YAML_PLAIN_OTHER)
    return F.when(quoted, F.substr(v, F.lit(2), F.length(v) - 2)).when(plain, v).otherwise(F.lit(""))


def _pubspec(content: Column) -> Column:
    """Entries of the top-level maps ``dependencies`` and ``dev_dependencies``
    (minus flutter, sdk), in block or one-line flow style. A value that is no
    string (a nested map, a number) gives an empty version."""
    text = F.regexp_replace(content, "\r", "")
    blocks = F.filter(F.split(text, r"(?md)^(?=[^\s#])", -1), lambda b: b.rlike(r"^(dev_)?dependencies[ \t]*:"))

    def entries(b):
        lines = F.filter(F.slice(_split_lines(b), 2, F.greatest(F.size(_split_lines(b)) - 1, F.lit(0))),
                         lambda x: ~x.rlike(r"^\s*(#.*)?$"))
        indent = F.regexp_extract(F.get(lines, F.lit(0)), r"^( *)", 1)
        own = F.filter(lines, lambda x: F.regexp_extract(x, r"^( *)", 1) == indent)
        flow = F.regexp_extract(F.get(_split_lines(b), F.lit(0)), r"^[a-z_]+[ \t]*:[ \t]*\{(.*)\}", 1)
        return F.concat(F.filter(F.split(flow, ",", -1), lambda x: trim_space(x) != ""), own)

    rows = F.flatten(F.transform(blocks, entries))
    key = r"^\s*(\"[^\"]*\"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?$"
    deps = F.transform(F.filter(rows, lambda r: r.rlike(key)), lambda r: _dep(
        F.regexp_replace(F.regexp_extract(r, key, 1), r"^[\"']|[\"']$", ""),
        strip_version_prefix(_yaml_scalar(F.regexp_extract(r, key, 2)))))
    return F.filter(deps, lambda d: ~d["name"].isin("flutter", "sdk"))


def _by_name(path_col, values: dict[str, str]) -> Column:
    """Value by the manifest's base name: one map lookup, so the expression stays small wherever the optimizer repeats it."""
    pairs = [F.lit(x) for fmt, names in MANIFEST_NAMES.items() if fmt in values for n in names for x in (n, values[fmt])]
    return F.element_at(F.create_map(*pairs), base_name(F.col(path_col) if isinstance(path_col, str) else path_col))


def manifest_format(path_col="path") -> Column:
    """Manifest format from the base name (NULL if not a manifest)."""
    return _by_name(path_col, {fmt: fmt for fmt in MANIFEST_NAMES})


_PARSERS = {
    "npm": ("npm", lambda c: _json_deps(c, ("dependencies", "devDependencies"))),
    "composer": ("packagist", lambda c: _json_deps(c, ("require", "require-dev"), exclude=("php",))),
    "requirements": ("pypi", _requirements),
    "gemfile": ("rubygems", _gemfile),
    "gomod": ("go", _gomod),
    "maven": ("maven", _pom),
    "pubspec": ("pub", _pubspec),
}


def _parse(manifests: DataFrame, formats: list[str]) -> DataFrame:
    """One pass: every manifest row gets its format's dependency array."""
    m = manifests.select("repo", "path", "content", manifest_format("path").alias("_fmt")).where(F.col("_fmt").isin(*formats))
    # the outer form: the optimizer would infer size(array) > 0 from the other and parse every manifest once more for it
    rows = m.select("repo", "path", ecosystem_of("path").alias("ecosystem"), F.explode_outer(dependency_array(formats=formats)).alias("_d"))
    rows = rows.where(F.col("_d").isNotNull())
    return rows.select("repo", F.col("_d.name").alias("name"), F.col("_d.version").alias("version"), "ecosystem", F.col("path").alias("file"))


def ecosystem_of(path: str) -> Column:
    """Ecosystem of a manifest by its name."""
    return _by_name(path, {fmt: name for fmt, (name, _) in _PARSERS.items()})


def dependency_array(fmt: str = "_fmt", content: str = "content", formats: list[str] | None = None) -> Column:
    """array<struct<name,version>> of a file row by its format; empty for other rows."""
    found = _empty()
    for f in formats or _PARSERS:
        found = F.when(F.col(fmt) == f, _PARSERS[f][1](F.col(content)).cast(_ARRAY)).otherwise(found)
    return found


def deps_npm(manifests: DataFrame) -> DataFrame:
    return _parse(manifests, ["npm"])


def deps_composer(manifests: DataFrame) -> DataFrame:
    return _parse(manifests, ["composer"])


def deps_requirements(manifests: DataFrame) -> DataFrame:
    """name/version split at the first of == >= <= ~= != > (in that order)
    found anywhere; version cut at ','. Blank, '#' and '-' lines skipped."""
    return _parse(manifests, ["requirements"])


def deps_gemfile(manifests: DataFrame, strict: bool = False) -> DataFrame:
    """After the line 'GEM', every line with '(' and ')': field 1 is the name,
    field 2 stripped of parentheses is the version. ``strict`` drops entries
    whose "version" is a constraint operator (``>=``, ``~>``...)."""
    out = _parse(manifests, ["gemfile"])
    return out.where(~F.col("version").rlike(r"^[<>=~!]+$")) if strict else out


def deps_gomod(manifests: DataFrame, strict: bool = False) -> DataFrame:
    """'require x v' lines and 'require ( ... )' blocks. ``strict`` drops
    comment lines inside a block (names starting ``//``)."""
    out = _parse(manifests, ["gomod"])
    return out.where(~F.col("name").startswith("//")) if strict else out


def deps_pom(manifests: DataFrame) -> DataFrame:
    return _parse(manifests, ["maven"])


def deps_pubspec(manifests: DataFrame) -> DataFrame:
    return _parse(manifests, ["pubspec"])


def dependency_inventory(manifests: DataFrame, include_pubspec: bool = True) -> DataFrame:
    """Every format in one pass -> (repo, name, version, ecosystem, file)."""
    return _parse(manifests, [f for f in _PARSERS if include_pubspec or f != "pubspec"])


def inventory_stats(deps: DataFrame) -> DataFrame:
    return deps.groupBy("repo").agg(F.count(F.lit(1)).alias("dependencies"),
                                    F.countDistinct("file").alias("manifest_files"))


# ------------------------------------------------------------ matching

def known_vulnerable(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_VULNERABLE, "kv_name string, kv_version string, cve string, severity string, "
                                                   "cvss double, fixed_version string, description string")


def _sca_finding(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", F.lit("SCA").alias("engine"),
        F.col("name").alias("package_name"), F.col("version").alias("package_version"),
        "fixed_version", "ecosystem", F.col("file"),
        "severity", "cve", "cvss", "description",
        F.concat(F.lit(ADVISORY_URL), F.col("adv_id")).alias("advisory_url"),
        F.lit(SUPPLY_CHAIN).alias("owasp"),
        F.col("cve").alias("rule_id"), F.col("name").alias("title"),
    )


def match_known_vulnerable(deps: DataFrame) -> DataFrame:
    """Exact (lower(name), version) lookup in the 14-row built-in table
    (broadcast: fixed size)."""
    j = known_affected(deps, "name", "version")
    return _sca_finding(j.select(*deps.columns, "_adv.*"))


def known_affected(rows: DataFrame, name: str, version: str, outer: bool = False) -> DataFrame:
    """``rows`` with ``_adv`` from the built-in table; ``outer`` keeps the rows without one."""
    kv = known_vulnerable(rows.sparkSession)
    kv = F.broadcast(kv.select("kv_name", "kv_version", F.struct(F.col("cve").alias("adv_id"), "fixed_version", "severity", "cve", "cvss", "description").alias("_adv")))
    return rows.join(kv, (F.lower(rows[name]) == kv.kv_name) & (rows[version] == kv.kv_version), "left" if outer else "inner").drop("kv_name", "kv_version")


def map_ecosystem(deps: DataFrame) -> DataFrame:
    """Add ``db_ecosystem``; dependencies of unknown ecosystems are dropped."""
    m = F.create_map(*[x for k, v in ECOSYSTEM_DB_NAME.items() for x in (F.lit(k), F.lit(v))])
    return deps.withColumn("db_ecosystem", F.element_at(m, F.lower(F.col("ecosystem")))).where(
        F.col("db_ecosystem").isNotNull())


_PRE = r"(?i)^[._-]?(a|alpha|b|beta|c|cr|rc|pre|preview|m|milestone|dev|snapshot)([._-]?[0-9].*)?$"
_AFTER = r"(?i)^[._-]?(final|ga|release|jre|android|post|sp|p|patch|r|rev).*$"


def version_key(c: Column) -> Column:
    """Orderable version key: (release numbers, 0 for a pre-release and 1
    otherwise, parts of what follows).

    Trailing zeros do not count (1.2 equals 1.2.0), numbers compare as numbers
    (1.10 > 1.9), a pre-release stands below its release (1.0.0-rc1 < 1.0.0),
    build metadata (+...) is left out.
    """
    v = F.regexp_replace(F.regexp_replace(trim_space(c), r"^[vV=]+", ""), r"\+.*$", "")
    numbers = F.regexp_replace(F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"(?:^|\.)0*(?:\.0*)*$", "")
    release = F.when(numbers == "", F.array().cast("array<decimal(38,0)>")).otherwise(
        F.transform(F.split(numbers, r"\."), lambda p: p.try_cast("decimal(38,0)")))
    rest = F.regexp_replace(v, r"^[0-9]+(?:\.[0-9]+)*", "")
    before = (rest != "") & (rest.rlike(_PRE) | (rest.startswith("-") & ~rest.rlike(_AFTER)))
    parts = F.filter(F.split(F.lower(F.regexp_replace(rest, r"([0-9]+)", ".$1.")), r"[._-]+"), lambda x: x != "")
    tail = F.transform(parts, lambda x: F.struct(
        F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(38,0)")).alias("n"), x.alias("s")))
    return F.when(c.isNotNull(), F.struct(release.alias("release"), F.when(before, 0).otherwise(1).alias("final"), tail.alias("tail")))


_RANGE_COLS = {"introduced": "string", "fixed": "string", "last_affected": "string", "versions": "array<string>",
               "score": "double", "cve": "string", "summary": "string"}


def match_advisories(deps: DataFrame, advisories: DataFrame, salts: int = 1) -> DataFrame:
    """deps x advisories on (ecosystem, name) with the affected-range test
    introduced <= v < fixed (or v <= last_affected), or v listed.

    ``advisories`` has one row per package interval (``explode_advisories``, or
    a flat table). The intervals of a package become one array, so the
    dependencies are read once and joined once; a popular package is spread
    by the adaptive skew join, or over ``salts`` tasks, each with a copy of every package. An advisory that hits by several intervals gives one
    finding per dependency row."""
    j = affected(deps, advisories, "name", "version", "ecosystem", [c for c in ("repo", "file", "version") if c in deps.columns], salts)
    return _sca_finding(j.select(*deps.columns, "_adv.*"))


def affected(rows: DataFrame, advisories: DataFrame, name: str, version: str, ecosystem: str, spread_by: list[str],
             salts: int = 1, outer: bool = False) -> DataFrame:
    """``rows`` with ``_adv`` (adv_id, fixed_version, severity, cve, cvss, description), a row per advisory that hits.

    ``outer`` keeps the rows without a name, dealt by ``spread_by`` over all tasks
    should the packages be too many to broadcast, and may keep named rows without one."""
    cols = set(advisories.columns)
    a = advisories.select(F.col("id"), F.col("name").alias("_name"), F.lower("ecosystem").alias("_eco"), *[
        (F.col(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in _RANGE_COLS.items()])
    one = F.struct("id", "cve", "summary", "score", "fixed", "versions",
                   (F.col("introduced").isNotNull() | F.col("fixed").isNotNull() | F.col("last_affected").isNotNull()).alias("ranged"),
                   version_key(F.col("introduced")).alias("ik"), version_key(F.col("fixed")).alias("fk"),
                   version_key(F.col("last_affected")).alias("lk"))
    packages = a.groupBy("_eco", "_name").agg(F.collect_list(one).alias("_ranges"))
    packages = packages.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    h = F.xxhash64(*spread_by)
    d = rows.withColumns({"_eco": F.lower(ecosystem), "_name": F.col(name),
                          "_salt": F.when(F.col(name).isNull(), F.pmod(h, F.lit(1 << 30))).otherwise(F.pmod(h, F.lit(salts))).cast("int")})
    j = d.join(packages, ["_eco", "_name", "_salt"], "left" if outer else "inner")
    if outer:  # a dependency of no named package leaves before its version is read
        j = j.where(F.col(name).isNull() | F.col("_ranges").isNotNull())
    j = j.withColumn("_vk", version_key(F.col(version)))
    hit = F.filter("_ranges", lambda r: (
        r["ranged"] & (r["ik"].isNull() | (F.col("_vk") >= r["ik"])) & (r["fk"].isNull() | (F.col("_vk") < r["fk"]))
        & (r["lk"].isNull() | (F.col("_vk") <= r["lk"])))
        | F.coalesce(F.array_contains(r["versions"], F.col(version)), F.lit(False)))
    # one finding per advisory: the interval with the lowest fix
    first = F.array_sort(F.transform(hit, lambda r: F.struct(r["id"].alias("id"), r["fk"].alias("fk"), r["cve"].alias("cve"),
                                                                      r["fixed"].alias("fixed"), r["score"].alias("score"), r["summary"].alias("summary"))))
    once = _bound(first, lambda a: F.filter(a, lambda r, k: (k == 0) | (F.array_position(F.transform(a, lambda x: x["id"]), r["id"]) == k + 1)))
    # the outer form: the optimizer would infer size(once) > 0 from the other and test every dependency once more for it
    j = j.select(*rows.columns, F.explode_outer(once).alias("_h"))
    if not outer:
        j = j.where(F.col("_h").isNotNull())
    score = F.coalesce(F.col("_h.score"), F.lit(0.0))
    adv = F.struct(F.col("_h.id").alias("adv_id"), F.col("_h.fixed").alias("fixed_version"), cvss_severity(score).alias("severity"),
                   F.coalesce(F.col("_h.cve"), F.col("_h.id")).alias("cve"), score.alias("cvss"),
                   F.coalesce(F.col("_h.summary"), F.lit("")).alias("description"))
    return j.withColumn("_adv", F.when(F.col("_h").isNotNull(), adv)).drop("_h")


OSV_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("severity", T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                                        T.StructField("score", T.StringType())]))),
    T.StructField("affected", T.ArrayType(T.StructType([
        T.StructField("package", T.StructType([T.StructField("name", T.StringType()),
                                               T.StructField("ecosystem", T.StringType())])),
        T.StructField("ranges", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("events", T.ArrayType(T.StructType([
                T.StructField("introduced", T.StringType()), T.StructField("fixed", T.StringType()),
                T.StructField("last_affected", T.StringType())]))),
        ]))),
        T.StructField("versions", T.ArrayType(T.StringType())),
    ]))),
])


def _advisory_columns(v: DataFrame) -> dict[str, Column]:
    details = F.coalesce(F.col("details"), F.lit(""))
    summary = F.coalesce(F.col("summary"), F.lit(""))
    score = cvss_score(F.coalesce(F.col("severity"), F.array().cast("array<struct<type:string,score:string>>")))
    cut = F.when(F.octet_length(details) > 200, F.concat(utf8_byte_prefix(details, 200), F.lit("..."))).otherwise(details)
    return {
        "cve": F.coalesce(F.try_element_at(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(1)), F.col("id")),
        "description": F.when(summary != "", summary).otherwise(details),
        "short_description": F.when(summary != "", summary).otherwise(cut),
        "cvss": score, "severity": cvss_severity(score),
    }


def normalize_advisory(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Advisory JSON -> id, cve (first CVE- alias, else id), fixed (first
    non-empty fixed event in array order), description (summary, else the
    details; ``short_description`` cuts them at 200 bytes), cvss, severity."""
    v = raw.select(F.from_json(F.col(json_col), OSV_SCHEMA).alias("v")).select("v.*")
    events = F.flatten(F.flatten(F.transform("affected", lambda af: F.transform(af["ranges"], lambda r: r["events"]))))
    fixed = F.coalesce(F.try_element_at(F.filter(F.transform(events, lambda e: e["fixed"]),
                                                 lambda x: x.isNotNull() & (x != "")), F.lit(1)), F.lit(""))
    return v.select("id", fixed.alias("fixed"), *[c.alias(n) for n, c in _advisory_columns(v).items()])


def explode_advisories(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Advisory JSON -> one row per package interval: id, cve, name, ecosystem,
    introduced, fixed, last_affected, versions, score, summary.

    The events of a range are read in order: every ``introduced`` opens an
    interval that the next ``fixed`` or ``last_affected`` closes; one left open
    has neither. Commit ranges (GIT) hold no versions and are left out; a
    package with listed versions only gives one row without an interval."""
    v = raw.select(F.from_json(F.col(json_col), OSV_SCHEMA).alias("v")).select("v.*")
    c = _advisory_columns(v)
    v = v.select("id", c["cve"].alias("cve"), c["cvss"].alias("score"), c["description"].alias("summary"), F.explode("affected").alias("a"))
    no_ranges = F.expr("cast(array() as array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>)")
    ranges = F.filter(F.coalesce(F.col("a.ranges"), no_ranges), lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")

    def intervals(r):
        e = r["events"]
        opened = F.filter(F.transform(e, lambda x, i: F.when(x["introduced"].isNotNull(), i)), lambda i: i.isNotNull())
        def close(i, k):
            to = F.coalesce(F.get(opened, k + 1), F.size(e))
            inner = F.slice(e, i + 2, F.greatest(to - i - 1, F.lit(0)))
            first = F.get(F.filter(inner, lambda x: x["fixed"].isNotNull() | x["last_affected"].isNotNull()), F.lit(0))
            return F.struct(F.get(e, i)["introduced"].alias("introduced"), first["fixed"].alias("fixed"), first["last_affected"].alias("last_affected"))
        return F.transform(opened, close)

    found = F.flatten(F.transform(ranges, intervals))
    none = F.expr("array(named_struct('introduced', cast(null as string), 'fixed', cast(null as string), 'last_affected', cast(null as string)))")
    rows = v.select("id", "cve", "score", "summary", F.col("a.package.name").alias("name"), F.col("a.package.ecosystem").alias("ecosystem"),
                    F.col("a.versions").alias("versions"), F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("r"))
    return rows.select("id", "cve", "name", "ecosystem", "r.introduced", "r.fixed", "r.last_affected", "versions", "score", "summary")


def advisory_intervals(advisories: DataFrame) -> DataFrame:
    """Raw documents (a ``json`` column) or an interval table -> an interval table."""
    return explode_advisories(advisories) if "json" in advisories.columns else advisories


def sca_scan(files: DataFrame, advisories: DataFrame | None = None, min_severity: str = "LOW",
             extra_ignores=(), max_bytes: int | None = None) -> DataFrame:
    """manifests -> dependencies -> advisory match (or the built-in table when
    no advisory table is available) -> severity filter. ``advisories`` is an
    interval table or raw advisory documents (a ``json`` column)."""
    deps = dependency_inventory(find_manifests(files, max_bytes, extra_ignores))
    if advisories is None:
        findings = match_known_vulnerable(deps)
    else:
        findings = match_advisories(deps, advisory_intervals(advisories))
    return _min_severity(findings, min_severity)
