"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same rows (column names aliased alike).

Every query reads the driver tables (or views Spark derives from them), so
its work grows with the data. Spark side: the library operators. SQL side:
written independently (RE2 patterns as in the rule data).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.constants import ECOSYSTEM_DB_NAME
from scanforge.operators.rules import builtin_rule_rows
from scanforge.operators.secrets import IGNORED_SUFFIX
from scanforge.plans import oracle as O
from scanforge.sources import views as V
from scanforge.sources.rule_samples import samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def corpus(spark, sf):
    return V.corpus(spark, sf)


def documents(spark, sf):
    return V.table(spark, sf, "documents")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# ===================================================================== §2.3 SAST

_SAST_HITS = (O.with_views("corpus", "deps", "advisories") + ",\n" + O.sast_rules_values() + ",\n" + O.FILES_SQL + ",\n"
              + O.SAST_LINES_SQL + ",\nhits AS (" + O.sast_line_hits("sast_lines") + ")")

_SAST_FINDINGS = _SAST_HITS + """,
findings AS (
  SELECT concat_ws('-', h.rule_id, regexp_extract(h.path, '[^/]*$'), CAST(h.line_no AS VARCHAR)) AS finding_id,
         h.repo, h.rule_id, r.severity, h.path AS file, h.line_no AS line, h.col AS "column", r.title, r.cwe,
         r.cvss, r.owasp, h.language,
         array_to_string(list_slice(h.lines, greatest(h.line_no - 3, 1), least(h.line_no + 3, len(h.lines))), chr(10)) AS code
  FROM hits h JOIN sast_rules r ON h.rule_id = r.rule_id)"""


def _sast_cols(df):
    return df.select("finding_id", "repo", "rule_id", "severity", "file", *_long("line", "column"),
                     "title", "cwe", "cvss", "owasp", "language", "code")


@register("sast_scan", _SAST_FINDINGS + "\nSELECT * FROM findings")
def q_sast_scan(spark, sf):
    from scanforge.operators.sast import sast_scan
    return _sast_cols(sast_scan(corpus(spark, sf)))


@register("match_rules", _SAST_HITS + "\nSELECT repo, path, line_no, rule_id, col AS \"column\" FROM hits")
def q_match_rules(spark, sf):
    from scanforge.operators.matching import explode_lines
    from scanforge.operators.sast import match_rules
    from scanforge.sources.files import detect_language, ignore_paths
    files = detect_language(ignore_paths(corpus(spark, sf))).where(F.col("language").isNotNull())
    hits = match_rules(explode_lines(files, final_empty=False))
    return hits.select("repo", "path", *_long("line_no", "column"), "rule_id")


def _word_rules(spark, sf):
    """A rule table made from the words of the benchmark texts, one rule a word."""
    words = V.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    return words.select(F.concat(F.lit("W-"), "w").alias("rule_id"), F.lit("Generic").alias("language"), F.concat(F.lit(r"\b"), "w", F.lit(r"\b")).alias("pattern"),
                        F.lit("LOW").alias("severity"), F.row_number().over(Window.orderBy("w")).alias("rule_ord"))


@register("match_rules_indexed", _SAST_HITS + r""",
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS w FROM benchmark),
tokens AS (SELECT repo, path, line_no, line, unnest(list_distinct(regexp_extract_all(line, '[0-9A-Za-z_]+'))) AS w FROM sast_lines)
SELECT repo, path, line_no, rule_id, col AS "column" FROM hits
UNION ALL SELECT repo, path, line_no, 'W-' || w, strlen(regexp_extract(line, '(?s)^(.*?)\b' || w || '\b', 1)) + 1 FROM tokens JOIN words USING (w)""")
def q_match_rules_indexed(spark, sf):
    """Built-in rules and a rule for every word of the benchmark, through the gram index."""
    from scanforge.operators.gram_index import match_rules_indexed
    from scanforge.operators.matching import explode_lines
    from scanforge.operators.rules import builtin_rules, merge_rules
    from scanforge.sources.files import detect_language, ignore_paths
    files = detect_language(ignore_paths(corpus(spark, sf))).where(F.col("language").isNotNull())
    rules = merge_rules(builtin_rules(spark), _word_rules(spark, sf))
    hits = match_rules_indexed(explode_lines(files, final_empty=False), rules)
    return hits.select("repo", "path", *_long("line_no", "column"), "rule_id")


@register("suppress_mitigated", _SAST_HITS + "\nSELECT repo, path, line_no, rule_id FROM hits "
          "WHERE rule_id IN ('JS-014', 'HTML-003')")
def q_suppress_mitigated(spark, sf):
    from scanforge.operators.rules import builtin_rules
    from scanforge.operators.sast import sast_scan
    rules = builtin_rules(spark).where(F.col("anti_pattern").isNotNull())
    f = sast_scan(corpus(spark, sf), rules)
    return f.select("repo", F.col("file").alias("path"), F.col("line").cast("long").alias("line_no"), "rule_id")


@register("finding_id", _SAST_FINDINGS + "\nSELECT finding_id, rule_id FROM findings")
def q_finding_id(spark, sf):
    return q_sast_scan(spark, sf).select("finding_id", "rule_id")


@register("snippet", _SAST_FINDINGS + "\nSELECT finding_id, line, code FROM findings")
def q_snippet(spark, sf):
    return q_sast_scan(spark, sf).select("finding_id", "line", "code")


@register("match_column", _SAST_FINDINGS + "\nSELECT finding_id, line, \"column\" FROM findings")
def q_match_column(spark, sf):
    return q_sast_scan(spark, sf).select("finding_id", "line", "column")


# HTML pages as files: every page is scanned with the HTML rules
_PAGES_SAST = ("WITH " + O.sast_rules_values()[0:] + """,
files AS (SELECT 'pages' AS repo, concat('site/p', CAST(page_id AS VARCHAR), '.html') AS path, html AS content,
                 'HTML' AS language FROM pages),
""" + O.SAST_LINES_SQL + ",\nhits AS (" + O.sast_line_hits("sast_lines") + """)
SELECT h.path AS file, h.line_no AS line, h.rule_id, r.severity, h.col AS "column" FROM hits h JOIN sast_rules r USING (rule_id)""")


@register("sast_scan_pages", _PAGES_SAST)
def q_sast_scan_pages(spark, sf):
    from scanforge.operators.sast import sast_scan
    p = V.table(spark, sf, "pages")
    files = p.select(F.lit("pages").alias("repo"),
                     F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
                     F.col("html").alias("content"))
    f = sast_scan(files)
    return f.select("file", *_long("line", "column"), "rule_id", "severity")


@register("iac_scan", _SAST_FINDINGS + "\nSELECT finding_id, rule_id, severity FROM findings "
          "WHERE language IN ('Terraform', 'Kubernetes') AND rule_id SIMILAR TO '(TF|K8S)-.*'")
def q_iac_scan(spark, sf):
    from scanforge.operators.sast import iac_scan
    return iac_scan(corpus(spark, sf)).select("finding_id", "rule_id", "severity")


# ===================================================================== §2.4 secrets

# documents as lines for the bare matchers
_DOC_LINES = """doc_lines AS MATERIALIZED (SELECT doc_id, line_no, line FROM (
    SELECT doc_id, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents)))"""

_CORPUS_LINES = """corpus_lines AS MATERIALIZED (SELECT repo, path, line_no, line FROM (
    SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
    FROM (SELECT repo, path, string_split(content, chr(10)) AS arr FROM corpus)))"""

_MATCH_SECRETS = (O.with_views("corpus") + ",\n" + O.leak_rules_values() + ",\n" + _CORPUS_LINES + ",\nlh AS ("
                  + O.leak_line_hits("corpus_lines") + ")\n")


def _doc_lines(spark, sf):
    from scanforge.operators.matching import explode_lines
    d = documents(spark, sf).select("doc_id", F.col("text").alias("content"))
    return explode_lines(d)


def _corpus_lines(spark, sf):
    from scanforge.operators.matching import explode_lines
    return explode_lines(corpus(spark, sf))


@register("match_secrets", _MATCH_SECRETS + "SELECT repo, path, line_no, rule_id, m AS match FROM lh")
def q_match_secrets(spark, sf):
    from scanforge.operators.secrets import match_secrets
    h = match_secrets(_corpus_lines(spark, sf))
    return h.select("repo", "path", F.col("line_no").cast("long"), "rule_id", "match")


@register("match_secrets_indexed", _MATCH_SECRETS + "SELECT repo, path, line_no, rule_id, m AS match FROM lh")
def q_match_secrets_indexed(spark, sf):
    """The secret rules through the gram index."""
    from scanforge.operators.gram_index import match_secrets_indexed
    h = match_secrets_indexed(_corpus_lines(spark, sf))
    return h.select("repo", "path", F.col("line_no").cast("long"), "rule_id", "match")


@register("redact", _MATCH_SECRETS + "SELECT repo, path, line_no, rule_id, " + O.redact_sql("m") + " AS redacted FROM lh")
def q_redact(spark, sf):
    from scanforge.functions.text import redact
    from scanforge.operators.secrets import match_secrets
    h = match_secrets(_corpus_lines(spark, sf))
    return h.select("repo", "path", F.col("line_no").cast("long"), "rule_id", redact("match").alias("redacted"))


@register("shannon_entropy", "SELECT item_id, round(" + O.entropy_sql("text") + ", 6) AS entropy FROM benchmark")
def q_shannon_entropy(spark, sf):
    from scanforge.functions.text import shannon_entropy
    b = V.table(spark, sf, "benchmark")
    return b.select("item_id", F.round(shannon_entropy("text"), 6).alias("entropy"))


_LEAK_TAIL = (""",
leak_files AS (SELECT * FROM files WHERE (language IS NOT NULL OR ext IN ("""
               + ", ".join(O.q(x) for x in O.LEAK_ONLY_EXTENSIONS) + ")) AND " + O.leak_admit_sql("content") + """),
leak_lines AS MATERIALIZED (SELECT repo, path, line_no, line FROM (
    SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
    FROM (SELECT repo, path, string_split(content, chr(10)) AS arr FROM leak_files))
  WHERE """ + O.leak_line_keep_sql("line") + """),
lh AS (""" + O.leak_line_hits("leak_lines") + """),
gated AS (SELECT lh.*, r.leak_type, r.severity, r.description,
                 CASE WHEN contains(r.leak_type, 'Generic') OR contains(r.leak_type, 'High Entropy')
                      THEN """ + O.entropy_sql("lh.m") + """ ELSE 0.0 END AS entropy,
                 contains(r.leak_type, 'Generic') OR contains(r.leak_type, 'High Entropy') AS gated_rule
          FROM lh JOIN leak_rules r USING (rule_id)),
leaks AS (SELECT repo, path AS file, line_no AS line, rule_id, severity, leak_type AS title, description,
                 """ + O.redact_sql("m") + """ AS match, round(entropy, 6) AS entropy
          FROM gated WHERE NOT gated_rule OR entropy >= 3.5)
""")
_LEAK_FILES = O.with_views("corpus") + ",\n" + O.leak_rules_values() + ",\n" + O.FILES_SQL + _LEAK_TAIL


def _leak_cols(df):
    return df.select("repo", "file", F.col("line").cast("long"), "rule_id", "severity", "title", "description",
                     "match", "entropy")


@register("leak_scan", _LEAK_FILES + "SELECT * FROM leaks")
def q_leak_scan(spark, sf):
    from scanforge.operators.secrets import leak_scan
    from scanforge.sources.files import admit_files, ignore_paths
    return _leak_cols(leak_scan(admit_files(ignore_paths(corpus(spark, sf)))))


@register("entropy_gate", _LEAK_FILES + "SELECT repo, path, line_no, rule_id, round(entropy, 6) AS entropy, "
          "entropy >= 3.5 AS kept FROM gated WHERE gated_rule")
def q_entropy_gate(spark, sf):
    from scanforge.functions.text import shannon_entropy
    from scanforge.operators.catalog import Catalog
    from scanforge.operators.matching import match_files
    from scanforge.plans.scan import prepare_files
    c = prepare_files(corpus(spark, sf), sast=False, leaks=True)
    cat = Catalog(spark, sast=False)
    hits = match_files(c, None, cat.leak_specs, ["repo", "path"], with_snippet=False)
    j = hits.join(cat.df(), "k").where("entropy_gated")
    e = shannon_entropy(F.col("m"))
    return j.select("repo", "path", F.col("line_no").cast("long"), "rule_id", F.round(e, 6).alias("entropy"),
                    (e >= 3.5).alias("kept"))


@register("skip_leak_lines", "WITH " + _DOC_LINES + "\nSELECT doc_id, line_no FROM doc_lines WHERE "
          + O.leak_line_keep_sql("line") + " AND strlen(line) <= 800")
def q_skip_leak_lines(spark, sf):
    from scanforge.operators.matching import skip_leak_lines
    return skip_leak_lines(_doc_lines(spark, sf), max_bytes=800).select("doc_id", F.col("line_no").cast("long"))


_CONV_LINES = """conv_lines AS MATERIALIZED (SELECT conv_id, turn, line_no,
       CASE WHEN suffix(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line FROM (
    SELECT conv_id, turn, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS raw
    FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS arr FROM conversations)))"""


@register("scan_lines", O.with_views("corpus") + ",\n" + O.leak_rules_values() + """,
text_lines AS MATERIALIZED (SELECT repo || ':' || path AS id, line_no,
       CASE WHEN suffix(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line FROM (
    SELECT repo, path, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS raw
    FROM (SELECT repo, path, string_split(content, chr(10)) AS arr FROM corpus))),
lh AS (""" + O.leak_line_hits("(SELECT 'c' AS repo, id AS path, line_no, line FROM text_lines)")
          + ")\nSELECT path AS id, line_no, rule_id, " + O.redact_sql("m") + " AS match FROM lh")
def q_scan_lines(spark, sf):
    """Every secret rule on every line of free text (here: the corpus texts)."""
    from scanforge.operators.secrets import scan_lines
    c = corpus(spark, sf).select(F.concat_ws(":", "repo", "path").alias("id"), F.col("content").alias("text"))
    return scan_lines(c).select("id", F.col("line_no").cast("long"), "rule_id", "match")


def _nested_redact_sql(col: str) -> str:
    expr = col
    for (rid, name, pat, sev, desc, conf, hints, ordn) in O.leak_rule_rows():
        expr = f"regexp_replace({expr}, {O.q(pat)}, '***REDACTED***', 'g')"
    return expr


@register("redact_corpus", O.with_views("corpus") + ",\n" + _CORPUS_LINES + ",\nrl AS (SELECT repo, path, line_no, "
          + _nested_redact_sql("line") + " AS line FROM corpus_lines)\n"
          "SELECT repo, path, count(*) FILTER (WHERE contains(line, '***REDACTED***')) AS masked_lines, "
          "sha256(string_agg(line, chr(10) ORDER BY line_no)) AS text_sha256 FROM rl GROUP BY ALL")
def q_redact_corpus(spark, sf):
    from scanforge.operators.secrets import redact_corpus
    r = redact_corpus(corpus(spark, sf))
    masked = F.filter(F.split("content", "\n", -1), lambda x: x.contains("***REDACTED***"))
    return r.select("repo", "path", F.size(masked).cast("long").alias("masked_lines"),
                    F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"))


# ===================================================================== every rule

_SAMPLE_ROWS = samples()
_SAMPLES_SQL = "samples AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {O.q(e)}, {O.q(x)})" for i, e, x in _SAMPLE_ROWS) + ") AS t(slot, ext, sample))"
_SAMPLE_CORPUS_SQL = "WITH " + _SAMPLES_SQL + f""",
corpus AS (SELECT 'rules' AS repo, 'f' || doc_id || ext AS path, text || chr(10) || sample AS content
           FROM documents JOIN samples ON doc_id % {len(_SAMPLE_ROWS)} = slot)"""


def sample_corpus(spark, sf):
    """Documents, each with the line of one rule or its near miss, in a file of the rule's language."""
    slots = F.broadcast(spark.createDataFrame(_SAMPLE_ROWS, "slot int, ext string, sample string"))  # two rows a rule
    d = documents(spark, sf).join(slots, F.col("doc_id") % len(_SAMPLE_ROWS) == F.col("slot"))
    return d.select(F.lit("rules").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), "ext").alias("path"),
                    F.concat("text", F.lit("\n"), "sample").alias("content"))


_SAMPLE_HITS = (_SAMPLE_CORPUS_SQL + ",\n" + O.sast_rules_values() + ",\n" + O.FILES_SQL + ",\n" + O.SAST_LINES_SQL
                + ",\nhits AS (" + O.sast_line_hits("sast_lines") + ")")


@register("every_rule", _SAMPLE_HITS + "\nSELECT path, line_no, rule_id, col AS \"column\" FROM hits")
def q_every_rule(spark, sf):
    from scanforge.operators.sast import sast_scan
    f = sast_scan(sample_corpus(spark, sf))
    return f.select(F.col("file").alias("path"), F.col("line").cast("long").alias("line_no"), "rule_id", F.col("column").cast("long").alias("column"))


@register("every_iac_rule", _SAMPLE_HITS.replace(O.LANG_CASE, O.LANG_CASE.replace(" END", " WHEN '.yaml' THEN 'Kubernetes' WHEN '.yml' THEN 'Kubernetes' END"))
          + "\nSELECT path, line_no, rule_id FROM hits WHERE language IN ('Terraform', 'Kubernetes') AND rule_id SIMILAR TO '(TF|K8S)-.*'")
def q_every_iac_rule(spark, sf):
    from scanforge.operators.sast import iac_scan
    f = iac_scan(sample_corpus(spark, sf))
    return f.select(F.col("file").alias("path"), F.col("line").cast("long").alias("line_no"), "rule_id")


@register("every_secret_rule", _SAMPLE_CORPUS_SQL + ",\n" + O.leak_rules_values() + ",\n" + _CORPUS_LINES + ",\nlh AS (" + O.leak_line_hits("corpus_lines")
          + ")\nSELECT path, line_no, rule_id, m AS match FROM lh")
def q_every_secret_rule(spark, sf):
    from scanforge.operators.matching import explode_lines
    from scanforge.operators.secrets import match_secrets
    h = match_secrets(explode_lines(sample_corpus(spark, sf)))
    return h.select("path", F.col("line_no").cast("long"), "rule_id", "match")


CUSTOM_YAML = """rules:
  - {id: CU-1, language: py, severity: info, title: named group, pattern: '(?P<w>ther)[[:alpha:]]{3}\\b', owasp: A05, cwe: CWE-1, cvss: 5}
  - {id: CU-2, language: golang, severity: HIGH, title: inner flag, pattern: 'th(?i:ED)\\S+', owasp: none, cwe: CWE-2}
  - {id: CU-3, language: unknown, severity: critical, title: any letters, pattern: '^[^\\PLa-y]\\pL*'}
  - {id: CU-4, language: js, pattern: 'x[a[]'}
  - {id: CU-4, language: js, pattern: '\\b[A-Z&&]\\W*\\B'}
  - {id: BAD-1, pattern: 'a(?=b)'}
  - {id: BAD-2, pattern: 'a(b'}
  - {pattern: 'no id'}
"""
_CUSTOM_RX = [("CU-1", "Python", "MEDIUM", r"(?P<w>ther)[[:alpha:]]{3}\b"), ("CU-2", "Go", "HIGH", r"th(?i:ED)\S+"), ("CU-3", None, "CRITICAL", r"^[^\PLa-y]\pL*"),
              ("CU-4", "JavaScript", "MEDIUM", r"x[a[]"), ("CU-4", "JavaScript", "MEDIUM", r"\b[A-Z&&]\W*\B")]


@register("custom_rules_scan", _SAST_HITS + "\n" + "\nUNION ALL\n".join(
    f"SELECT repo, path, line_no, {O.q(i)} AS rule_id, {O.q(sev)} AS severity FROM sast_lines WHERE {'language IS NOT NULL' if lang is None else 'language = ' + O.q(lang)} "
    f"AND regexp_matches(sline, {O.q(rx)})" for i, lang, sev, rx in _CUSTOM_RX)
    + "\nUNION ALL SELECT repo, path, line_no, h.rule_id, severity FROM hits h JOIN sast_rules USING (rule_id)")
def q_custom_rules_scan(spark, sf):
    """A rule file, loaded, normalised and merged with the built-in rules; its bad entries stay behind."""
    from scanforge.operators.rules import builtin_rules, load_rules, merge_rules
    from scanforge.operators.sast import sast_scan
    folder = _scratch(spark, "rules")
    _put(spark, f"{folder}/team.yaml", CUSTOM_YAML)
    rules, _ = load_rules(spark, folder)
    f = sast_scan(corpus(spark, sf), merge_rules(builtin_rules(spark), rules))
    return f.select("repo", F.col("file").alias("path"), F.col("line").cast("long").alias("line_no"), "rule_id", "severity")


def _put(spark, path, text):
    """A small file on the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


# ===================================================================== §2.6 findings / flagship

def _vkey_sql(c):
    return (f"list_transform(string_split(regexp_replace({c}, '^[vV]', ''), '.'), "
            "lambda p: coalesce(TRY_CAST(nullif(regexp_extract(p, '^([0-9]+)', 1), '') AS BIGINT), 0))")


_CVSS_SEV_SQL = ("CASE WHEN {s} >= 9.0 THEN 'CRITICAL' WHEN {s} >= 7.0 THEN 'HIGH' WHEN {s} >= 4.0 THEN 'MEDIUM' "
                 "WHEN {s} > 0 THEN 'LOW' ELSE 'HIGH' END")

_SCAN_SQL = (_SAST_FINDINGS.replace(O.sast_rules_values(), O.sast_rules_values() + ",\n" + O.leak_rules_values())
             + _LEAK_TAIL + """,
vulnerable AS (SELECT d.manifest, d.name, a.id, a.score FROM deps d JOIN advisories a ON a.ecosystem = 'pypi' AND d.name = a.name
  WHERE """ + _vkey_sql("d.version") + " >= " + _vkey_sql("a.introduced") + " AND " + _vkey_sql("d.version") + " < " + _vkey_sql("a.fixed") + """),
all_findings AS (
  SELECT repo, 'SAST' AS engine, rule_id, severity, file, line, "column", title, NULL AS match, NULL::DOUBLE AS entropy, code
  FROM findings
  UNION ALL
  SELECT repo, 'Leaks' AS engine, rule_id, severity, file, line, NULL AS "column", title, match, entropy, NULL AS code FROM leaks
  UNION ALL
  SELECT 'repo' || (CAST(regexp_extract(manifest, '[0-9]+') AS BIGINT) % 20), 'SCA', id, """ + _CVSS_SEV_SQL.format(s="score") + """, manifest, NULL, NULL,
         name, NULL, NULL, NULL FROM vulnerable)
""")


def _scan_cols(df):
    return df.select("repo", "engine", "rule_id", "severity", "file", *_long("line", "column"), "title", "match",
                     "entropy")


def flagship_files(spark, sf):
    """The corpus with a manifest per order among its repositories."""
    m = _manifests(spark, sf)
    repo = F.concat(F.lit("repo"), (F.regexp_extract("path", "[0-9]+", 0).cast("long") % 20).cast("string"))
    return corpus(spark, sf).unionByName(m.select(repo.alias("repo"), "path", "content"))


def flagship(spark, sf, **kw):
    """Every engine over one file table."""
    from scanforge.plans.scan import scan
    return scan(flagship_files(spark, sf), advisories=V.advisories(spark, sf), **kw)


@register("scan", _SCAN_SQL + "SELECT * EXCLUDE (code) FROM all_findings")
def q_scan(spark, sf):
    return _scan_cols(flagship(spark, sf))


@register("combine_findings", _SCAN_SQL + "SELECT engine, count(*) AS n FROM all_findings GROUP BY ALL")
def q_combine_findings(spark, sf):
    return flagship(spark, sf).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


_STATS_SQL = _SCAN_SQL + """, stats AS (
  SELECT repo, count(*) AS total_findings,
         count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
         count(*) FILTER (WHERE severity = 'HIGH') AS high,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
         count(*) FILTER (WHERE severity = 'LOW') AS low,
         count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')) AS info,
         count(*) FILTER (WHERE engine = 'SAST') AS sast_count,
         count(*) FILTER (WHERE engine = 'SCA') AS sca_count,
         count(*) FILTER (WHERE engine = 'Leaks') AS leaks_count
  FROM all_findings GROUP BY repo)
"""

_STAT_COLS = ["total_findings", "critical", "high", "medium", "low", "info", "sast_count", "sca_count",
              "leaks_count"]


def _stats(spark, sf):
    from scanforge.operators.findings import finding_stats
    st = finding_stats(flagship(spark, sf))
    return st.select("repo", *_long(*_STAT_COLS))


@register("finding_stats", _STATS_SQL + "SELECT * FROM stats")
def q_finding_stats(spark, sf):
    return _stats(spark, sf)


@register("verdict", _STATS_SQL + """SELECT repo, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high'
    WHEN total_findings = 0 THEN 'clean' ELSE 'low/medium' END AS verdict FROM stats""")
def q_verdict(spark, sf):
    from scanforge.operators.findings import verdict
    return verdict(_stats(spark, sf)).select("repo", "verdict")


@register("gate", _STATS_SQL + "SELECT repo, critical > 0 OR high > 0 AS failed FROM stats")
def q_gate(spark, sf):
    from scanforge.operators.findings import gate
    return gate(_stats(spark, sf))


@register("severity_weight", _SCAN_SQL + "SELECT repo, engine, rule_id, file, line, "
          + O.SEVERITY_WEIGHT_SQL.format(c="severity") + " AS weight FROM all_findings")
def q_severity_weight(spark, sf):
    from scanforge.functions.text import severity_weight
    f = flagship(spark, sf)
    return f.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"),
                    severity_weight("severity").alias("weight"))


@register("min_severity", _SCAN_SQL + "SELECT repo, engine, rule_id, file, line FROM all_findings "
          "WHERE engine = 'Leaks' OR severity IN ('CRITICAL', 'HIGH')")
def q_min_severity(spark, sf):
    f = flagship(spark, sf, min_severity="HIGH")
    return f.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"))


@register("engine_toggles", _SCAN_SQL + "SELECT repo, engine, rule_id, file, line FROM all_findings "
          "WHERE engine = 'Leaks'")
def q_engine_toggles(spark, sf):
    f = flagship(spark, sf, enable_sast=False, enable_sca=False)
    return f.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"))


# ===================================================================== §2.1 sources

@register("read_corpus", "SELECT 'doc_id=' || doc_id AS repo, strlen(text) + 1 AS size, sha256(text || chr(10)) AS text_sha256, "
          "false AS binary FROM documents")
def q_read_corpus(spark, sf):
    """Every document written as a text file below a folder of its own, then
    read back as a tree of checkouts; the first path segment is the repository."""
    from scanforge.sources.files import read_corpus
    from scanforge.sources.tree import local_root, write_lines
    root = _scratch(spark, "corpus-files")
    docs = documents(spark, sf).select("doc_id", "text")
    if (folder := local_root(root)) is not None:
        write_lines(docs.withColumnRenamed("text", "_line"), folder, ["doc_id"], ".txt")
    else:
        docs.repartition(F.col("doc_id")).write.partitionBy("doc_id").text(root)
    c = read_corpus(spark, root, repo_depth=1).where(F.col("path").endswith(".txt"))
    return c.select("repo", "size", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"), "binary")


@register("ignore_paths", O.with_views("corpus") + "\nSELECT repo, path FROM corpus WHERE NOT (" + O.IGNORED_SQL + ")")
def q_ignore_paths(spark, sf):
    from scanforge.sources.files import ignore_paths
    return ignore_paths(corpus(spark, sf)).select("repo", "path")


@register("admit_files", O.with_views("corpus") + ",\n" + O.FILES_SQL + "\nSELECT repo, path FROM files WHERE language "
          "IS NOT NULL OR ext IN (" + ", ".join(O.q(x) for x in O.LEAK_ONLY_EXTENSIONS) + ")")
def q_admit_files(spark, sf):
    from scanforge.sources.files import admit_files, ignore_paths
    return admit_files(ignore_paths(corpus(spark, sf))).select("repo", "path")


@register("detect_language", O.with_views("corpus") + "\nSELECT repo, path, " + O.LANG_CASE + " AS language FROM corpus")
def q_detect_language(spark, sf):
    from scanforge.sources.files import detect_language
    return detect_language(corpus(spark, sf)).select("repo", "path", "language")


@register("language_inventory", O.with_views("corpus") + ",\n" + O.FILES_SQL + """,
adm AS (SELECT * FROM files WHERE language IS NOT NULL OR ext IN (""" + ", ".join(O.q(x) for x in O.LEAK_ONLY_EXTENSIONS) + """))
SELECT repo, count(*) AS files_scanned,
       coalesce(array_to_string(list_sort(list_distinct(list(language) FILTER (WHERE language IS NOT NULL))), ','), '')
         AS languages_found
FROM adm GROUP BY repo""")
def q_language_inventory(spark, sf):
    from scanforge.sources.files import admit_files, ignore_paths, language_inventory
    inv = language_inventory(admit_files(ignore_paths(corpus(spark, sf))), group_cols=("repo",))
    return inv.select("repo", F.col("files_scanned").cast("long"),
                      F.array_join("languages_found", ",").alias("languages_found"))


@register("size_cap", "SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) <= 4096")
def q_size_cap(spark, sf):
    from scanforge.sources.files import size_cap
    d = documents(spark, sf)
    return size_cap(d, 4096, content_col="text").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


# every fifth document gets control characters (half of its bytes, or one in ten), every eleventh a NUL at its end
_BINARY_SQL = """SELECT doc_id, NOT (""" + O.leak_admit_sql("text") + """) AS is_binary
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || repeat(chr(1), strlen(text)) WHEN doc_id % 5 = 1 THEN text || repeat(chr(7), strlen(text) // 10)
             WHEN doc_id % 11 = 0 THEN text || chr(0) ELSE text END AS text FROM documents
      UNION ALL SELECT page_id + 1000000000 AS doc_id, html AS text FROM pages)"""


@register("drop_binary", _BINARY_SQL)
def q_drop_binary(spark, sf):
    from scanforge.sources.files import is_binary
    t, n = F.col("text"), F.octet_length("text")
    noisy = (F.when(F.col("doc_id") % 5 == 0, F.concat(t, F.repeat(F.lit("\x01"), n)))
             .when(F.col("doc_id") % 5 == 1, F.concat(t, F.repeat(F.lit("\x07"), F.floor(n / 10).cast("int"))))
             .when(F.col("doc_id") % 11 == 0, F.concat(t, F.lit("\x00"))).otherwise(t))
    d = documents(spark, sf).select("doc_id", noisy.alias("text"))
    p = V.table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), F.col("html").alias("text"))
    return d.unionByName(p).select("doc_id", is_binary(F.col("text")).alias("is_binary"))


@register("drop_media_extensions", O.with_views("blobs") + "\nSELECT repo, commit_hash, path FROM blobs WHERE "
          "lower(regexp_extract(path, '\\.[^./]*$')) NOT IN (" + ", ".join(O.q(x) for x in O.MEDIA_EXTENSIONS) + ")")
def q_drop_media_extensions(spark, sf):
    from scanforge.sources.files import drop_media_extensions
    return drop_media_extensions(V.blobs(spark, sf)).select("repo", "commit_hash", "path")


@register("explode_lines", "WITH " + _DOC_LINES + "\nSELECT doc_id, line_no, line FROM doc_lines")
def q_explode_lines(spark, sf):
    return _doc_lines(spark, sf).select("doc_id", F.col("line_no").cast("long"), "line")


@register("stop_at_overlong_line", "WITH " + _DOC_LINES + """,
cut AS (SELECT doc_id, min(line_no) FILTER (WHERE strlen(line) >= 2000) AS c FROM doc_lines GROUP BY doc_id)
SELECT l.doc_id, l.line_no FROM doc_lines l JOIN cut USING (doc_id) WHERE c IS NULL OR l.line_no < c""")
def q_stop_at_overlong_line(spark, sf):
    from scanforge.operators.sast import stop_at_overlong_line
    kept = stop_at_overlong_line(documents(spark, sf).select("doc_id", "text"), limit=2000, content_col="text")
    return kept.select("doc_id", F.col("line_no").cast("long"))


# ===================================================================== §2.4 ignore file, history

# ignore-file patterns per repository, derived for every repository of the corpus
IGNORE_LINES = ["# secrets", ".env", "*.env", "!f9.env", "config/", "lib/*.sh", "/app/**/f1*.py", "", "*.TXT",
                "src/f[!1-4]*.java", "config/f[35]?.go", "a[", "f1[^0]*.kt"]
# the same patterns as regular expressions over the relative path, written out by hand
IGNORE_RX = [None, ("(^|/)\\.env(/|$)", False), ("(^|/)[^/]*\\.env(/|$)", False), ("(^|/)f9\\.env(/|$)", True),
             ("(^|/)config/", False), ("^lib/[^/]*\\.sh(/|$)", False), ("^app/([^/]+/)*f1[^/]*\\.py(/|$)", False),
             None, ("(^|/)[^/]*\\.TXT(/|$)", False), ("^src/f[^1-4/][^/]*\\.java(/|$)", False), ("^config/f[35][^/]\\.go(/|$)", False), None,
             ("(^|/)f1[^0/][^/]*\\.kt(/|$)", False)]


def _patterns(spark, sf):
    repos = corpus(spark, sf).select("repo").distinct()
    lines = F.array(*[F.lit(x) for x in IGNORE_LINES])
    return repos.select("repo", F.posexplode(lines).alias("ord", "pattern"))   # one ignore file per repository


_IGNORE_SQL = (O.with_views("corpus") + ",\npats AS (SELECT * FROM (VALUES "
               + ", ".join(f"({i}, {O.q(rx)}, {str(neg).upper()})" for i, p in enumerate(IGNORE_RX) if p for rx, neg in [p])
               + ") AS t(ord, rx, neg)),\n"
               + """dec AS (SELECT c.repo, c.path,
         coalesce(arg_max(NOT p.neg, p.ord) FILTER (WHERE regexp_matches(c.path, p.rx)), false) AS ignored
  FROM corpus c, pats p GROUP BY c.repo, c.path)
""")


@register("gitignore_match", _IGNORE_SQL + "SELECT repo, path, ignored FROM dec")
def q_gitignore_match(spark, sf):
    from scanforge.operators.secrets import gitignore_match
    return gitignore_match(corpus(spark, sf).select("repo", "path"), _patterns(spark, sf))


@register("downgrade_ignored", _IGNORE_SQL + ",\n" + O.leak_rules_values() + ",\n" + O.FILES_SQL
          + _LEAK_TAIL.replace("\nleaks AS", "\nleaks0 AS") + """,
leaks AS (SELECT l.repo, l.file, l.line, l.rule_id,
                 CASE WHEN d.ignored THEN 'INFO' ELSE l.severity END AS severity,
                 CASE WHEN d.ignored THEN '[.gitignore] ' || l.description || """ + O.q(
    IGNORED_SUFFIX) + """ ELSE l.description END AS description
          FROM leaks0 l LEFT JOIN dec d ON l.repo = d.repo AND l.file = d.path)
SELECT * FROM leaks""")
def q_downgrade_ignored(spark, sf):
    from scanforge.operators.secrets import leak_scan
    from scanforge.sources.files import admit_files, ignore_paths
    c = corpus(spark, sf)
    f = leak_scan(admit_files(ignore_paths(c)), patterns=_patterns(spark, sf))
    return f.select("repo", "file", F.col("line").cast("long"), "rule_id", "severity", "description")


_HISTORY_SQL = (O.with_views("blobs") + ",\n" + O.leak_rules_values() + """,
hfiles AS (SELECT * FROM blobs WHERE lower(regexp_extract(path, '\\.[^./]*$')) NOT IN ("""
               + ", ".join(O.q(x) for x in O.MEDIA_EXTENSIONS) + ") AND "
               + O.leak_admit_sql("content") + """),
hlines AS MATERIALIZED (SELECT repo, path, commit_seq, commit_hash, line_no, line FROM (
    SELECT repo, path, commit_seq, commit_hash, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line
    FROM (SELECT repo, path, commit_seq, commit_hash, string_split(content, chr(10)) AS arr FROM hfiles))
  WHERE """ + O.leak_line_keep_sql("line") + "),\nhh AS ("
               + O.leak_line_hits("hlines").replace("SELECT repo, path, line_no,", "SELECT repo, path, line_no, commit_seq, commit_hash,")
               + """),
dedup AS (SELECT repo, rule_id, path, line_no, m, arg_min(commit_hash, commit_seq) AS commit_hash
          FROM hh GROUP BY repo, rule_id, path, line_no, m),
hist AS (SELECT d.*, r.leak_type, CASE WHEN contains(r.leak_type, 'Generic') OR contains(r.leak_type, 'High Entropy')
                 THEN """ + O.entropy_sql("d.m") + """ ELSE 0.0 END AS entropy,
                 contains(r.leak_type, 'Generic') OR contains(r.leak_type, 'High Entropy') AS gated_rule
         FROM dedup d JOIN leak_rules r USING (rule_id))
""")


@register("history_scan", _HISTORY_SQL + "SELECT repo, path AS file, line_no AS line, rule_id, "
          "commit_hash, left(commit_hash, 8) AS commit_short, " + O.redact_sql("m") + " AS match, round(entropy, 6) AS entropy FROM hist "
          "WHERE NOT gated_rule OR entropy >= 3.5")
def q_history_scan(spark, sf):
    from scanforge.operators.secrets import history_scan
    h = history_scan(V.blobs(spark, sf))
    return h.select("repo", "file", F.col("line").cast("long"), "rule_id", "commit_hash", "commit_short", "match", "entropy")


@register("history_dedup", _HISTORY_SQL + "SELECT repo, rule_id, path, line_no, commit_hash FROM dedup")
def q_history_dedup(spark, sf):
    from scanforge.operators.catalog import Catalog
    from scanforge.operators.secrets import history_dedup, history_hits
    cat = Catalog(spark, sast=False)
    d = history_dedup(history_hits(V.blobs(spark, sf), cat.leak_specs)).join(cat.df().select("k", "rule_id"), "k")
    return d.select("repo", "rule_id", "path", F.col("line_no").cast("long"),
                    F.col("commit_hash_full").alias("commit_hash"))


# ===================================================================== §2.5 SCA

def _deps_df(spark, sf):
    return V.deps(spark, sf)


# Manifest texts of every format, built from the deps view the same way in
# both engines (entries sorted; each order is one manifest).
def _manifest_df(spark, sf, fmt):
    d = V.deps(spark, sf, "l_orderkey")
    if fmt == "npm":
        entry = F.concat(F.lit('"'), F.col("name"), F.lit("-"), F.col("ln").cast("string"), F.lit('": "^'),
                         F.col("version"), F.lit('"'))
        name, head, tail, sep = "package.json", '{"name": "app", "dependencies": {', "}}", ", "
    elif fmt == "composer":
        entry = F.concat(F.lit('"'), F.col("name"), F.lit("-"), F.col("ln").cast("string"), F.lit('": ">='),
                         F.col("version"), F.lit('"'))
        name, head, tail, sep = "composer.json", '{"require": {"php": ">=8.1", ', "}}", ", "
    elif fmt == "gomod":
        entry = F.concat(F.lit("\t"), F.col("name"), F.lit(" v"), F.col("version"))
        name, head, tail, sep = "go.mod", "module example.com/app\n\ngo 1.22\n\nrequire (\n", "\n)\n", "\n"
    elif fmt == "gemfile":
        entry = F.concat(F.lit("    "), F.col("name"), F.lit(" ("), F.col("version"), F.lit(")"))
        name, head, tail, sep = "Gemfile.lock", "GIT\n  remote: x\n\nGEM\n  remote: https://rubygems.org/\n  specs:\n", "\n", "\n"
    else:  # pom
        entry = F.concat(F.lit("    <dependency>\n      <groupId>g</groupId>\n      <artifactId>"), F.col("name"),
                         F.lit("</artifactId>\n      <version>"), F.col("version"), F.lit("</version>\n    </dependency>"))
        name, head, tail, sep = "pom.xml", "<project>\n  <artifactId>app</artifactId>\n  <version>${revision}</version>\n  <dependencies>\n", "\n  </dependencies>\n</project>\n", "\n"
    d = d.withColumn("ln", F.regexp_extract("version", r"^1\.([0-9]+)\.", 1))
    m = d.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), sep).alias("body"))
    return m.select(F.lit("r").alias("repo"), V.manifest_path(name).alias("path"), F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("content"))


def _manifest_sql(fmt):
    if fmt == "npm":
        entry, name, head, tail, sep = ("'\"' || name || '-' || regexp_extract(version, '^1\\.([0-9]+)\\.', 1) || '\": \"^' || version || '\"'",
                                        "package.json", '{"name": "app", "dependencies": {', "}}", ", ")
    elif fmt == "composer":
        entry, name, head, tail, sep = ("'\"' || name || '-' || regexp_extract(version, '^1\\.([0-9]+)\\.', 1) || '\": \">=' || version || '\"'",
                                        "composer.json", '{"require": {"php": ">=8.1", ', "}}", ", ")
    elif fmt == "gomod":
        entry, name, head, tail, sep = ("chr(9) || name || ' v' || version", "go.mod",
                                        "module example.com/app\n\ngo 1.22\n\nrequire (\n", "\n)\n", "\n")
    elif fmt == "gemfile":
        entry, name, head, tail, sep = ("'    ' || name || ' (' || version || ')'", "Gemfile.lock",
                                        "GIT\n  remote: x\n\nGEM\n  remote: https://rubygems.org/\n  specs:\n", "\n", "\n")
    else:
        entry, name, head, tail, sep = ("'    <dependency>' || chr(10) || '      <groupId>g</groupId>' || chr(10) || '      <artifactId>' || name || '</artifactId>' || chr(10) || '      <version>' || version || '</version>' || chr(10) || '    </dependency>'",
                                        "pom.xml", "<project>\n  <artifactId>app</artifactId>\n  <version>${revision}</version>\n  <dependencies>\n",
                                        "\n  </dependencies>\n</project>\n", "\n")

    def lit(x):
        return "(" + " || ".join(("chr(10)" if part == "\n" else "chr(9)" if part == "\t" else O.q(part))
                                 for part in _split_nl(x)) + ")" if x else "''"
    return (f"mf_{fmt} AS (SELECT 'r' AS repo, regexp_replace(manifest, 'requirements\\.txt$', {O.q(name)}) AS path, "
            f"{lit(head)} || array_to_string(list_sort(list({entry})), {lit(sep)}) || {lit(tail)} AS content "
            f"FROM deps GROUP BY manifest)")


def _split_nl(s):
    out, cur = [], ""
    for ch in s:
        if ch in "\n\t":
            if cur:
                out.append(cur)
            out.append(ch)
            cur = ""
        else:
            cur += ch
    if cur:
        out.append(cur)
    return out


_DEPS_EXPECTED = {
    "npm": "SELECT 'r' AS repo, name || '-' || regexp_extract(version, '^1\\.([0-9]+)\\.', 1) AS name, version, 'npm' AS ecosystem, regexp_replace(manifest, 'requirements\\.txt$', 'package.json') AS file FROM deps",
    "composer": "SELECT 'r' AS repo, name || '-' || regexp_extract(version, '^1\\.([0-9]+)\\.', 1) AS name, version, 'packagist' AS ecosystem, regexp_replace(manifest, 'requirements\\.txt$', 'composer.json') AS file FROM deps",
    "gomod": "SELECT 'r' AS repo, name, 'v' || version AS version, 'go' AS ecosystem, regexp_replace(manifest, 'requirements\\.txt$', 'go.mod') AS file FROM deps",
    "gemfile": "SELECT 'r' AS repo, name, version, 'rubygems' AS ecosystem, regexp_replace(manifest, 'requirements\\.txt$', 'Gemfile.lock') AS file FROM deps",
    "pom": "SELECT 'r' AS repo, name, version, 'maven' AS ecosystem, regexp_replace(manifest, 'requirements\\.txt$', 'pom.xml') AS file FROM deps",
}


def _deps_query(fmt):
    fn_name = {"npm": "deps_npm", "composer": "deps_composer", "gomod": "deps_gomod", "gemfile": "deps_gemfile",
               "pom": "deps_pom"}[fmt]

    def q(spark, sf):
        from scanforge.operators import sca
        d = getattr(sca, fn_name)(_manifest_df(spark, sf, fmt))
        return d.select("repo", "name", "version", "ecosystem", "file")
    # the parser applied to the manifests must give back every dependency
    sql = O.with_views("deps") + ",\n" + _manifest_sql(fmt) + "\n" + _DEPS_EXPECTED[fmt].replace(
        "FROM deps", f"FROM deps WHERE EXISTS (SELECT 1 FROM mf_{fmt})")
    register(fn_name, sql)(q)


for _fmt in ("npm", "composer", "gomod", "gemfile", "pom"):
    _deps_query(_fmt)


def _manifests(spark, sf):
    m = V.manifests(spark, sf)
    return m.select(F.lit("r").alias("repo"), "path", "content")


@register("deps_requirements", O.with_views("manifests") + "\nSELECT 'r' AS repo, name, version, 'pypi' AS ecosystem, "
          "manifest AS file FROM deps")
def q_deps_requirements(spark, sf):
    from scanforge.operators.sca import deps_requirements
    return deps_requirements(_manifests(spark, sf)).select("repo", "name", "version", "ecosystem", "file")


@register("find_manifests", O.with_views("manifests") + "\nSELECT path FROM manifests")
def q_find_manifests(spark, sf):
    from scanforge.operators.sca import find_manifests
    others = corpus(spark, sf).select("repo", "path", "content")  # no manifest among them
    return find_manifests(_manifests(spark, sf).unionByName(others)).select("path")


@register("dependency_inventory", O.with_views("manifests") + """
SELECT ecosystem, count(*) AS dependencies, count(DISTINCT file) AS manifest_files FROM (
  SELECT name, version, 'pypi' AS ecosystem, manifest AS file FROM deps
  UNION ALL SELECT name, 'v' || version, 'go', regexp_replace(manifest, 'requirements\\.txt$', 'go.mod') FROM deps)
GROUP BY ecosystem""")
def q_dependency_inventory(spark, sf):
    from scanforge.operators.sca import dependency_inventory
    m = _manifests(spark, sf).unionByName(_manifest_df(spark, sf, "gomod"))
    d = dependency_inventory(m)
    return d.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("dependencies"),
                                      F.countDistinct("file").alias("manifest_files"))


_ECO_MAP_SQL = "CASE lower(ecosystem) " + " ".join(
    f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in ECOSYSTEM_DB_NAME.items()) + " END"


@register("map_ecosystem", O.with_views("deps") + "\nSELECT manifest, name, version, db_ecosystem FROM (SELECT *, "
          + _ECO_MAP_SQL + " AS db_ecosystem FROM deps) WHERE db_ecosystem IS NOT NULL")
def q_map_ecosystem(spark, sf):
    from scanforge.operators.sca import map_ecosystem
    return map_ecosystem(_deps_df(spark, sf)).select("manifest", "name", "version", "db_ecosystem")


_ADV_MATCH_SQL = O.with_views("deps", "advisories") + """,
vuln AS (SELECT d.*, a.id AS adv_id, a.fixed, a.score
         FROM deps d JOIN advisories a ON lower(d.ecosystem) = lower(a.ecosystem) AND d.name = a.name
         WHERE """ + _vkey_sql("d.version") + " >= " + _vkey_sql("a.introduced") + " AND " + _vkey_sql("d.version") + " < " + _vkey_sql("a.fixed") + """)
"""

@register("match_advisories", _ADV_MATCH_SQL + "SELECT manifest AS file, name AS package_name, version AS package_version, "
          "fixed AS fixed_version, adv_id AS cve, score AS cvss, " + _CVSS_SEV_SQL.format(s="score") + " AS severity FROM vuln")
def q_match_advisories(spark, sf):
    from scanforge.operators.sca import match_advisories
    d = _deps_df(spark, sf).withColumnRenamed("manifest", "file").withColumn("repo", F.lit("r"))
    f = match_advisories(d, V.advisories(spark, sf))
    return f.select("file", "package_name", "package_version", "fixed_version", "cve", "cvss", "severity")


@register("cvss_severity", "SELECT p_partkey, p_size % 11 AS score, " + _CVSS_SEV_SQL.format(s="p_size % 11") + " AS severity FROM part")
def q_cvss_severity(spark, sf):
    from scanforge.functions.text import cvss_severity
    p = V.table(spark, sf, "part")
    score = (F.col("p_size") % 11).cast("long")
    return p.select("p_partkey", score.alias("score"), cvss_severity(score).alias("severity"))


@register("sca_scan", _ADV_MATCH_SQL.replace("lower(d.ecosystem) = lower(a.ecosystem)", "lower(a.ecosystem) = 'pypi'")
          + "SELECT manifest AS file, name AS package_name, cve, severity FROM ("
          "SELECT *, adv_id AS cve, " + _CVSS_SEV_SQL.format(s="score") + " AS severity FROM vuln) "
          "WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')")
def q_sca_scan(spark, sf):
    from scanforge.operators.sca import sca_scan
    f = sca_scan(_manifests(spark, sf), V.advisories(spark, sf))
    return f.select("file", "package_name", "cve", "severity")


# built-in table: dependencies whose names and versions are drawn from it
from scanforge.operators.sca import KNOWN_VULNERABLE as _KV  # noqa: E402

_KV_NAMES = sorted({r[0] for r in _KV}) + ["leftpad", "Django"]
_KV_VERSIONS = sorted({r[1] for r in _KV})


def _kv_deps_sql():
    names = "[" + ", ".join(O.q(n) for n in _KV_NAMES) + "]"
    vers = "[" + ", ".join(O.q(v) for v in _KV_VERSIONS) + "]"
    return (f"kvdeps AS (SELECT concat('m', CAST(l_orderkey AS VARCHAR), '/requirements.txt') AS file, "
            f"{names}[1 + l_partkey % {len(_KV_NAMES)}] AS name, {vers}[1 + l_suppkey % {len(_KV_VERSIONS)}] AS version "
            f"FROM lineitem)")


@register("match_known_vulnerable", "WITH " + _kv_deps_sql() + ",\nkv AS (SELECT * FROM (VALUES "
          + ", ".join(f"({O.q(a)}, {O.q(b)}, {O.q(c)}, {O.q(d)}, CAST({e} AS DOUBLE), {O.q(f)})" for a, b, c, d, e, f, g in _KV)
          + ") AS t(kn, kver, cve, severity, cvss, fixed))\nSELECT file, name AS package_name, version AS package_version, cve, "
          "severity, cvss, fixed AS fixed_version FROM kvdeps JOIN kv ON lower(name) = kn AND version = kver")
def q_match_known_vulnerable(spark, sf):
    from scanforge.operators.sca import match_known_vulnerable
    li = V.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(n) for n in _KV_NAMES])
    vers = F.array(*[F.lit(v) for v in _KV_VERSIONS])
    d = li.select(F.lit("r").alias("repo"),
                  F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("/requirements.txt")).alias("file"),
                  F.element_at(names, (F.col("l_partkey") % len(_KV_NAMES) + 1).cast("int")).alias("name"),
                  F.element_at(vers, (F.col("l_suppkey") % len(_KV_VERSIONS) + 1).cast("int")).alias("version"),
                  F.lit("pypi").alias("ecosystem"))
    f = match_known_vulnerable(d)
    return f.select("file", "package_name", "package_version", "cve", "severity", "cvss", "fixed_version")


# ===================================================================== §2.7 reports

_LEVEL_SQL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"


@register("sarif_level", _SCAN_SQL + "SELECT repo, engine, rule_id, file, line, " + _LEVEL_SQL + " AS level FROM all_findings")
def q_sarif_level(spark, sf):
    from scanforge.functions.text import sarif_level
    f = flagship(spark, sf)
    return f.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"), sarif_level("severity").alias("level"))


_REM_SQL = "rem AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.q(r[0])}, {O.q(r[11])})" for r in builtin_rule_rows()
) + ") AS t(rule_id, remediation))"


def _documents(spark, folder):
    """Whole documents read back; text that is no JSON gives NULL."""
    d = spark.read.text(folder, wholetext=True)
    return d.select("repo", F.try_parse_json("value").alias("v"))


def _column_of(array, *paths):
    return F.transform(array, lambda x: F.concat_ws("|", *[F.coalesce(F.try_variant_get(x, p, "string"), F.lit("")) for p in paths]))


@register("write_sarif", _SCAN_SQL + ",\n" + _REM_SQL + """
SELECT repo, '2.1.0' AS version, count(*) AS n_results, count(DISTINCT rule_id) AS n_rules,
  sha256(string_agg(row, chr(10) ORDER BY row)) AS results_sha256, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules
FROM (SELECT repo, a.rule_id, a.rule_id || '|' || """ + _LEVEL_SQL + """ || '|' || file || '|' || line || '|' || coalesce(CAST("column" AS VARCHAR), '') || '|'
      || CASE WHEN engine = 'SAST' THEN title || ' - ' || coalesce(remediation, '') ELSE 'Secret detected: ' || title END AS row
  FROM all_findings a LEFT JOIN rem ON a.rule_id = rem.rule_id WHERE engine IN ('SAST', 'Leaks')) GROUP BY repo""")
def q_write_sarif(spark, sf):
    """Documents written, read back and taken apart."""
    from scanforge.sinks.reports import write_sarif
    folder = _scratch(spark, "sarif")
    write_sarif(flagship(spark, sf), folder)
    d = _documents(spark, folder)
    results = F.try_variant_get("v", "$.runs[0].results", "array<variant>")
    rules = F.try_variant_get("v", "$.runs[0].tool.driver.rules", "array<variant>")
    at = "$.locations[0].physicalLocation."
    rows = _column_of(results, "$.ruleId", "$.level", at + "artifactLocation.uri", at + "region.startLine", at + "region.startColumn", "$.message.text")
    return d.select("repo", F.try_variant_get("v", "$.version", "string").alias("version"), F.size(results).cast("long").alias("n_results"),
                    F.size(rules).cast("long").alias("n_rules"), F.sha2(F.array_join(F.sort_array(rows), "\n").cast("binary"), 256).alias("results_sha256"),
                    F.array_join(F.sort_array(_column_of(rules, "$.id")), ",").alias("rules"))


@register("write_json", _STATS_SQL + """SELECT s.repo, '0.1.0' AS version, '2026-01-01T00:00:00Z' AS scan_time, s.repo AS target, total_findings, critical,
  coalesce(n_sast, 0) AS n_sast, coalesce(n_leaks, 0) AS n_leaks, coalesce(n_sca, 0) AS n_sca, sha256(coalesce(rows, '')) AS findings_sha256
FROM stats s LEFT JOIN (SELECT repo, count(*) FILTER (WHERE engine = 'SAST') AS n_sast, count(*) FILTER (WHERE engine = 'Leaks') AS n_leaks,
    count(*) FILTER (WHERE engine = 'SCA') AS n_sca, string_agg(row, chr(10) ORDER BY row) AS rows
  FROM (SELECT repo, engine, CASE WHEN engine = 'SCA' THEN rule_id || '|' || file || '|' || title || '|' || severity
               ELSE rule_id || '|' || file || '|' || line || '|' || title || '|' || severity || '|' || coalesce(match, '') END AS row FROM all_findings) GROUP BY repo) f USING (repo)""")
def q_write_json(spark, sf):
    """Documents written, read back and taken apart."""
    from scanforge.operators.findings import finding_stats
    from scanforge.sinks.reports import write_json
    folder = _scratch(spark, "json")
    f = flagship(spark, sf)
    write_json(f, finding_stats(f), folder, scan_time="2026-01-01 00:00:00")
    d = _documents(spark, folder)
    sast, sca, leaks = (F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("sast_findings", "sca_findings", "leak_findings"))
    rows = F.concat(_column_of(sast, "$.rule_id", "$.file", "$.line", "$.title", "$.severity", "$.nothing"),
                    _column_of(sca, "$.cve", "$.manifest_file", "$.package_name", "$.severity"),
                    _column_of(leaks, "$.rule_id", "$.file", "$.line", "$.type", "$.severity", "$.match"))
    get = lambda p, t="string": F.try_variant_get("v", "$." + p, t)
    return d.select("repo", get("version").alias("version"), get("scan_time").alias("scan_time"), get("target").alias("target"),
                    get("stats.total_findings", "bigint").alias("total_findings"), get("stats.critical", "bigint").alias("critical"),
                    F.size(sast).cast("long").alias("n_sast"), F.size(leaks).cast("long").alias("n_leaks"), F.size(sca).cast("long").alias("n_sca"),
                    F.sha2(F.array_join(F.sort_array(rows), "\n").cast("binary"), 256).alias("findings_sha256"))


@register("relative_path", O.with_views("corpus") + "\nSELECT '/scan/root/' || path AS abs_path, path AS rel FROM corpus")
def q_relative_path(spark, sf):
    from scanforge.functions.text import relative_path
    c = corpus(spark, sf).select(F.concat(F.lit("/scan/root/"), F.col("path")).alias("abs_path"))
    return c.select("abs_path", relative_path(F.col("abs_path"), "/scan/root").alias("rel"))


_URL_VARIANT_SQL = """CASE WHEN page_id % 7 = 6 THEN url || '%zz' WHEN page_id % 7 = 5 THEN url || '?q=100%&r=%z#top' ELSE CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN '  ' || url
   WHEN 3 THEN 'javascript:alert(' || page_id || ')' WHEN 4 THEN '/path/' || page_id ELSE 'data:text/html,' || page_id END END"""


_SAFE_URL_SQL = """SELECT page_id, u, CASE WHEN lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https')
    AND NOT regexp_matches(t, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(regexp_replace(t, '\\?[^#]*', '?'), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)')
  THEN lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) || substring(t, length(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) + 1)
  ELSE '#' END AS safe
FROM (SELECT page_id, u, trim(u, """ + O.GO_SPACE + """) AS t FROM (SELECT page_id, """ + _URL_VARIANT_SQL + """ AS u FROM pages))"""


@register("safe_url", _SAFE_URL_SQL)
def q_safe_url(spark, sf):
    from scanforge.functions.text import safe_url
    p = V.table(spark, sf, "pages")
    pid = F.col("page_id")
    u = (F.when(pid % 7 == 6, F.concat(F.col("url"), F.lit("%zz"))).when(pid % 7 == 5, F.concat(F.col("url"), F.lit("?q=100%&r=%z#top"))).when(pid % 6 == 0, F.col("url")).when(pid % 6 == 1, F.upper("url"))
         .when(pid % 6 == 2, F.concat(F.lit("  "), F.col("url")))
         .when(pid % 6 == 3, F.concat(F.lit("javascript:alert("), pid.cast("string"), F.lit(")")))
         .when(pid % 6 == 4, F.concat(F.lit("/path/"), pid.cast("string")))
         .otherwise(F.concat(F.lit("data:text/html,"), pid.cast("string"))))
    return p.select("page_id", u.alias("u")).select("page_id", "u", safe_url("u").alias("safe"))


# ===================================================================== §2.9 monitoring

SECRET = "monitor-secret"


def _hmac_sql(msg: str, key: str) -> str:
    k = key.encode().ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in k).hex()
    opad = bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({msg}))))"


_SIGNED_PUSHES_SQL = O.with_views("pushes") + """,
signed AS (SELECT *, CASE WHEN event_id % 5 = 4 THEN 'gitlab' ELSE 'github' END AS platform,
  CASE WHEN event_id % 5 = 4 THEN (CASE WHEN event_id % 2 = 0 THEN '""" + SECRET + """' ELSE 'nope' END)
       WHEN event_id % 3 = 0 THEN 'sha256=' || """ + _hmac_sql("payload", SECRET) + """
       WHEN event_id % 3 = 1 THEN 'sha256=' || """ + _hmac_sql("payload || 'x'", SECRET) + """
       ELSE '' END AS signature FROM pushes)
"""


def _signed_pushes(spark, sf):
    from scanforge.functions.text import hmac_sha256_hex
    p = V.pushes(spark, sf)
    e = F.col("event_id")
    plat = F.when(e % 5 == 4, "gitlab").otherwise("github")
    sig = (F.when(e % 5 == 4, F.when(e % 2 == 0, F.lit(SECRET)).otherwise(F.lit("nope")))
           .when(e % 3 == 0, F.concat(F.lit("sha256="), hmac_sha256_hex(SECRET, F.col("payload"))))
           .when(e % 3 == 1, F.concat(F.lit("sha256="), hmac_sha256_hex(SECRET, F.concat("payload", F.lit("x")))))
           .otherwise(F.lit("")))
    return p.withColumn("platform", plat).withColumn("signature", sig)


@register("hmac_sha256", "SELECT event_id, " + _hmac_sql("props", "k3y") + " AS tag FROM events")
def q_hmac_sha256(spark, sf):
    from scanforge.functions.text import hmac_sha256_hex
    e = V.table(spark, sf, "events")
    return e.select("event_id", hmac_sha256_hex("k3y", F.col("props")).alias("tag"))


@register("verify_push", _SIGNED_PUSHES_SQL + """SELECT event_id FROM signed WHERE
  (platform = 'gitlab' AND signature = '""" + SECRET + """')
  OR (platform = 'github' AND starts_with(signature, 'sha256=') AND lower(substring(signature, 8)) = """
          + _hmac_sql("payload", SECRET) + ")")
def q_verify_push(spark, sf):
    from scanforge.streaming.monitor import verify_push
    return verify_push(_signed_pushes(spark, sf), SECRET).select("event_id")


_BRANCH_SQL = """CASE WHEN starts_with(json_extract_string(payload, '$.ref'), 'refs/heads/')
  THEN substring(json_extract_string(payload, '$.ref'), 12) END"""
_VALID_BRANCH = """(coalesce({b}, '') <> '' AND strlen({b}) <= 255 AND regexp_matches({b}, '^[a-zA-Z0-9._/\\-]+$')
  AND NOT contains({b}, '..') AND NOT starts_with({b}, '/') AND NOT suffix({b}, '/'))"""


@register("push_branch", O.with_views("pushes") + "\nSELECT event_id, branch FROM (SELECT event_id, " + _BRANCH_SQL
          + " AS branch FROM pushes WHERE event_id % 11 NOT IN (0, 1, 2)) WHERE " + _VALID_BRANCH.format(b="branch"))
def q_push_branch(spark, sf):
    """Three pushes in eleven carry text behind the document, a newline in the branch, or a ref that is no string."""
    from scanforge.streaming.monitor import push_branch
    k = F.col("event_id") % 11
    payload = (F.when(k == 0, F.concat("payload", F.lit(" xx"))).when(k == 1, F.lit('{"ref": "refs/heads/main\\n"}'))
               .when(k == 2, F.lit('{"ref": ["refs/heads/main"]}')).otherwise(F.col("payload")))
    return push_branch(V.pushes(spark, sf).withColumn("payload", payload)).select("event_id", "branch")


_CAND_SQL = """CASE event_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/x' || event_id WHEN 2 THEN ''
  WHEN 3 THEN repeat('b', 250 + event_id % 10) WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN 'a b' ELSE 'main' || chr(10) END WHEN 5 THEN 'a..b' ELSE
  CASE WHEN event_id % 2 = 0 THEN '/lead' ELSE 'trail/' END END"""


@register("valid_branch", "SELECT event_id, cand, " + _VALID_BRANCH.format(b="cand") + " AS ok FROM (SELECT event_id, "
          + _CAND_SQL + " AS cand FROM events)")
def q_valid_branch(spark, sf):
    from scanforge.streaming.monitor import valid_branch
    e = V.table(spark, sf, "events")
    i = F.col("event_id")
    cand = (F.when(i % 7 == 0, "main").when(i % 7 == 1, F.concat(F.lit("feature/x"), i.cast("string")))
            .when(i % 7 == 2, "").when(i % 7 == 3, F.repeat(F.lit("b"), (F.lit(250) + i % 10).cast("int")))
            .when(i % 7 == 4, F.when(i % 2 == 0, "a b").otherwise("main\n")).when(i % 7 == 5, "a..b")
            .otherwise(F.when(i % 2 == 0, "/lead").otherwise("trail/")))
    return e.select("event_id", cand.alias("cand")).select("event_id", "cand", valid_branch("cand").alias("ok"))


@register("valid_repo", O.with_views("pushes") + """
SELECT event_id, r, regexp_matches(r, '^[a-zA-Z0-9._\\-]+/[a-zA-Z0-9._\\-]+$') AS ok FROM (SELECT event_id,
  repo || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/x' WHEN 2 THEN ' bad' ELSE CASE WHEN event_id % 8 = 3 THEN '.git' ELSE chr(10) END END AS r FROM pushes)""")
def q_valid_repo(spark, sf):
    from scanforge.streaming.monitor import valid_repo
    p = V.pushes(spark, sf)
    i = F.col("event_id")
    r = F.concat("repo", F.when(i % 4 == 0, "").when(i % 4 == 1, "/x").when(i % 4 == 2, " bad").otherwise(F.when(i % 8 == 3, ".git").otherwise("\n")))
    return p.select("event_id", r.alias("r")).select("event_id", "r", valid_repo("r").alias("ok"))


@register("target_branch", O.with_views("pushes") + "\nSELECT event_id, repo FROM (SELECT event_id, repo, " + _BRANCH_SQL
          + " AS branch FROM pushes) WHERE branch = 'main'")
def q_target_branch(spark, sf):
    from scanforge.streaming.monitor import push_branch, target_branch
    return target_branch(push_branch(V.pushes(spark, sf)), "main").select("event_id", "repo")


@register("rate_limit_tumbling", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id,
  time_bucket(INTERVAL 1 MINUTE, ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1""")
def q_rate_limit_tumbling(spark, sf):
    from scanforge.streaming.monitor import rate_limit_tumbling
    e = V.table(spark, sf, "events").withColumnRenamed("user_id", "source")
    return rate_limit_tumbling(e.select("event_id", "ts", "source"), n=1, key_cols=("source",)).select("event_id")


def _limit_sql(width):
    return f"""WITH RECURSIVE ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS source, epoch(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT source, rn, event_id, t + {width} AS wend, 1 AS used, true AS keep FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.source, e.rn, e.event_id,
         CASE WHEN e.t > r.wend THEN e.t + {width} ELSE r.wend END,
         CASE WHEN e.t > r.wend THEN 1 ELSE r.used + CASE WHEN r.used < 2 THEN 1 ELSE 0 END END,
         CASE WHEN e.t > r.wend THEN true ELSE r.used < 2 END
  FROM r JOIN ev e ON e.source = r.source AND e.rn = r.rn + 1)
SELECT event_id, source FROM r WHERE keep"""


@register("rate_limit", _limit_sql(7 * 86400))
def q_rate_limit(spark, sf):
    """Exact limiter over the whole table: windows by successor links and pointer doubling."""
    from scanforge.streaming.limiter import rate_limit
    e = V.table(spark, sf, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("source"))
    return rate_limit(e, n=2, window_seconds=7 * 86400, order=["event_id"]).select("event_id", "source")


@register("head_changes", """SELECT event_id, repo, sha FROM (SELECT event_id, 'org/repo' || user_id AS repo,
  json_extract_string(props, '$.k') AS sha,
  lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
  WHERE sha IS DISTINCT FROM prev""")
def q_head_changes(spark, sf):
    from scanforge.streaming.monitor import head_changes
    e = V.table(spark, sf, "events")
    obs = e.select("event_id", "ts", F.concat(F.lit("org/repo"), F.col("user_id").cast("string")).alias("repo"),
                   F.lit("main").alias("branch"), F.get_json_object("props", "$.k").alias("sha"))
    return head_changes(obs).select("event_id", "repo", "sha")


_IP_SQL = """CASE event_id % 9 WHEN 0 THEN '10.' || (user_id % 256) || '.' || (event_id % 256) || '.1'
  WHEN 1 THEN '172.' || (10 + user_id % 15) || '.0.' || (event_id % 256)
  WHEN 2 THEN '192.168.' || (user_id % 256) || '.' || (event_id % 256)
  WHEN 3 THEN '127.0.0.' || (event_id % 256)
  WHEN 4 THEN '169.' || (253 + event_id % 3) || '.1.1'
  WHEN 5 THEN '8.8.' || (user_id % 256) || '.' || (event_id % 256)
  WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN '::1' ELSE '::2' END
  WHEN 7 THEN CASE WHEN event_id % 2 = 0 THEN 'fd12:3456::' || (event_id % 100) ELSE '2001:db8::' || (event_id % 100) END
  ELSE CASE event_id % 8 WHEN 0 THEN 'fe80::1' WHEN 1 THEN 'fec0::1' WHEN 2 THEN '::ffff:10.0.0.' || (event_id % 256) WHEN 3 THEN '::ffff:8.8.8.8'
       WHEN 4 THEN '10.0.0.256' WHEN 5 THEN '010.0.0.1' WHEN 6 THEN 'fd00' ELSE '10.0.0.1' || chr(10) END END"""


@register("private_address", "SELECT event_id, ip, (ip LIKE '10.%' OR (ip LIKE '172.%' AND TRY_CAST(split_part(ip, '.', 2) AS INT) "
          "BETWEEN 16 AND 31) OR ip LIKE '192.168.%' OR ip LIKE '127.%' OR ip LIKE '169.254.%' OR ip = '::1' "
          "OR ip LIKE 'fc%:%' OR ip LIKE 'fd%:%' OR ip LIKE 'fe8%' OR ip LIKE 'fe9%' OR ip LIKE 'fea%' OR ip LIKE 'feb%' OR ip LIKE '::ffff:10.%') "
          "AND ip <> '10.0.0.256' AND ip NOT LIKE '%' || chr(10) AS private FROM (SELECT event_id, " + _IP_SQL + " AS ip FROM events)")
def q_private_address(spark, sf):
    from scanforge.streaming.monitor import private_address
    e = V.table(spark, sf, "events")
    ips = e.select("event_id", F.expr(_IP_SQL).alias("ip"))
    return private_address(ips).select("event_id", "ip", "private")


_BLOCKS_SQL = """SELECT CASE s_suppkey % 5 WHEN 0 THEN '10.' || (s_suppkey % 256) || '.0.0/16' WHEN 1 THEN '192.168.' || (s_suppkey % 256) || '.7/24'
  WHEN 2 THEN '8.8.' || (s_suppkey % 256) || '.0/25' WHEN 3 THEN '172.' || (s_suppkey % 32) || '.0.0/14' ELSE '8.8.0.0/' || (12 + s_suppkey % 13) END AS cidr FROM supplier
  UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'fd12:3456::/32' WHEN 1 THEN 'fd00::/8' WHEN 2 THEN '2001:DB8::/32' WHEN 3 THEN 'fe80::/10' ELSE '::1' END FROM region"""


@register("address_block", "WITH blocks AS (" + _BLOCKS_SQL + """),
v4 AS (SELECT cidr, CAST(split_part(cidr, '/', 2) AS INT) AS len, list_reduce([CAST(x AS BIGINT) FOR x IN string_split(split_part(cidr, '/', 1), '.')], lambda a, b: a * 256 + b) AS n
  FROM blocks WHERE cidr NOT LIKE '%:%'),
ranges AS (SELECT cidr, len, (n >> (32 - len)) << (32 - len) AS low, ((n >> (32 - len)) << (32 - len)) + (1::BIGINT << (32 - len)) - 1 AS high FROM v4),
ips AS (SELECT event_id, """ + _IP_SQL + """ AS ip FROM events),
read AS (SELECT event_id, ip, CASE WHEN ip LIKE '::ffff:%' THEN substr(ip, 8) ELSE ip END AS a FROM ips),
num AS (SELECT *, CASE WHEN regexp_full_match(a, '[0-9.]+') AND a NOT IN ('10.0.0.256', '010.0.0.1')
  THEN list_reduce([CAST(x AS BIGINT) FOR x IN string_split(a, '.')], lambda a, b: a * 256 + b) END AS n FROM read),
hit4 AS (SELECT event_id, arg_min(cidr, (-len, cidr)) AS block FROM num JOIN ranges ON n BETWEEN low AND high GROUP BY event_id)
SELECT event_id, ip, CASE WHEN ip LIKE 'fd12:3456:%' THEN 'fd12:3456::/32' WHEN ip LIKE '2001:db8:%' THEN '2001:DB8::/32' WHEN ip = 'fe80::1' THEN 'fe80::/10'
  WHEN ip = '::1' THEN '::1' ELSE block END AS block FROM num LEFT JOIN hit4 USING (event_id)""")
def q_address_block(spark, sf):
    """Addresses against a table of nested blocks, derived from suppliers and regions; the longest wins."""
    from scanforge.streaming.monitor import address_block
    for name in ("supplier", "region"):
        V.table(spark, sf, name).createOrReplaceTempView(name)
    ips = V.table(spark, sf, "events").select("event_id", F.expr(_IP_SQL).alias("ip"))
    return address_block(ips, spark.sql(_BLOCKS_SQL)).select("event_id", "ip", "block")


# ===================================================================== §2.8 remediation

PROVIDER, MODEL = "provider-a", "model-x"


def _cache_key_sql(*parts):
    return "sha256(" + " || chr(10) || ".join(f"coalesce({p}, '')" for p in parts) + ")"


_KEYED_SQL = _SCAN_SQL + """,
keyed AS (SELECT *, CASE WHEN engine = 'SAST' THEN """ + _cache_key_sql(f"'{PROVIDER}'", f"'{MODEL}'", "rule_id", "severity", "code") + """
                   ELSE """ + _cache_key_sql(f"'{PROVIDER}'", f"'{MODEL}'", "title", "file", "''") + """ END AS cache_key
          FROM all_findings)
"""


def _keyed(spark, sf):
    from scanforge.operators.remediation import finding_cache_key
    return flagship(spark, sf).withColumn("cache_key", finding_cache_key(PROVIDER, MODEL))


@register("cache_key", _KEYED_SQL + "SELECT repo, engine, rule_id, file, line, cache_key FROM keyed")
def q_cache_key(spark, sf):
    return _keyed(spark, sf).select("repo", "engine", "rule_id", "file", F.col("line").cast("long"), "cache_key")


@register("remediation_worklist", _SCAN_SQL + """SELECT repo, engine, rule_id, file, line FROM all_findings
WHERE engine = 'SAST' AND severity IN ('CRITICAL', 'HIGH')
UNION ALL
SELECT repo, engine, rule_id, file, line FROM all_findings WHERE engine = 'Leaks'""")
def q_remediation_worklist(spark, sf):
    from scanforge.operators.remediation import remediation_worklist
    w = remediation_worklist(flagship(spark, sf))
    return w.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"))


# cache entries derived from the findings: every third finding is cached,
# created some days before NOW, with a good, a tampered or no integrity tag
NOW = "2026-01-08 00:00:00"
CACHE_SECRET = "cache-key"


def _cache_sql():
    return """cache AS (SELECT cache_key AS key, TIMESTAMP '2026-01-08 00:00:00' - to_days(CAST(line % 12 AS INT)) AS created,
       168 AS ttl_hours, 'answer for ' || rule_id || ' at ' || file AS response,
       CASE line % 4 WHEN 0 THEN """ + _hmac_sql("'answer for ' || rule_id || ' at ' || file", CACHE_SECRET) + """
                     WHEN 1 THEN 'bad' ELSE '' END AS integrity
  FROM keyed WHERE line % 3 = 0),
valid AS (SELECT key, response, created FROM cache WHERE created + to_hours(ttl_hours) >= TIMESTAMP '""" + NOW + """'
          AND (integrity = '' OR integrity = """ + _hmac_sql("response", CACHE_SECRET) + """))
"""


def _cache_df(keyed):
    from scanforge.functions.text import hmac_sha256_hex
    resp = F.concat(F.lit("answer for "), F.col("rule_id"), F.lit(" at "), F.col("file"))
    line = F.col("line")
    return keyed.where(line % 3 == 0).select(
        F.col("cache_key").alias("key"),
        (F.lit(NOW).cast("timestamp") - F.make_interval(days=(line % 12).cast("int"))).alias("created"),
        F.lit(168).alias("ttl_hours"), resp.alias("response"),
        F.when(line % 4 == 0, hmac_sha256_hex(CACHE_SECRET, resp)).when(line % 4 == 1, F.lit("bad"))
        .otherwise(F.lit("")).alias("integrity"))


@register("cache_lookup", _KEYED_SQL + "," + _cache_sql() + """SELECT repo, engine, rule_id, file, line,
  cache_key IN (SELECT key FROM valid) AS hit FROM keyed""")
def q_cache_lookup(spark, sf):
    from scanforge.operators.remediation import cache_lookup
    keyed = _keyed(spark, sf)
    found = cache_lookup(keyed, _cache_df(keyed), NOW, integrity_key=CACHE_SECRET)
    return found.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"), "hit")


@register("attach_remediation", _KEYED_SQL + "," + _cache_sql() + """SELECT repo, engine, rule_id, file, line,
  coalesce((SELECT arg_max(response, (created, response)) FROM valid WHERE valid.key = keyed.cache_key), '') AS ai_remediation FROM keyed""")
def q_attach_remediation(spark, sf):
    from scanforge.operators.remediation import attach_remediation, cache_lookup
    keyed = _keyed(spark, sf)
    found = cache_lookup(keyed, _cache_df(keyed), NOW, integrity_key=CACHE_SECRET)
    answers = found.where("hit").select("cache_key", F.col("cached_response").alias("response"))
    out = attach_remediation(keyed, answers)
    return out.select("repo", "engine", "rule_id", "file", F.col("line").cast("long"), "ai_remediation")


@register("render_prompts", _SAST_FINDINGS + """
SELECT finding_id, '## Security Vulnerability Found' || chr(10) || chr(10)
  || '**Vulnerability:** ' || title || chr(10) || '**Severity:** ' || severity || chr(10)
  || '**Language:** ' || language || chr(10) || '**OWASP Category:** ' || owasp || chr(10)
  || '**CWE:** ' || cwe || chr(10) || '**CVSS Score:** ' || printf('%.1f', cvss) || chr(10) || chr(10)
  || CASE WHEN code <> '' THEN '**Vulnerable Code:**' || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
  || '**File:** ' || file || ' (line ' || line || ')' || chr(10) || chr(10)
  || 'Please provide:' || chr(10)
  || '1. Why this vulnerability is dangerous in this specific context' || chr(10)
  || '2. A corrected code example' || chr(10)
  || '3. Any additional security controls to add' || chr(10) AS prompt
FROM findings""")
def q_render_prompts(spark, sf):
    from scanforge.operators.remediation import render_prompt
    f = flagship(spark, sf, enable_leaks=False, enable_sca=False)
    return render_prompt(f).select("finding_id", "prompt")


@register("render_secret_prompts", _LEAK_FILES + """SELECT file, line, rule_id, 'A ' || title || ' was detected in the file: ' || file || chr(10) || chr(10)
  || 'Please provide:' || chr(10) || '1. The immediate steps to take (rotate/revoke the secret)' || chr(10)
  || '2. How to properly manage this type of secret going forward' || chr(10)
  || '3. How to prevent this from happening again in CI/CD' || chr(10) || chr(10) || 'Be concise and actionable.' AS prompt FROM leaks""")
def q_render_secret_prompts(spark, sf):
    """Prompts of the secret findings of the flagship scan."""
    from scanforge.operators.remediation import render_prompts
    f = flagship(spark, sf, enable_sast=False, enable_sca=False)
    return render_prompts(f).select("file", F.col("line").cast("long"), "rule_id", "prompt")


def _answers_sql():
    return """answers AS (SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN 'Sure, here is the fix:' || chr(10) || text
    WHEN 1 THEN '<|im_start|>' || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || text || '<|im_end|>'
    WHEN 2 THEN repeat(text || chr(9) || chr(10), 3)
    WHEN 3 THEN '  Here are steps' || chr(10) || chr(10) || chr(10) || text || ' ' || chr(10)
    ELSE text END AS raw FROM conversations WHERE role = 'assistant')"""


def _answers_df(spark, sf):
    c = V.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    t, turn = F.col("text"), F.col("turn")
    raw = (F.when(turn % 5 == 0, F.concat(F.lit("Sure, here is the fix:\n"), t))
           .when(turn % 5 == 1, F.concat(F.lit("<|im_start|>"), t, F.lit("  \n\n\n\n"), t, F.lit("<|im_end|>")))
           .when(turn % 5 == 2, F.repeat(F.concat(t, F.lit("\t\n")), 3))
           .when(turn % 5 == 3, F.concat(F.lit("  Here are steps\n\n\n"), t, F.lit(" \n")))
           .otherwise(t))
    return c.select("conv_id", "turn", raw.alias("raw"))


def _clean_sql(x):
    from scanforge.operators.remediation import FILLER_PREFIXES, GARBAGE_TOKENS
    t = x
    for g in GARBAGE_TOKENS:
        t = f"replace({t}, {O.q(g)}, '')"
    first = f"trim(split_part({t}, chr(10), 1), {O.GO_SPACE})"
    filler = " OR ".join(f"starts_with({first}, {O.q(p)})" for p in FILLER_PREFIXES)
    t = f"(CASE WHEN {filler} THEN regexp_replace({t}, '^[^\\n]*(\\n|$)', '') ELSE {t} END)"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]+(\\n|$)', '\\1', 'g')"
    return t


@register("clean_responses", "WITH " + _answers_sql() + """,
s1 AS (SELECT conv_id, turn, """ + _clean_sql("raw") + """ AS t FROM answers),
s2 AS (SELECT conv_id, turn, t FROM s1)
SELECT conv_id, turn, trim(t, """ + O.GO_SPACE + """) AS cleaned FROM s2""")
def q_clean_responses(spark, sf):
    from scanforge.operators.remediation import clean_response
    return _answers_df(spark, sf).select("conv_id", "turn", clean_response("raw").alias("cleaned"))


# ===================================================================== §2.5 advisories as JSON

def _adv_json_sql():
    return """adv_json AS (SELECT p_partkey, '{"id":"ADV-' || p_partkey || '","aliases":['
  || CASE p_partkey % 3 WHEN 0 THEN '"GHSA-' || p_partkey || '","CVE-2024-' || p_partkey || '"'
                        WHEN 1 THEN '"GHSA-' || p_partkey || '"' ELSE '' END
  || '],"summary":"' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END
  || '","details":"' || repeat(p_name || ' ' || p_brand || ' ', 1 + p_size % 20)
  || '","severity":[' || CASE p_size % 4 WHEN 0 THEN '{"type":"CVSS_V3","score":"' || (p_size % 10) || '.5"}'
       WHEN 1 THEN '{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N"}'
       WHEN 2 THEN '{"type":"CVSS_V2","score":"AV:N/AC:H/Au:N"}' ELSE '' END
  || '],"affected":[{"package":{"name":"pkg' || p_partkey || '","ecosystem":"PyPI"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"}'
  || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ',{"fixed":"1.' || p_size || '"},{"introduced":"2.0.0"},{"fixed":"2.' || p_size || '"}'
       WHEN 2 THEN ',{"last_affected":"1.' || p_size || '.0"}' ELSE ',{"fixed":"1.' || p_size || '"}' END
  || ']},{"type":"GIT","events":[{"introduced":"0"},{"fixed":"abcdef"}]}],"versions":["9.' || p_size || '"]}]}' AS json FROM part)"""


def _adv_json_df(spark, sf):
    p = V.table(spark, sf, "part")
    k, size, name = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_name")
    aliases = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"GHSA-'), k, F.lit('","CVE-2024-'), k, F.lit('"')))
               .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"GHSA-'), k, F.lit('"'))).otherwise(F.lit("")))
    sev = (F.when(size % 4 == 0, F.concat(F.lit('{"type":"CVSS_V3","score":"'), (size % 10).cast("string"), F.lit('.5"}')))
           .when(size % 4 == 1, F.lit('{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N"}'))
           .when(size % 4 == 2, F.lit('{"type":"CVSS_V2","score":"AV:N/AC:H/Au:N"}')).otherwise(F.lit("")))
    n = size.cast("string")
    one = F.concat(F.lit(',{"fixed":"1.'), n, F.lit('"}'))
    fixed = (F.when(size % 5 == 0, F.lit("")).when(size % 5 == 1, F.concat(one, F.lit(',{"introduced":"2.0.0"},{"fixed":"2.'), n, F.lit('"}')))
             .when(size % 5 == 2, F.concat(F.lit(',{"last_affected":"1.'), n, F.lit('.0"}'))).otherwise(one))
    j = F.concat(F.lit('{"id":"ADV-'), k, F.lit('","aliases":['), aliases, F.lit('],"summary":"'),
                 F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.lit("")), F.lit('","details":"'),
                 F.repeat(F.concat(name, F.lit(" "), F.col("p_brand"), F.lit(" ")), (1 + size % 20).cast("int")),
                 F.lit('","severity":['), sev,
                 F.lit('],"affected":[{"package":{"name":"pkg'), k,
                 F.lit('","ecosystem":"PyPI"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"}'), fixed,
                 F.lit(']},{"type":"GIT","events":[{"introduced":"0"},{"fixed":"abcdef"}]}],"versions":["9.'), n, F.lit('"]}]}'))
    return p.select("p_partkey", j.alias("json"))


_CVSS_NUM_SQL = """(CASE WHEN TRY_CAST(regexp_extract(s, '^[\\t\\n\\f\\r ]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE) > 0
   AND TRY_CAST(regexp_extract(s, '^[\\t\\n\\f\\r ]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE) <= 10
  THEN TRY_CAST(regexp_extract(s, '^[\\t\\n\\f\\r ]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE)
  WHEN contains(upper(s), 'AV:N') AND contains(upper(s), 'AC:L') AND contains(upper(s), 'PR:N') THEN 9.0
  WHEN contains(upper(s), 'AV:N') THEN 7.5 ELSE 5.0 END)"""

_NORM_SQL = "WITH " + _adv_json_sql() + """,
parsed AS (SELECT p_partkey, json_extract_string(json, '$.id') AS id,
    json_extract_string(json, '$.aliases[*]') AS aliases, json_extract_string(json, '$.summary') AS summary,
    json_extract_string(json, '$.details') AS details,
    json_extract_string(json, '$.affected[*].ranges[*].events[*].fixed') AS fixes,
    json_extract_string(json, '$.severity[*].type') AS stypes, json_extract_string(json, '$.severity[*].score') AS sscores
  FROM adv_json),
scored AS (SELECT *, list_filter(list_zip(stypes, sscores), lambda z: z[1] IN ('CVSS_V3', 'CVSS_V2'))[1][2] AS s FROM parsed)
SELECT id, coalesce(list_filter(aliases, lambda a: starts_with(a, 'CVE-'))[1], id) AS cve,
       coalesce(list_filter(fixes, lambda f: f IS NOT NULL AND f <> '')[1], '') AS fixed,
       CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE details END AS description,
       CASE WHEN coalesce(summary, '') <> '' THEN summary WHEN strlen(details) > 200 THEN left(details, 200) || '...' ELSE details END AS short_description,
       CASE WHEN s IS NULL THEN 0.0 ELSE """ + _CVSS_NUM_SQL + """ END AS cvss
FROM scored"""


@register("normalize_advisory", _NORM_SQL)
def q_normalize_advisory(spark, sf):
    from scanforge.operators.sca import normalize_advisory
    return normalize_advisory(_adv_json_df(spark, sf)).select("id", "cve", "fixed", "description", "short_description", "cvss")


@register("cvss_score", "SELECT id, cvss, " + _CVSS_SEV_SQL.format(s="cvss") + " AS severity FROM (" + _NORM_SQL.replace(
    "WITH adv_json", "WITH adv_json", 1) + ")")
def q_cvss_score(spark, sf):
    from scanforge.operators.sca import normalize_advisory
    return normalize_advisory(_adv_json_df(spark, sf)).select("id", "cvss", "severity")


# the intervals written out from the columns of part, not from the documents
@register("advisory_ranges", """SELECT id, name, introduced, fixed, last_affected, version FROM (
SELECT 'ADV-' || p_partkey AS id, 'pkg' || p_partkey AS name, '0' AS introduced,
       CASE WHEN p_size % 5 IN (1, 3, 4) THEN '1.' || p_size END AS fixed, CASE WHEN p_size % 5 = 2 THEN '1.' || p_size || '.0' END AS last_affected,
       '9.' || p_size AS version FROM part
UNION ALL SELECT 'ADV-' || p_partkey, 'pkg' || p_partkey, '2.0.0', '2.' || p_size, NULL, '9.' || p_size FROM part WHERE p_size % 5 = 1)""")
def q_advisory_ranges(spark, sf):
    from scanforge.operators.sca import explode_advisories
    r = explode_advisories(_adv_json_df(spark, sf))
    return r.select("id", "name", "introduced", "fixed", "last_affected", F.col("versions")[0].alias("version"))


# versions of the dependencies against raw advisory documents; the affected ones worked out per interval shape
@register("sca_scan_documents", O.with_views("deps") + """,
d AS (SELECT manifest, name, version, CAST(split_part(version, '.', 2) AS INT) AS minor, CAST(split_part(version, '.', 3) AS INT) AS patch,
             CAST(substring(name, 4) AS BIGINT) AS partkey FROM deps)
SELECT d.manifest AS file, d.name AS package_name, d.version AS package_version, 'ADV-' || p_partkey AS advisory FROM d JOIN part ON partkey = p_partkey
WHERE p_size % 5 = 0 OR (p_size % 5 IN (1, 3, 4) AND minor < p_size) OR (p_size % 5 = 2 AND (minor < p_size OR (minor = p_size AND patch = 0)))""")
def q_sca_scan_documents(spark, sf):
    from scanforge.operators.sca import sca_scan
    f = sca_scan(_manifests(spark, sf), _adv_json_df(spark, sf).select("json"))
    return f.select("file", "package_name", "package_version", F.regexp_extract("advisory_url", "[^/]*$", 0).alias("advisory"))


@register("stamped_output", O.with_views("pushes") + """
SELECT repo, report_name, count(*) AS n FROM (SELECT repo, 'report_' || branch || '_' || strftime(date_trunc('day', ts), '%Y%m%d-%H%M%S') || '.json' AS report_name
  FROM (SELECT repo, ts, """ + _BRANCH_SQL + " AS branch FROM pushes) WHERE " + _VALID_BRANCH.format(b="branch") + ") GROUP BY ALL")
def q_stamped_output(spark, sf):
    """One report per repository, branch and day of pushes, written and read back by the names of their folders."""
    from scanforge.sinks.reports import stamped_output
    from scanforge.sources.tree import list_files, local_root, read_files, unescaped
    from scanforge.streaming.monitor import push_branch
    folder = _scratch(spark, "stamped")
    p = push_branch(V.pushes(spark, sf)).withColumn("scan_ts", F.date_trunc("day", "ts"))
    stamped_output(p.select("repo", "branch", "scan_ts", "event_id"), folder)
    if (root := local_root(folder)) is not None:
        back = read_files(list_files(spark, root)).select("path", F.explode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("_line"))
        names = [unescaped(F.regexp_extract("path", f"{c}=([^/]+)/", 1)).alias(n) for c, n in (("repo", "repo"), ("report", "report_name"))]
        return back.select(*names).groupBy("repo", "report_name").agg(F.count(F.lit(1)).alias("n"))
    back = spark.read.option("recursiveFileLookup", "true").schema("event_id long").json(folder).select(F.input_file_name().alias("f"))
    back = back.select(F.url_decode(F.regexp_extract("f", "repo=([^/]+)/", 1)).alias("repo"), F.url_decode(F.regexp_extract("f", "report=([^/]+)/", 1)).alias("report_name"))
    # the reader escapes the escaped folder names once more
    return back.select(F.url_decode("repo").alias("repo"), F.url_decode("report_name").alias("report_name")).groupBy("repo", "report_name").agg(F.count(F.lit(1)).alias("n"))


# ===================================================================== YAML manifests, streaming

def _pubspec_df(spark, sf):
    d = _deps_df(spark, sf)
    entry = F.concat(F.lit("  "), F.col("name"), F.lit("@"), F.col("version"), F.lit(": ^"), F.col("version"))
    m = d.groupBy("manifest").agg(F.array_join(F.array_sort(F.collect_set(entry)), "\n").alias("body"))
    content = F.concat(F.lit("name: app\nenvironment:\n  sdk: '>=3.0.0'\ndependencies:\n  flutter:\n    sdk: flutter\n"),
                       F.col("body"), F.lit("\ndev_dependencies:\n  lints: {path: ../lints}\n"))
    return m.select(F.lit("r").alias("repo"),
                    F.regexp_replace("manifest", r"requirements\.txt$", "pubspec.yaml").alias("path"), content.alias("content"))


@register("deps_pubspec", O.with_views("deps") + """
SELECT DISTINCT 'r' AS repo, name || '@' || version AS name, version, 'pub' AS ecosystem,
       regexp_replace(manifest, 'requirements\\.txt$', 'pubspec.yaml') AS file FROM deps
UNION ALL SELECT 'r', 'lints', '', 'pub', regexp_replace(manifest, 'requirements\\.txt$', 'pubspec.yaml') FROM deps GROUP BY manifest""")
def q_deps_pubspec(spark, sf):
    from scanforge.operators.sca import deps_pubspec
    return deps_pubspec(_pubspec_df(spark, sf)).select("repo", "name", "version", "ecosystem", "file")


def _scratch(spark, name):
    import uuid

    from scanforge.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark, sf, *cols):
    """The events as a stream of two files, one micro-batch each: the second batch meets the state of the first."""
    folder = _scratch(spark, "events")
    early = V.table(spark, sf, "events").select(*cols)
    for k in (0, 1):
        early.where(F.coalesce(F.pmod("event_id", F.lit(2)), F.lit(0)) == k).write.parquet(f"{folder}/part={k}")
    files = len([x for x in early.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).inputFiles()])
    return (spark.readStream.schema(early.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max(1, files // 2))
            .parquet(folder))


@register("incremental_scan", _SCAN_SQL + """, pushed AS (SELECT DISTINCT 'repo' || (user_id % 20) AS repo FROM events
  WHERE event_type = 'click')
SELECT repo, engine, rule_id, file, line FROM all_findings WHERE engine <> 'SCA' AND repo IN (SELECT repo FROM pushed)""")
def q_incremental_scan(spark, sf):
    """Push events arrive as a file stream; each micro-batch keeps pushes to
    the watched branch and scans those repositories' files in foreachBatch."""
    from scanforge.streaming.monitor import incremental_scan, push_branch, target_branch
    stream = _event_stream(spark, sf, "event_id", "ts", "user_id", "event_type")
    pushes = stream.select("event_id", "ts", F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo"),
                           F.concat(F.lit('{"ref": "'), F.when(F.col("event_type") == "click", "refs/heads/main")
                                    .otherwise("refs/heads/dev"), F.lit('"}')).alias("payload"))
    changes = target_branch(push_branch(pushes), "main")
    files = corpus(spark, sf)

    def files_for(batch):
        return files.join(batch.select("repo", "branch").distinct(), "repo")

    sink, ckpt = _scratch(spark, "incremental-sink"), _scratch(spark, "incremental-ckpt")
    q = incremental_scan(changes, files_for, sink, ckpt, available_now=True).start()
    q.awaitTermination()
    # a repository pushed in both batches was scanned in both
    return spark.read.parquet(sink).select("repo", "engine", "rule_id", "file", F.col("line").cast("long")).distinct()


@register("rate_limit_stream", _limit_sql(3600))
def q_rate_limit_stream(spark, sf):
    """Exact limiter (window restarts at the first request after expiry),
    keyed state per source: the earlier half of the events' time arrives
    first, the later half meets its state in a second run of the stream."""
    from scanforge.streaming.monitor import rate_limit_stream
    events = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("source"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    folder, sink, ckpt = (_scratch(spark, f"ratelimit-{x}") for x in ("events", "sink", "ckpt"))
    for late in (False, True):
        half = events if first is None else events.where((F.col("ts") > F.lit(first + (last - first) / 2)) == late)
        half.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        limited = rate_limit_stream(stream, n=2, window_seconds=3600, key="source", id_col="event_id")
        (limited.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(sink).select("event_id", "source")


@register("monitor_heads", _SCAN_SQL + """, observed AS (SELECT DISTINCT 'repo' || (user_id % 20) AS repo FROM events)
SELECT repo, engine, rule_id, file, line FROM all_findings WHERE engine <> 'SCA' AND repo IN (SELECT repo FROM observed)""")
def q_monitor_heads(spark, sf):
    """HEAD observations (events as a file stream) -> scans of changed
    branches, branch state advanced after each successful batch."""
    from scanforge.streaming.monitor import monitor_heads
    stream = _event_stream(spark, sf, "event_id", "ts", "user_id", "props")
    obs = stream.select(F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("repo"),
                        F.lit("main").alias("branch"), F.col("ts"), F.get_json_object("props", "$.k").alias("sha"))
    files = corpus(spark, sf)

    def files_for(changed):
        return files.join(changed.select("repo", "branch").distinct(), "repo")

    sink, state, ckpt = _scratch(spark, "heads-sink"), _scratch(spark, "heads-state"), _scratch(spark, "heads-ckpt")
    monitor_heads(obs, files_for, sink, state, ckpt, available_now=True).start().awaitTermination()
    return spark.read.parquet(sink).select("repo", "engine", "rule_id", "file", F.col("line").cast("long")).distinct()
