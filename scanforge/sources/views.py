"""Scanner inputs derived from the driver tables (documents, lineitem, part,
events, ...): a file corpus, file versions over commits, dependencies,
advisories, manifests and push events.

Each view exists twice: as a DataFrame (Spark) and as SQL text usable by
DuckDB (the correctness oracle). Both spell the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One vulnerable or benign line per slot; token-shaped strings are built
# from parts so that scanners run on this repository stay quiet.
SEED_LINES = [
    (0, 'cursor.execute("SELECT * FROM t WHERE id = " + uid)'),
    (1, "session = pickle.loads(data)"),
    (2, "const r = eval(userInput);"),
    (3, "InsecureSkipVerify: true,"),
    (4, "aws_access_key_id = " + "AK" + "IA" + "IOSFODNN7" + "EXAMPLE"),
    (5, "-----BEGIN RSA " + "PRIVATE KEY-----"),
    (6, "# pass" + 'word = "commented-out"'),
    (7, "api_" + 'key = "' + "a" * 20 + '"'),
    (8, "api_" + 'key = "' + "a1B2c3D4e5" + "F6g7H8i9J0" + '"'),
    (9, '<input type="password" name="p">'),
    (10, '<input type="password" autocomplete="off">'),
    (11, "fetch(u).then(f)"),
    (12, "fetch(u).then(f).catch(g)"),
    (13, "nothing to see here"),
    (14, 'acl = "public-read"'),
    (15, "// TODO: fix auth"),
]


CALM_LINE = "// TODO: fix auth"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read as its files are split. A session that reads
    single-file test tables may ask for more tasks with
    ``spark.scanforge.minPartitions``; unset, nothing is redistributed."""
    from scanforge.sources.files import spread
    want = spark.conf.get("spark.scanforge.minPartitions", None)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), int(want) if want else None)


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_LINES, "slot int, seed_line string")


def _seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # 16-row literal table: broadcast is bounded by construction
    return docs.join(F.broadcast(seed(spark)), (docs.doc_id % 16) == F.col("slot"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content): one file per document, the seed line appended,
    and repositories that hold nothing but a note (no severe finding)."""
    d = _seeded_documents(spark, sf_dir)
    dir_ = (F.when(d.doc_id % 7 == 0, "src/").when(d.doc_id % 7 == 1, "lib/")
            .when(d.doc_id % 7 == 2, "node_modules/x/").when(d.doc_id % 7 == 3, "app/")
            .when(d.doc_id % 7 == 4, "config/").when(d.doc_id % 7 == 5, "vendor/").otherwise(""))
    exts = [".py", ".js", ".go", ".java", ".kt", ".sh", ".php", ".tf", ".html", ".env", ".TXT", ".png"]
    ext = F.lit(".ts")
    for i in reversed(range(len(exts))):
        ext = F.when(d.doc_id % 13 == i, F.lit(exts[i])).otherwise(ext)
    files = d.select(
        F.concat(F.lit("repo"), (d.doc_id % 20).cast("string")).alias("repo"),
        F.concat(dir_, F.lit("f"), d.doc_id.cast("string"), ext).alias("path"),
        F.concat(d.text, F.lit("\n"), F.col("seed_line")).alias("content"),
    )
    calm = table(spark, sf_dir, "documents").where(F.col("doc_id") % 10 == 0).select(
        F.concat(F.lit("calm"), (F.col("doc_id") % 3).cast("string")).alias("repo"),
        F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit(CALM_LINE).alias("content"))
    return files.unionByName(calm)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File versions over commits: (repo, commit_hash, commit_seq, path, content)."""
    d = _seeded_documents(spark, sf_dir)
    return d.select(
        F.concat(F.lit("repo"), (d.doc_id % 5).cast("string")).alias("repo"),
        F.concat(F.lit("c"), F.lpad(d.doc_id.cast("string"), 12, "0")).alias("commit_hash"),
        d.doc_id.alias("commit_seq"),
        F.concat(F.lit("src/f"), (d.doc_id % 50).cast("string"),
                 F.when(d.doc_id % 9 == 0, ".png").otherwise(".py")).alias("path"),
        F.concat(F.col("seed_line"), F.lit("\n"), d.text).alias("content"),
    )


def _ecosystem(key):
    return (F.when(key % 4 == 0, "npm").when(key % 4 == 1, "pypi")
            .when(key % 4 == 2, "maven").otherwise("go"))


def manifest_path(file: str = "requirements.txt"):
    """Path of an order's manifest."""
    return F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("/" + file))


def deps(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """(manifest, name, version, ecosystem) from lineitem, and columns of it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *also, manifest_path().alias("manifest"),
        F.concat(F.lit("pkg"), li.l_partkey.cast("string")).alias("name"),
        F.concat(F.lit("1."), li.l_linenumber.cast("string"), F.lit("."),
                 (li.l_suppkey % 12).cast("string")).alias("version"),
        _ecosystem(li.l_partkey).alias("ecosystem"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected range [introduced, fixed) and a score, one package in five."""
    p = table(spark, sf_dir, "part")
    return p.where(p.p_partkey % 5 == 0).select(
        F.concat(F.lit("ADV-"), p.p_partkey.cast("string")).alias("id"),
        F.concat(F.lit("pkg"), p.p_partkey.cast("string")).alias("name"),
        _ecosystem(p.p_partkey).alias("ecosystem"),
        F.lit("1.2.0").alias("introduced"),
        F.concat(F.lit("1."), (3 + p.p_size % 4).cast("string"), F.lit(".10")).alias("fixed"),
        (p.p_size % 11).cast("double").alias("score"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requirements-style text per order, lines in sorted order."""
    d = deps(spark, sf_dir, "l_orderkey")  # grouped by the number: its text is longer to hash, sort and send
    m = d.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(d.name, F.lit("=="), d.version))), "\n").alias("content"))
    return m.select(manifest_path().alias("path"), "content")


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ref = (F.when(e.event_type == "click", "refs/heads/main").when(e.event_type == "view", "refs/heads/dev")
           .when(e.event_type == "purchase", "refs/tags/v1").when(e.event_type == "signup", "refs/heads/../x")
           .otherwise("refs/heads/feature/a"))
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("org/repo"), e.user_id.cast("string")).alias("repo"),
        F.concat(F.lit('{"ref": "'), ref, F.lit('"}')).alias("payload"),
        e.props.alias("head"),
    )


# ---------------------------------------------------------------- DuckDB SQL

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEED_SQL = ("seed AS (SELECT * FROM (VALUES "
            + ", ".join(f"({i}, {_sql_str(s)})" for i, s in SEED_LINES)
            + ") AS t(slot, seed_line))")

CORPUS_SQL = """corpus AS (
  SELECT concat('repo', CAST(doc_id % 20 AS VARCHAR)) AS repo,
         concat(CASE doc_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'node_modules/x/'
                                WHEN 3 THEN 'app/' WHEN 4 THEN 'config/' WHEN 5 THEN 'vendor/' ELSE '' END,
                'f', CAST(doc_id AS VARCHAR),
                CASE doc_id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' WHEN 3 THEN '.java'
                                 WHEN 4 THEN '.kt' WHEN 5 THEN '.sh' WHEN 6 THEN '.php' WHEN 7 THEN '.tf'
                                 WHEN 8 THEN '.html' WHEN 9 THEN '.env' WHEN 10 THEN '.TXT' WHEN 11 THEN '.png'
                                 ELSE '.ts' END) AS path,
         concat(text, chr(10), seed_line) AS content
  FROM documents JOIN seed ON doc_id % 16 = slot
  UNION ALL SELECT concat('calm', CAST(doc_id % 3 AS VARCHAR)), concat('n', CAST(doc_id AS VARCHAR), '.py'), '// TODO: fix auth'
  FROM documents WHERE doc_id % 10 = 0)"""

BLOBS_SQL = """blobs AS (
  SELECT concat('repo', CAST(doc_id % 5 AS VARCHAR)) AS repo,
         concat('c', lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS commit_hash,
         doc_id AS commit_seq,
         concat('src/f', CAST(doc_id % 50 AS VARCHAR), CASE WHEN doc_id % 9 = 0 THEN '.png' ELSE '.py' END) AS path,
         concat(seed_line, chr(10), text) AS content
  FROM documents JOIN seed ON doc_id % 16 = slot)"""

DEPS_SQL = """deps AS (
  SELECT concat('m', CAST(l_orderkey AS VARCHAR), '/requirements.txt') AS manifest,
         concat('pkg', CAST(l_partkey AS VARCHAR)) AS name,
         concat('1.', CAST(l_linenumber AS VARCHAR), '.', CAST(l_suppkey % 12 AS VARCHAR)) AS version,
         CASE l_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'maven' ELSE 'go' END AS ecosystem
  FROM lineitem)"""

ADVISORIES_SQL = """advisories AS (
  SELECT concat('ADV-', CAST(p_partkey AS VARCHAR)) AS id,
         concat('pkg', CAST(p_partkey AS VARCHAR)) AS name,
         CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'maven' ELSE 'go' END AS ecosystem,
         '1.2.0' AS introduced,
         concat('1.', CAST(3 + p_size % 4 AS VARCHAR), '.10') AS fixed,
         CAST(p_size % 11 AS DOUBLE) AS score
  FROM part WHERE p_partkey % 5 = 0)"""

MANIFESTS_SQL = """manifests AS (
  SELECT manifest AS path,
         array_to_string(list_sort(list(concat(name, '==', version))), chr(10)) AS content
  FROM deps GROUP BY manifest)"""

PUSHES_SQL = """pushes AS (
  SELECT event_id, ts, concat('org/repo', CAST(user_id AS VARCHAR)) AS repo,
         concat('{"ref": "', CASE event_type WHEN 'click' THEN 'refs/heads/main' WHEN 'view' THEN 'refs/heads/dev'
                WHEN 'purchase' THEN 'refs/tags/v1' WHEN 'signup' THEN 'refs/heads/../x' ELSE 'refs/heads/feature/a' END,
                '"}') AS payload,
         props AS head
  FROM events)"""
