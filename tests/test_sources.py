import datetime as dt

from pyspark.sql import functions as F

from scanforge.functions.text import extension, relative_path
from scanforge.sinks.reports import stamped_name
from scanforge.sources.files import (admit_files, detect_language, drop_media_extensions, ignore_paths,
                                     language_inventory, size_cap)
from scanforge.streaming.monitor import target_branch, valid_repo
from tests.conftest import files_df


def test_extension_and_language(spark):
    rows = [("src/A.JAVA", ""), (".env", ""), ("Makefile", ""), ("a.b.c.ts", ""), ("x.", "")]
    df = detect_language(files_df(spark, rows)).select("path", extension("path").alias("ext"), "language")
    got = {r.path: (r.ext, r.language) for r in df.collect()}
    assert got == {"src/A.JAVA": (".java", "Java"), ".env": (".env", None), "Makefile": ("", None),
                   "a.b.c.ts": (".ts", "TypeScript"), "x.": (".", None)}


def test_ignore_admit_inventory(spark):
    rows = [("a.py", "x"), ("build/b.py", "x"), ("lib/vendor/c.js", "x"), ("d.txt", "x"), ("e.png", "x"),
            ("env", "x"), ("f.yaml", "x")]
    f = ignore_paths(files_df(spark, rows), extra=["lib"])
    assert sorted(r.path for r in f.collect()) == ["a.py", "d.txt", "e.png", "f.yaml"]
    assert sorted(r.path for r in admit_files(f).collect()) == ["a.py", "d.txt", "f.yaml"]
    assert sorted(r.path for r in admit_files(f, leaks=False).collect()) == ["a.py"]
    inv = language_inventory(admit_files(f)).collect()[0]
    assert inv.files_scanned == 3 and inv.languages_found == ["Python"]


def test_size_cap_and_media(spark):
    f = files_df(spark, [("a.py", "é" * 5), ("b.py", "x" * 11), ("img/c.PNG", "x"), ("d.lock", "x")])
    assert sorted(r.path for r in size_cap(f, 10).collect()) == ["a.py", "d.lock", "img/c.PNG"]
    assert sorted(r.path for r in drop_media_extensions(f).collect()) == ["a.py", "b.py"]


def test_relative_path_and_stamp(spark):
    df = spark.createDataFrame([("/scan/root/src/a.py",), ("C:\\scan\\root\\b.py",), ("/other/c.py",)], "p string")
    out = [r[0] for r in df.select(relative_path(F.col("p"), "/scan/root")).collect()]
    assert out == ["src/a.py", "C:/scan/root/b.py", "/other/c.py"]
    ts = spark.createDataFrame([(dt.datetime(2026, 1, 2, 3, 4, 5),)], "ts timestamp_ntz")
    assert ts.select(stamped_name("out/report.json", F.lit("main"), F.col("ts"))).collect()[0][0] == \
        "out/report_main_20260102-030405.json"


def test_valid_repo_and_watch_table(spark):
    df = spark.createDataFrame([("org/repo",), ("org/re po",), ("org",), ("a/b/c",), ("o.k/r_e-p",)], "r string")
    assert [r[0] for r in df.select(valid_repo("r")).collect()] == [True, False, False, False, True]
    pushes = spark.createDataFrame([("a/x", "main"), ("a/x", "dev"), ("b/y", "main")], "repo string, branch string")
    watch = spark.createDataFrame([("a/x", "dev"), ("b/y", "main")], "repo string, branch string")
    assert sorted(map(tuple, target_branch(pushes, watch).collect())) == [("a/x", "dev"), ("b/y", "main")]


def test_is_binary(spark):
    from scanforge.sources.files import is_binary
    cases = [("abc\x00def", True), ("", False), ("héllo wörld", False),
             ("\x01" * 31 + "a" * 69, True),      # 31 % non-printable
             ("\x01" * 30 + "a" * 70, False),     # exactly 30 % is not more than 30
             ("\t\r\n" * 10, False),
             ("a" * 9000 + "\x00", True)]         # all bytes count
    df = spark.createDataFrame([(s,) for s, _ in cases], "s string")
    got = [r[0] for r in df.select(is_binary(F.col("s"))).collect()]
    assert got == [e for _, e in cases]


def test_is_binary_on_raw_bytes(spark, tmp_path):
    from scanforge.sources.files import is_binary, is_binary_bytes, read_corpus
    df = spark.createDataFrame([(bytearray(b"\x01" * 40 + b"\xff" * 60),), (bytearray(b"\x01" * 30 + b"\xff" * 70),), (bytearray(),)], "b binary")
    assert [r[0] for r in df.select(is_binary_bytes(F.col("b"))).collect()] == [True, False, False]
    one = spark.createDataFrame([("a" * 9000 + "\x00",)], "s string")
    assert one.select(is_binary(F.col("s"), sample_bytes=8000)).collect()[0][0] is False
    for name, data in {"r1/a.py": b"x=1\n", "r1/bin.json": b"\x01" * 40 + b"\xff" * 60, "r1/node_modules/m.js": b"x", "r2/sub/B.PY": b"y", "r2/pic.png": b"\x00",
                       "r2/go.mod": b"module x\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = read_corpus(spark, str(tmp_path), repo_depth=1).collect()
    assert {(r.repo, r.path, r.binary) for r in rows} == {("r1", "a.py", False), ("r1", "bin.json", True), ("r2", "sub/B.PY", False), ("r2", "go.mod", False)}
    assert len(read_corpus(spark, str(tmp_path), admitted_only=False).collect()) == 6


def test_tables_are_read_as_they_are_split(spark, tmp_path):
    from scanforge.sources.files import spread
    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(spread(spark.read.parquet(path))) and "Exchange" in plan(spread(spark.read.parquet(path), 6))


def test_explode_lines_keeps_pieces(spark):
    from scanforge.operators.matching import explode_lines
    df = spark.createDataFrame([("r", "a", "x\r\ny\n")], "repo string, path string, content string")
    got = [(r.line_no, r.line) for r in explode_lines(df).orderBy("line_no").collect()]
    assert got == [(1, "x\r"), (2, "y"), (3, "")]
    got = [(r.line_no, r.line) for r in explode_lines(df, final_empty=False).orderBy("line_no").collect()]
    assert got == [(1, "x\r"), (2, "y")]
