import os

from pyspark.sql import functions as F

from scanforge.sources.files import _admitted_glob, read_corpus
from scanforge.sources.tree import list_files, read_files, unescaped, write_lines


def test_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for path, text in (("r1/a/b/c/d.py", "x\n"), ("r1/a/e.PY", "y"), ("r2/f.js", "z"), ("r2/empty.py", ""), ("r2/.env", "k"), ("r2/_old/g.py", "h"),
                       ("r2/node_modules/i.js", "j"), ("r2/picture.png", "k"), ("top.go", "l")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = read_corpus(spark, str(tmp_path), repo_depth=1)
    assert sorted((r.repo, r.path, r.content, r.size) for r in found.collect()) == [
        ("r1", "a/b/c/d.py", "x\n", 2), ("r1", "a/e.PY", "y", 1), ("r2", "f.js", "z", 1)]
    # the same files through Spark's reader, whose index asks for every file's permissions
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _admitted_glob()).load(str(tmp_path))
    names = {r.path.removeprefix("file:") for r in plain.select("path").collect()}
    assert {r.path for r in read_corpus(spark, f"file://{tmp_path}").select(F.concat(F.lit(f"{tmp_path}/"), "path").alias("path")).collect()} == names - {
        str(tmp_path / "r2/node_modules/i.js")}
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "binaryFile" not in found._jdf.queryExecution().toString()


def test_lines_are_written_a_folder_each(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b=c%", "x"), (1, "a/b=c%", None), (2, None, "y"), (2, "", "z"), (None, "+", "w")], "a int, b string, _line string")
    assert write_lines(rows, str(tmp_path / "new"), ["a", "b"], ".txt") == 3
    assert sorted(os.listdir(tmp_path / "new")) == ["a=1", "a=2", "a=__HIVE_DEFAULT_PARTITION__"]
    assert os.listdir(tmp_path / "new/a=1") == ["b=a%2Fb%3Dc%25"] and os.listdir(tmp_path / "new/a=2") == ["b=__HIVE_DEFAULT_PARTITION__"]
    write_lines(rows, str(tmp_path / "new"), ["a", "b"], ".txt")  # a second call adds files
    found = read_files(list_files(spark, str(tmp_path / "new"))).select("length", unescaped(F.regexp_extract("path", "b=([^/]+)/", 1)).alias("b"))
    assert sorted(map(tuple, found.collect())) == [(2, "+"), (2, "+"), (3, "a/b=c%"), (3, "a/b=c%"), (4, "__HIVE_DEFAULT_PARTITION__"), (4, "__HIVE_DEFAULT_PARTITION__")]
