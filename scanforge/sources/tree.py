"""Trees of many small files on a shared local file system, listed, read and written by tasks.

Spark's own file index and commit protocol ask Hadoop's local file system for the permissions of every
file and folder, which starts a process each where Hadoop's native library is absent; with a folder a
document that is all the time there is. Here tasks list, open and write the files: the driver sees no name.
Other file systems (object stores, HDFS) keep Spark's readers and writers.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of content in a batch given out by a task (a larger file stands alone)
BATCH_BYTES = 4 << 20
#: levels of folders dealt out to tasks one by one; a task walks what lies below them
LEVELS = 2
#: name of the folder of a null or empty value, as Spark's writer has it
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

_ENTRY = "_open binary, path string, length bigint"
_ENTRY_TYPE = pa.schema([("_open", pa.binary()), ("path", pa.string()), ("length", pa.int64())])
_FILE_TYPE = pa.schema([*_ENTRY_TYPE, pa.field("content", pa.binary())])


def local_root(root: str) -> str | None:
    """The folder as a plain path, or None where only Spark's reader can tell what it is."""
    path = re.sub(r"^file:/*", "/", root)
    if not path.startswith("/") or re.search(r"[*?\[\]{}\\]", path):
        return None
    return path.rstrip("/") or "/"


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
    """(path, size; None: a folder) of everything in a folder that is not hidden."""
    with os.scandir(folder) as found:
        for e in found:
            if not hidden(os.fsdecode(e.name)):
                yield e.path, None if e.is_dir() else e.stat().st_size


def _walk(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
    waiting = [folder]
    while waiting:
        for path, size in _entries(waiting.pop()):
            if size is None:
                waiting.append(path)
            else:
                yield path, size


def _below(wanted: Callable[[str], bool] | None, walk: bool):
    """Folders (length null) become their entries, or with ``walk`` all files below them; files stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch.column("_open").to_pylist(), batch.column("length").to_pylist(), strict=True):
                for p, n in [(path, size)] if size is not None else _walk(path) if walk else _entries(path):
                    if n is None or n > 0 and (wanted is None or wanted(os.path.basename(p).decode("utf-8", "replace"))):
                        out.append((p, p.decode("utf-8", "replace"), n))
                    if len(out) >= 10_000:
                        yield _batch(out, _ENTRY_TYPE)
                        out = []
            if out:
                yield _batch(out, _ENTRY_TYPE)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_files(spark: SparkSession, root: str, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """(_open, path, length) of the files below a local folder, hidden and empty ones left out; ``wanted`` tests the file's name."""
    top = spark.createDataFrame([(bytearray(os.fsencode(root)), root, None)], _ENTRY)
    for level in range(LEVELS + 1):
        top = top.mapInArrow(_below(wanted, level == LEVELS), _ENTRY)
        if level < LEVELS:
            top = top.repartition(_tasks(spark), F.xxhash64("_open"))
    return top


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(f.name).to_pylist() for f in _ENTRY_TYPE), strict=True):
            with open(row[0], "rb") as f:
                content = f.read()
            if out and held + len(content) > BATCH_BYTES:
                yield _batch(out, _FILE_TYPE)
                out, held = [], 0
            out.append((*row, content))
            held += len(content)
    if out:
        yield _batch(out, _FILE_TYPE)


def read_files(files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, dealt out to tasks by a hash of the path."""
    dealt = files.select("_open", "path", "length").repartition(_tasks(files.sparkSession), F.xxhash64("_open"))
    return dealt.mapInArrow(_read, _ENTRY + ", content binary").drop("_open")


_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def folder_name(column: str, value: str | None) -> str:
    """``column=value`` as Spark's partitioned writer names the folder."""
    return f"{column}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def unescaped(name: Column) -> Column:
    """The value of a folder's name."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _write(root: str, columns: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        written = 0
        try:
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
                for key, line in zip(keys, batch.column("_line"), strict=True):
                    if file is None or key != last:
                        if file is not None:
                            _finish(file, name)
                        folder = os.path.join(root, *(folder_name(c, v) for c, v in zip(columns, key, strict=True)))
                        os.makedirs(folder, exist_ok=True)
                        file, last = open(os.path.join(folder, f".{name}-{uuid.uuid4().hex}"), "wb"), key  # noqa: SIM115
                        written += 1
                    if line.is_valid:
                        file.write(line.as_buffer())
                    file.write(b"\n")
            if file is not None:
                _finish(file, name)
                file = None
        finally:
            if file is not None:
                file.close()
                if os.path.exists(file.name):
                    os.unlink(file.name)
        yield _batch([(written,)], pa.schema([("files", pa.int64())]))

    return run


def _finish(file, name: str) -> None:
    file.close()
    os.replace(file.name, os.path.join(os.path.dirname(file.name), name))


def write_lines(rows: DataFrame, root: str, columns: list[str], suffix: str) -> int:
    """Write ``_line`` of each row below ``root/column=value/...``, one file a folder and call; returns the number of files.

    The rows of a folder are written by one task, which streams them; a file appears whole under its name or not at
    all, and a task that runs again writes the same name. Files of finished tasks stay when another task fails."""
    keyed = rows.select(*(F.col(c).cast("string").alias(c) for c in columns), F.col("_line").cast("binary").alias("_line"))
    # an empty value shares the folder of null
    keyed = keyed.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in columns})
    dealt = keyed.repartition(_tasks(rows.sparkSession), *columns).sortWithinPartitions(*columns)
    done = dealt.mapInArrow(_write(root, columns, f"part-{uuid.uuid4().hex}{suffix}"), "files bigint")
    return done.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
