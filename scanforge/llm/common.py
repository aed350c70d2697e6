"""Helpers shared by the training-data operators.

Every operator reads its input columns by name (``doc_id``, ``text``, …) and
nothing else, so extra columns of a table never clash with its own; internal
columns start with an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.session import checkpoint_dir

#: a word: a run without ASCII white space
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII white space as bytes
WS = b" \t\n\x0b\x0c\r"
#: bytes of text handled at once inside a Python task
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_text_key(df: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``_th``, a hash of the text.

    Rows are told apart by (doc_id, text): two rows that agree in both are the
    same document and get the same result.
    """
    return df.select("doc_id", text_or_empty().alias("text")).withColumn("_th", F.xxhash64("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most about ``limit`` bytes of text (a longer text stands alone) and ``rows`` rows."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i - start >= rows or held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
