import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark, tmp_path):
    """documents from (doc_id, text[, lang[, source]]) tuples; with clashing extra columns on request."""

    def make(rows, extra=(), parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        from pyspark.sql import functions as F
        for name in extra:
            df = df.withColumn(name, F.lit("clash"))
        return df.repartition(parts)

    return make


@pytest.fixture
def sf(make_docs, tmp_path):
    """A folder with a documents table."""

    def write(rows, name="sf"):
        make_docs(rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return f"{tmp_path}/{name}"

    return write
