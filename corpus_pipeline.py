"""Training corpus pipeline: each stage reads what the one before it kept.

``documents`` in, token ids out. Stages return the columns of ``documents``;
the last returns one row of ids per row it gets. Between the stages the rows
are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scanforge.llm.op2_language_id import language_stage
from scanforge.llm.op3_jaccard_join import near_dedup_stage
from scanforge.llm.op5_mixing import mixing_stage
from scanforge.llm.op7_sentencepiece import sentencepiece_stage
from scanforge.llm.op10_line_dedup import dedup_stage
from scanforge.session import checkpoint_dir

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", dedup_stage),
    ("jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: no stage but line dedup can be put in SQL; tests hold the result against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
