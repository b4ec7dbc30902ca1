"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, quality, secret_scan, simhash, tables

STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", simhash.keep_one),
    ("decontamination", decontaminate.cut_benchmark),
    ("secrets", secret_scan.mask_secrets),
    ("tokens", bpe.tokenize),
]

#: Learned models take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each earlier stage kept is written to the session's shared folder, and removed once the next stage is written.

    The last stage's rows are checkpointed, so no folder of a stage is left. Null ids, null and empty texts, repeated rows
    and other columns, whatever their names, go through as each stage's docstring says; empty tables give no rows.
    """
    docs = tables.read(spark, sf_dir, "documents")
    folder = f"{tables.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            tables.remove(spark, f"{folder}/{last}")
        last = name
    out = tables.checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    tables.remove(spark, folder)
    return out
