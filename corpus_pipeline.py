"""A corpus pipeline of five stages over `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import at_exit, deleted, shared_dir
from larkspur.llm.linededup import stage_linededup
from larkspur.llm.mixing import stage_mixing
from larkspur.llm.packing import stage_packing
from larkspur.llm.rules import stage_rules
from larkspur.llm.simhash import stage_simhash

#: (name, function) in order; each function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("quality rules", stage_rules),
    ("line dedup", stage_linededup),
    ("SimHash near-dedup", stage_simhash),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: XXH64 fingerprints and the Newton steps of the mix have no SQL; tests hold each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    A stage's output is deleted once the next one is written, the last when the driver ends. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    at_exit(spark, base)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            deleted(spark, f"{base}/{k - 1}")
    return docs
