"""From documents to packed training sequences.

Each stage works on all that the one before kept, written as Parquet and read
again.  The first four return the columns of documents, the last one pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from whence.llm import decontaminate, packing, quality, simhash, toxicity
from whence.llm.common import table, written

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("near duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Fitted models and hashes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
