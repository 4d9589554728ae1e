"""The corpus from raw documents to packed sequences. Part of the subpackage quern.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, neardup, packing, quality, secrets
from quern.llm.common import documents, materialize

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", quality.stage),
    ("minhash_near_dedup", neardup.stage),
    ("secret_scans", secrets.stage),
    ("mixing_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: A trained classifier, minima of hashes and token ids can't be said in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
