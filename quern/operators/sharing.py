"""One scan for several consumers, and existence tests that stop early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tee(df: DataFrame, reliable: bool = True) -> DataFrame:
    """Materialise once, read many times. Reliable: kept in the shared checkpoint folder and so
    safe from lost executors; else Spark's cache, which recomputes what is lost."""
    if not reliable:
        return df.persist()
    from quern.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(df: DataFrame, test: Column, name: str = "found") -> DataFrame:
    """One row: does any row pass? limit(1) ends the scan with the first task that finds one."""
    return df.where(test).select(F.lit(1).alias("_")).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
