"""Join variants. The logical join is always the same; these steer its physical form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import setting

#: Estimated bytes of a side that is broadcast on request. Of a Parquet scan the estimate is of stored
#: bytes; the rows take several times that, and fit all the same.
BROADCAST_LIMIT = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the plan's output."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark for broadcast only behind a check of size; beyond it Spark shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def node_of(key: Column | str, nodes: int) -> Column:
    """The node that a shuffle by key sends a row to, as Spark's own hash partitioning does."""
    return F.pmod(F.hash(key), F.lit(nodes))


def bloom_join(spark: SparkSession, join: Callable[[], DataFrame], largest: str = "10GB") -> DataFrame:
    """The join that `join` makes, planned so that a Bloom filter of the build side's keys is tested
    on probe rows before they are shuffled, at any size of the probe side."""
    names = {
        "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
        "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
        "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": largest,
        "spark__sql__autoBroadcastJoinThreshold": "-1",
    }
    with setting(spark, **names):
        df = join()
        df._jdf.queryExecution().executedPlan()  # planned while the settings hold
        return df


def choose_join(probe_bytes: int, build_bytes: int, nodes: int) -> str:
    """Broadcast sends the build side to all other nodes; a shuffle moves all but 1/nodes of both."""
    broadcast = build_bytes * (nodes - 1)
    shuffle = (probe_bytes + build_bytes) * (nodes - 1) / nodes
    return "broadcast" if broadcast < shuffle else "shuffle"


def inner(probe: DataFrame, build: DataFrame, on: Column | str | list, how: str = "auto") -> DataFrame:
    if how == "broadcast":
        build = broadcast_if_small(build)
    elif how in ("merge", "shuffle_hash"):
        build = build.hint(how)
    elif how != "auto":
        raise ValueError(how)
    return probe.join(build, on, "inner")


def heavy_keys(df: DataFrame, key: str, nodes: int) -> DataFrame:
    """Keys with more rows than half an even share of one node."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg((F.sum("n_rows") / (2.0 * nodes)).alias("half_share"))
    # one row of totals: the size of this broadcast is fixed
    return counts.join(F.broadcast(total), F.col("n_rows") > F.col("half_share")).select(key, "n_rows")


def salted_join(probe: DataFrame, build: DataFrame, key: str, nodes: int = 16, fanout: int = 8) -> DataFrame:
    """Inner join on one key; rows of heavy probe keys spread over `fanout` salts and their build
    rows are copied to each. There are at most 2 * nodes heavy keys, so the list is broadcast."""
    heavy = F.broadcast(heavy_keys(probe, key, nodes).select(F.col(key).alias("_heavy")))
    cols = [c for c in probe.columns if c != key]
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in cols] or [F.monotonically_increasing_id()]), F.lit(fanout)).cast("int")
    p = probe.join(heavy, probe[key] == F.col("_heavy"), "left").withColumn(
        "_salt", F.when(F.col("_heavy").isNotNull(), spread).otherwise(F.lit(0))
    )
    b = build.join(heavy, build[key] == F.col("_heavy"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0))))
    )
    return p.drop("_heavy").join(b.drop("_heavy"), [key, "_salt"]).drop("_salt")


def busiest(df: DataFrame) -> DataFrame:
    """Rows on the fullest partition."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("busiest"))


def fanouts(counts: dict, nodes: int) -> dict:
    """Over how many nodes each key should spread so that no share passes an even one."""
    share = max(1.0, sum(counts.values()) / nodes)
    return {k: min(nodes, max(1, -int(-n // share))) for k, n in counts.items()}
