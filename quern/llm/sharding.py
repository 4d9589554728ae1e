"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole rows by a seeded hash to buckets that fit in memory, by rows and by bytes; pass
two shuffles each bucket by Fisher-Yates. Buckets follow each other, and the line of rows is cut into
shards whose counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, materialize, prefix_offsets, small

#: Inside-out Fisher-Yates over 0.._n-1: element i goes to a drawn place j <= i, what stood there moves
#: to the end. Draws are hashes of seed, bucket and i, so that a task that runs again draws the same.
FISHER_YATES = """
aggregate(
  sequence(0, cast(_n as int) - 1),
  slice(array(cast(null as int)), 1, 0),
  (p, i) -> transform(
    array(cast(pmod(xxhash64({seed}, _bucket, i), i + 1) as int)),
    j -> if(j = i, concat(p, array(i)),
            concat(slice(p, 1, j), array(i), slice(p, j + 2, i), array(p[j]))))[0])
"""


def scatter(df: DataFrame, seed: int, key: str, text: str, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """df with _hash and _bucket, and its number of rows. Rows alike in key and text more often than a
    bucket holds are told apart by their place in the input, so that no bucket grows with such a group."""
    told = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{text}`")))).first()
    rows, size = told[0], told[1] or 0
    buckets = max(1, math.ceil(rows / bucket_rows), math.ceil(size / bucket_bytes))
    x = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(-1))))
    # rows / bucket_rows of them at most; beyond a checked size the join is a shuffle of those few keys
    many = x.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows).select("_hash", F.lit(True).alias("_many"))
    many = materialize(many, "alike")
    place = F.col("_hash")
    if not many.isEmpty():
        # written once more: a row's place must be the same each time it is asked for
        x = materialize(x.withColumn("_at", F.monotonically_increasing_id()), "placed").join(small(many), "_hash", "left")
        place = F.when(F.col("_many"), F.xxhash64("_hash", "_at")).otherwise(place)
    return x.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets))).select(*[F.col(f"`{c}`") for c in df.columns], "_hash", "_bucket"), rows


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 17, key: str = "doc_id", text: str = "text", bucket_rows: int = 1024, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns of df plus shard (int) and slot (long, gapless from 0 in each shard), in files
    that follow each other by shard and slot.

    Rows of null key or text, and empty texts, are rows like others. Which rows share a bucket hangs on
    key and text alone; rows equal in both are interchangeable. Columns may have any type (rows are
    moved, not collected); those named shard and slot are replaced, and names that start with _ reserved. An empty
    table gives no rows. A bucket holds about bucket_rows rows and bucket_bytes of text, or one longer text.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot")
    x, rows = scatter(df, seed, key, text, bucket_rows, bucket_bytes)
    counts = materialize(x.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "buckets")
    offsets = prefix_offsets(counts, [], "_bucket", "_n", "_offset").join(counts, "_bucket")
    # a bucket's draws need no rows, only their number; they travel to the bucket as a row before the others
    drawn = offsets.select("_bucket", F.expr(FISHER_YATES.format(seed=seed)).alias("_perm"), "_offset")
    # pass one: the only shuffle of whole rows; a task gets buckets that follow each other, and sorts them
    near = x.unionByName(drawn, allowMissingColumns=True).repartitionByRange("_bucket")
    first = Window.partitionBy("_bucket").orderBy(F.col("_perm").isNull(), "_hash")
    told = [F.first(c).over(first.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("_perm", "_offset")]
    near = near.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_perm").isNull().alias("_row"), *told, (F.row_number().over(first) - 1).alias("_i"))
    # pass two: each row of a bucket to where it was drawn
    out = near.where("_row").withColumn("_place", F.expr("_offset + array_position(_perm, cast(_i - 1 as int)) - 1")).drop("_perm")
    out = out.withColumn("shard", F.expr(f"cast(((_place + 1) * {shards} - 1) div {max(rows, 1)} as int)"))
    out = out.withColumn("slot", F.expr(f"_place - (cast(shard as bigint) * {rows}) div {shards}"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot").sortWithinPartitions("shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int, **how) -> None:
    """Folders shard=N whose files, read in name order, hold the rows by slot."""
    shuffle_into_shards(df, shards, **how).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(documents(spark, sf_dir), 8)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
