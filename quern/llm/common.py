"""What several operators share: words, tables that cut lineage, ranks and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.joins import broadcast_if_small
from quern.session import setting, shared_path, trim_driver
from quern.sources.tables import table

#: Largest table that is broadcast, by Spark's estimate of its size.
BROADCAST_BYTES = 8 << 20
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the size; larger tables are joined by a shuffle."""
    return broadcast_if_small(df, BROADCAST_BYTES)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what is lost later is read again,
    not computed again, and every reader sees the same rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    # rows of a batch that Python workers take: with long texts, Spark's 10,000 hold much memory on both sides
    with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_id(text: str = "text") -> Column:
    """With doc_id this tells rows apart that share a doc_id but not the text."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def raw(text: str = "text") -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(batches, most_bytes: int = 8 << 20, column: str = "text") -> Iterator:
    """Arrow batches cut so that each holds about most_bytes of one binary column."""
    for b in batches:
        data = b.column(b.schema.get_field_index(column))
        if b.num_rows == 0:
            continue
        per_row = max(1, data.nbytes // b.num_rows)
        step = max(1, most_bytes // per_row)
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class WordHash(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __init__(self, seed: int, bound: int = 200_000):
        import xxhash

        self.of, self.seed, self.bound = xxhash.xxh3_64_intdigest, seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        x = self[word] = self.of(word, self.seed)
        return x


def prefix_offsets(counts: DataFrame, group: list[str], bucket: str, n: str, out: str, width: int = 4096) -> DataFrame:
    """Rows in earlier buckets of the same group, in two levels so that no task holds all buckets."""
    block = F.floor(F.col(bucket) / width)
    c = counts.withColumn("_block", block)
    within = F.coalesce(F.sum(n).over(Window.partitionBy(*group, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = c.groupBy(*group, "_block").agg(F.sum(n).alias("_n"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*group, "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_top"))
    inner = c.withColumn("_within", within)
    return inner.join(tops, [*group, "_block"]).select(*group, bucket, (F.col("_within") + F.col("_top")).cast("long").alias(out))


def rank_in_group(df: DataFrame, group: list[str], key: Column, ties: list[str], rows: int, out: str, bucket_rows: int = 4096) -> DataFrame:
    """0-based rank of each row in its group, in the order of a hash.

    Groups of any size: a group's rows are dealt by the hash to buckets of about bucket_rows,
    ranked there, and moved by the rows of the group's earlier buckets. Group columns hold no null.
    Rows with equal key and ties are told apart arbitrarily.
    """
    buckets = max(1, math.ceil(rows / bucket_rows))
    return rank_in_buckets(df, group, key, F.pmod("_key", F.lit(buckets)), ties, out)


def rank_in_order(df: DataFrame, group: list[str], key: str, ties: list[str], out: str, width: int = 4096) -> DataFrame:
    """0-based rank of each row in its group by a whole number that many rows lie close in, as those
    of `input_order`: buckets are stretches of `width` numbers."""
    return rank_in_buckets(df, group, F.col(key), F.expr(f"_key div {width}"), ties, out)


def rank_in_buckets(df: DataFrame, group: list[str], key: Column, bucket: Column, ties: list[str], out: str) -> DataFrame:
    x = df.withColumn("_key", key).withColumn("_bucket", bucket)
    counts = x.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_offsets(counts, group, "_bucket", "_n", "_offset")
    w = Window.partitionBy(*group, "_bucket").orderBy("_key", *ties)
    ranked = x.withColumn("_in", F.row_number().over(w) - 1)
    return ranked.join(offsets, [*group, "_bucket"]).withColumn(out, F.col("_in") + F.col("_offset")).drop("_key", "_bucket", "_in", "_offset")


def input_order(df: DataFrame, out: str, store: bool = False) -> DataFrame:
    """df with a number that grows along its rows, distinct, with gaps. Spark reads the files of a
    stored table in any order, so there it is the file's place by name and the row's place in the
    file; elsewhere the partition's number and the row's place in the partition. store: a df that is no
    stored table is written to the shared folder, so that the numbers are the same whenever they are read."""
    leaf = df._jdf.queryExecution().analyzed()
    while leaf.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        leaf = leaf.children().head()
    if leaf.nodeName() != "LogicalRelation" or not df.inputFiles():
        numbered = df.withColumn(out, F.monotonically_increasing_id())
        return materialize(numbered, "numbered") if store else numbered
    spot = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # one row a file on the driver; a longer name has a larger number
    names = sorted((r[0] for r in spot.select("_file").distinct().collect()), key=lambda x: (len(x), x))
    # as Arrow: Spark knows the size of such a table, and so whether it can be broadcast
    files = df.sparkSession.createDataFrame(pa.table({"_nth": pa.array(range(len(names)), pa.int64()), "_name": pa.array(names, pa.string())}))
    return spot.join(small(files), F.col("_file") == F.col("_name")).withColumn(out, F.expr("shiftleft(_nth, 33) + _at")).select(*df.columns, out)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """left joined with right, which has one row a key and in n how many rows of left have that key.

    No task gets all rows of a key that many have: keys of more than a thousandth of left's `total`
    rows, of which there can't be 1,000, are broadcast; only the others are shuffled. n is dropped.
    """
    many = F.col(n) > max(least, total // 1000)
    top = F.broadcast(right.where(many).drop(n))
    rest = left.join(F.broadcast(right.where(many).select(*keys)), keys, "left_anti")
    return left.join(top, keys).unionByName(rest.join(right.where(~many).drop(n), keys, how))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes of edges (a, b).

    Alternates stars to larger and to smaller neighbours; each round is written to the shared
    folder. Rounds end when all edges go from nodes that have one to nodes that have none; each round moves
    edges to smaller nodes, so it comes to that. Minima are summed before the shuffle, and a node of very
    many edges is told to them by broadcast.
    """

    def lowest(x: DataFrame) -> DataFrame:
        return x.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    def open_(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        many = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return many.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0] or False

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while open_(e):
        n = e.count()
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).withColumn("m", F.least("u", "m"))
        large = spread_join(both, low, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = lowest(large)
        hung = spread_join(large, low, ["u"], "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
