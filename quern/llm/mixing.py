"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's rows, in a seeded random order, form blocks. Weights are whole numbers e; time is cut
into units in each of which a source releases e blocks, or what it has left. With m blocks of a
source among the M of a unit, its i-th block (from 1) is released at floor((i - 1) * M / m) and due
at ceil(i * M / m); each slot goes to the released block that is due first. All slots are taken, so
every block meets its window and no source is ever a whole block away from its share. When a source
runs out, the others go on in their proportions: no row is dropped and none repeats.

Sources with the same m in a unit are scheduled as one class of c sources with c * m blocks, which its
members take in turn: with the class less than a block from its share, each member is less than a
block from its own. So a unit has as many classes as there are different m, for any number of sources.
Units in which no source ends are alike; a unit whose classes have a common divisor is a pattern
several times over. Only patterns are scheduled, and each block finds its slot by arithmetic.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, input_order, materialize, prefix_offsets, rank_in_group, small, spread_join

#: Weights of the query and the pipeline; other sources weigh 1.
TARGETS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}

#: One pattern of `span` slots by earliest deadline first, 1,024 slots a step of the outer loop. parts:
#: classes (m, b blocks); out: one entry (m, i from 0) a slot.
PATTERN = """
aggregate(
  sequence(0L, (span - 1) div 1024),
  named_struct(
    'q', transform(parts, p -> named_struct('m', p.m, 'b', p.b, 'i', 1L, 'r', 0L, 'd', (span + p.b - 1) div p.b)),
    'out', slice(array(named_struct('m', 0L, 'i', 0L)), 1, 0)),
  (all, step) -> transform(array(aggregate(
    sequence(step * 1024, least(span, (step + 1) * 1024) - 1),
    named_struct('q', all.q, 'out', slice(array(named_struct('m', 0L, 'i', 0L)), 1, 0)),
    (s, t) -> transform(
      array(array_min(transform(filter(s.q, z -> z.r <= t AND z.i <= z.b), z -> named_struct('d', z.d, 'b', -z.b, 'm', z.m, 'i', z.i)))),
      c -> named_struct(
        'q', transform(s.q, z -> if(z.m = c.m,
               named_struct('m', z.m, 'b', z.b, 'i', z.i + 1, 'r', (z.i * span) div z.b, 'd', ((z.i + 1) * span + z.b - 1) div z.b), z)),
        'out', concat(s.out, array(named_struct('m', c.m, 'i', c.i - 1)))))[0])),
    x -> named_struct('q', x.q, 'out', concat(all.out, x.out)))[0],
  all -> all.out)
"""
#: Greatest common divisor of the classes' blocks; 92 steps are enough for any two numbers of 64 bits.
DIVISOR = """
aggregate(parts, 0L, (a, p) -> aggregate(sequence(1, 92), named_struct('a', p.m * p.c, 'b', a),
  (s, k) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a))
"""


def spread_key(seed: int, key: str, spread: list[str]) -> Column:
    """Seeded hash of the key; rows without one are spread by their other columns."""
    other = [F.col(c) for c in spread]
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), F.col(key))).otherwise(F.xxhash64(F.lit(seed), F.lit("none"), *other))


def timetable(sources: DataFrame, weights: list[int], block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From one row a source (_source, _e, _rows):

    members: of each source its last unit (_last) with _left blocks, its place in its class before that
    unit (_q) and in it (_ql);
    classes: by kind of unit (_first to _end - 1 are alike) and m: _c sources, _g patterns a unit of
    _total slots, the first at slot _slot;
    slots: by kind, m and block of the class in a pattern (_j): its slot there.
    """
    s = sources.withColumn("_n", F.expr(f"(_rows + {block_rows} - 1) div {block_rows}"))
    s = s.withColumn("_last", F.expr("(_n - 1) div _e")).withColumn("_left", F.expr("_n - _last * _e"))
    cuts = s.select(F.explode(F.array(F.lit(0).cast("long"), "_last", F.col("_last") + 1)).alias("_first")).distinct()
    # windows over the kinds of units and over the sources of a weight: both as many as there are sources
    kinds = cuts.withColumn("_end", F.lead("_first").over(Window.orderBy("_first"))).where("_end IS NOT NULL")
    # sources of a weight that are whole in a unit: those that end later
    asked = kinds.select("_first", F.explode(F.array(*[F.lit(w).cast("long") for w in weights])).alias("_e"))
    line = s.select("_e", F.col("_last").alias("_x"), F.lit(1).alias("_one")).unionByName(asked.select("_e", F.col("_first").alias("_x"), F.lit(0).alias("_one")))
    later = line.withColumn("_c", F.sum("_one").over(Window.partitionBy("_e").orderBy(F.desc("_x"), "_one").rowsBetween(Window.unboundedPreceding, 0)))
    whole = materialize(later.where("_one = 0 AND _c > 0").select(F.col("_x").alias("_first"), F.col("_e").alias("_m"), "_c"), "whole")
    ends = s.groupBy(F.col("_last").alias("_first"), F.col("_left").alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
    classes = whole.unionByName(ends).groupBy("_first", "_m").agg(F.sum("_c").alias("_c"))
    of_weight = Window.partitionBy("_e").orderBy(F.desc("_last"), "_source")
    members = s.withColumn("_q", F.row_number().over(of_weight) - 1).withColumn("_ql", F.row_number().over(Window.partitionBy("_last", "_left").orderBy("_source")) - 1)
    before = whole.select(F.col("_first").alias("_last"), F.col("_m").alias("_left"), F.col("_c").alias("_before"))
    members = members.join(before, ["_last", "_left"], "left").withColumn("_ql", F.col("_ql") + F.coalesce("_before", F.lit(0)))
    units = classes.groupBy("_first").agg(F.sort_array(F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_c").alias("c")))).alias("parts")).join(kinds, "_first")
    units = units.withColumn("_total", F.expr("aggregate(parts, 0L, (a, p) -> a + p.m * p.c)")).withColumn("_g", F.expr(DIVISOR))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_slot", F.coalesce(F.sum(F.expr("_total * (_end - _first)")).over(before), F.lit(0)))
    units = materialize(units, "units")
    classes = units.select("_first", "_end", "_total", "_g", "_slot", F.inline("parts").alias("_m", "_c"))
    flat = units.repartition("_first").select("_first", "_end", "_g", F.expr("_total div _g").alias("span"), F.expr("transform(parts, p -> named_struct('m', p.m, 'b', p.m * p.c div _g))").alias("parts"))
    flat = flat.select("_first", "_end", "_g", F.posexplode(F.expr(PATTERN)).alias("_t", "z"))
    slots = flat.select("_first", F.expr("z.m").alias("_m"), F.expr("z.i").alias("_j"), F.col("_t").cast("long").alias("_t"), F.expr("_g * (_end - _first)").alias("_times"))
    return members, classes, slots


def mix(
    df: DataFrame,
    weights: Mapping[str, int],
    default: int = 1,
    block_rows: int = 64,
    seed: int = 29,
    source: str = "source",
    key: str = "doc_id",
    ties: list[str] | None = None,
) -> DataFrame:
    """All rows and columns of df plus weight, block, slot, release, deadline and position (long).

    position: the row's place in the mixed order, gapless from 0. A null source is a source of its
    own. Rows with equal key and `ties` (other columns, cheap to read) are told apart by their place in df.
    An empty table gives no rows. Names that start with _ are reserved; an input column that has
    the name of an output is replaced. A pattern (see above) is made by one task: with sources and weights
    at odds it has as many slots as all weights together, and some millions are too many.
    """
    if default < 1 or any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights must be whole numbers of at least 1")
    name = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    weight = F.lit(int(default)).cast("long")
    for k, w in weights.items():
        weight = F.when(F.col("_source") == f"s{k}", F.lit(int(w)).cast("long")).otherwise(weight)
    df = input_order(df.drop("weight", "block", "slot", "release", "deadline", "position"), "_at", store=True)
    ties = [c for c in (ties if ties is not None else ["n_chars", "lang"]) if c in df.columns]
    x = df.select("_at", name.alias("_source"), key, *ties).withColumn("_e", weight)
    sources = materialize(x.groupBy("_source").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_rows")), "sources")
    rows = sources.agg(F.sum("_rows")).first()[0] or 0
    ranked = rank_in_group(x, ["_source"], spread_key(seed, key, ties), [key, *ties, "_at"], rows, "_rank")
    ranked = materialize(ranked.select("_at", "_source", "_e", "_rank", F.expr(f"_rank div {block_rows}").alias("block")), "ranked")
    # blocks are placed, then their rows; in each join the other side knows how many blocks a key has
    blocks = ranked.groupBy("_source", "block").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_size"))
    total = rows // block_rows + 1
    members, classes, slots = timetable(sources, sorted({int(default), *map(int, weights.values())}), block_rows)
    b = spread_join(blocks, members.select("_source", "_last", "_left", "_q", "_ql", "_n"), ["_source"], "_n", total)
    b = b.withColumn("_k", F.expr("block div _e")).withColumn("_i", F.expr("block % _e"))
    b = b.withColumn("_m", F.expr("if(_k < _last, _e, _left)")).withColumn("_own", F.expr("if(_k < _last, _q, _ql)"))
    step = 4096  # kinds of many units become rows of one unit by way of stretches
    of = classes.groupBy("_first").agg(F.max("_end").alias("_end")).withColumn("_part", F.explode(F.expr(f"sequence(_first div {step}, (_end - 1) div {step})")))
    of = of.select("_first", F.explode(F.expr(f"sequence(greatest(_first, _part * {step}), least(_end, (_part + 1) * {step}) - 1)")).alias("_k"))
    b = b.join(small(of), "_k")
    b = spread_join(b, classes.withColumn("_count", F.expr("_m * _c * (_end - _first)")), ["_first", "_m"], "_count", total)
    b = b.withColumn("_in", F.expr("_i * _c + _own")).withColumn("_width", F.expr("_m * _c div _g")).withColumn("_j", F.expr("_in % _width"))
    b = spread_join(b, slots, ["_first", "_m", "_j"], "_times", total)
    start = F.expr("_slot + (_k - _first) * _total")
    b = b.select(
        "_source",
        "block",
        "_size",
        (start + F.expr("(_in div _width) * (_total div _g) + _t")).alias("slot"),
        (start + F.expr("(_i * _total) div _m")).alias("release"),
        (start + F.expr("((_i + 1) * _total + _m - 1) div _m")).alias("deadline"),
    )
    b = materialize(b, "blocks")
    b = b.join(prefix_offsets(b.select("slot", "_size"), [], "slot", "_size", "_ahead"), "slot")
    placed = ranked.join(b.drop("_size"), ["_source", "block"]).withColumn("position", F.expr(f"_ahead + _rank % {block_rows}"))
    out = df.join(placed.drop("_source", "_rank", "_ahead"), "_at")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "_at"], F.col("_e").alias("weight"), "block", "slot", "release", "deadline", "position")


def in_order(df: DataFrame) -> DataFrame:
    """Files that follow each other in the mixed order."""
    return df.repartitionByRange("position").sortWithinPartitions("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars")
    return mix(d, TARGETS).select("doc_id", "source", "weight", "block", "slot", "release", "deadline", "position")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, written in the mixed order."""
    return in_order(mix(docs, TARGETS)).select(*docs.columns)
