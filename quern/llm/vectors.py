"""Near-duplicate vectors through an inverted multi-index.

Each vector is cut in halves; a codebook per half puts it into a cell of the product grid, within
its label. A query walks the cells in the order of its distance to them (multi-sequence): half by
half, the distance to a codeword's region is bounded below by the hyperplanes between codewords, and
cells follow by the sum of squares until no cell is left that a wanted neighbour is likely to be in.
What is met there is verified by cosine in double precision.

Equal vectors are one class. Tasks return sums of links and spanning forests, never pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import components, materialize, spread_join
from quern.llm.neardup import groups, walk
from quern.sources.tables import table

COSINE = 0.98
#: Vectors, and bytes of them, that codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 8192
SAMPLE_BYTES = 64 << 20
#: Lengths that get codebooks: the most frequent ones. Vectors of others are all compared, in blocks.
LENGTHS = 256
#: Vectors of a label that an ordinary cell holds, about.
CELL = 64
#: Members or queries of a cell that one task holds.
BLOCK = 1024
#: Differences of neighbours point anywhere: their share along one direction is normal with
#: deviation 1/sqrt(dimensions). A region further off than this many deviations is not visited.
DEVIATIONS = 4.0


#: What tells of a class in tasks.
CLASS = ["label", "size", "node", "copies", "vector"]


def usable(vector: Column, label: Column) -> Column:
    """Has a label, is not null or empty, holds finite numbers only, and not only zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread starts, the same for the same input."""
    draw = np.random.default_rng(5)
    c = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return np.unique(c, axis=0)


def region_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword, and for every codeword a lower bound of the distance to its region."""
    far = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))
    near = far.argmin(axis=1)
    gap = np.sqrt(np.maximum(0, (c * c).sum(axis=1)[:, None] - 2 * c @ c.T + (c * c).sum(axis=1)))
    span = gap[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(span > 0, (far - far[np.arange(len(x)), near][:, None]) / (2 * span), 0.0)
    return near, np.maximum(bound, 0.0)


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by a[i]^2 + b[j]^2, nearest first, while that is at most most^2."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa] ** 2, b[ob] ** 2
    heap = [(sa[0] + sb[0], 0, 0)]
    limit = most * most
    while heap:
        far, i, j = heapq.heappop(heap)
        if far > limit:
            return
        yield int(oa[i]), int(ob[j])
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length present, and the places of its vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def books(sample: pa.ListArray, kinds: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for each length that has many vectors. kinds: codewords wanted, by length."""
    out = {}
    for size, at in by_length(sample):
        if size in kinds:
            x = unit(rows_of(sample.take(pa.array(at))))
            half = max(1, size // 2)
            out[size] = codebook(x[:, :half], kinds[size]), codebook(x[:, half:], kinds[size]) if size > 1 else np.zeros((1, 0))
    return out


def place(classes: DataFrame, found: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float, deviations: float | None) -> DataFrame:
    """cell, query (false: the vector lives here), label, size, node, copies, vector. A query goes to
    cells after its own only: each two cells meet once. A length without codebooks is one cell."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                whole = b.slice(lo, 1024)
                for size, at in by_length(whole.column(4)) if whole.num_rows else ():
                    part = whole.take(pa.array(at))
                    if size not in found:
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.zeros(n, dtype=bool)), *part.columns], names=["cell", "query", *part.schema.names])
                        continue
                    yield cells(part, size)

    def cells(part: pa.RecordBatch, size: int) -> pa.RecordBatch:
        first, second = found[size]
        half, wide = first.shape[1], len(second)
        reach = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1.0 if deviations is None else min(1.0, deviations / math.sqrt(size))) + 1e-6
        v = unit(rows_of(part.column(4)))
        na, ba = region_bounds(v[:, :half], first)
        nb, bb = region_bounds(v[:, half:], second)
        who, cell, query = [], [], []
        for k in range(len(v)):
            own = int(na[k]) * wide + int(nb[k])
            who.append(k)
            cell.append(own)
            query.append(False)
            for i, j in multi_sequence(ba[k], bb[k], reach):
                at = i * wide + j
                if at > own:
                    who.append(k)
                    cell.append(at)
                    query.append(True)
        t = part.take(pa.array(who, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(query), *t.columns], names=["cell", "query", *t.schema.names])

    kinds = dict(classes.dtypes)
    return classes.select(*CLASS).mapInArrow(run, "cell long, query boolean, " + ", ".join(f"{c} {kinds[c]}" for c in CLASS))


def meet(dealt: DataFrame, cosine: float) -> DataFrame:
    """Verify each task's block of members against itself (where asked) and against its queries.
    Rows (a, b, n): a spanning forest's edges, and sums of linked copies (b null)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "task"):
            t = t.combine_chunks()
            q = t.column("query").to_numpy(zero_copy_only=False)
            copies = t.column("copies").to_numpy()
            inside = t.column("inside").to_numpy(zero_copy_only=False)
            if q.all() or len(q) < 2:
                continue
            ids = t.column("node").chunk(0)
            v = unit(rows_of(t.column("vector").chunk(0)))
            m, s = np.flatnonzero(~q), np.flatnonzero(q)
            near = np.zeros((len(m), len(q)), dtype=bool)
            if len(s):
                near[:, s] = v[m] @ v[s].T >= cosine
            if inside[m].all():
                near[:, m] = v[m] @ v[m].T >= cosine
                near[np.arange(len(m)), m] = False
            full = np.zeros((len(q), len(q)), dtype=bool)
            full[m] = near
            full |= full.T
            hit = full.any(axis=1)
            if not hit.any():
                continue
            links = full @ copies
            spot = np.flatnonzero(hit)
            sub = full[np.ix_(spot, spot)]
            edges = walk(len(spot), lambda i, rest: sub[i][rest])  # noqa: B023
            a = [*spot.tolist(), *(int(spot[i]) for i, _ in edges)]
            b = [*[None] * len(spot), *(int(spot[j]) for _, j in edges)]
            n = [*links[spot].tolist(), *[0] * len(edges)]
            yield pa.RecordBatch.from_pydict({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64())), "n": pa.array(n, pa.int64())})

    node = dict(dealt.dtypes)["node"]
    return dealt.mapInArrow(run, f"a {node}, b {node}, n long")


def near_vectors(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", deviations: float | None = DEVIATIONS) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    Rows are compared only where labels are equal and not null, and lengths are equal: each length
    present has its own codebooks. Vectors keep their precision; cosines are of doubles. Vectors that
    are null, empty or zero, or hold null or non-finite numbers link with nothing, and so do rows
    without a key (component_id null, kept). Equal vectors are linked to each other. Rows that repeat
    a key are vectors of their own, each with its own links. Pairs below the cosine are never linked;
    above it, recall is that of the walk. deviations: how far the walk reaches (see DEVIATIONS); None
    visits every cell that can hold a link, and finds all. Other columns of df aren't read. An empty
    table gives no rows.
    """
    kind = dict(df.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    x = df.select(F.col(key).alias("vec_id"), F.col(vector).cast(kind).alias("vector"), F.col(label).alias("label"))
    x = x.withColumn("ok", usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    # two hashes of 64 bits name the class of equal vectors
    x = x.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit("second"), "vector", "label"))
    classes = x.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    # a class is told by its smallest key and a number: keys may repeat, nodes don't
    node = F.struct("id", F.monotonically_increasing_id().alias("n")).alias("node")
    classes = materialize(classes.select("label", "h1", "h2", "copies", "vector", F.size("vector").alias("size"), node), "vectors")
    rows = classes.agg(F.sum("copies")).first()[0] or 0
    if rows:
        by = classes.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n"))
        # vectors of the label that a vector finds itself in, on average
        told = by.groupBy("size").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean"))
        told = told.where(F.col("mean") > CELL).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()
        kinds = {size: min(1024, math.ceil(math.sqrt(mean / CELL))) for size, _, mean in told}
        # a bounded sample, the same each time: the smallest hashes; each length has its share
        most = min(SAMPLE, max(256, SAMPLE_BYTES // (8 * max(kinds, default=1))))
        drawn = classes.orderBy(F.xxhash64("h1"), "h1", "h2").limit(most).select("vector").toArrow().column(0).combine_chunks()
        placed = materialize(place(classes, books(drawn, kinds), cosine, deviations), "cells")
        cell = ["label", "size", "cell"]
        counts = placed.groupBy(*cell).agg(F.count_if(~F.col("query")).alias("m"), F.count_if(F.col("query")).alias("q")).where("m > 0")
        # a crowded cell is cut: blocks of members each meet blocks of queries, its own members among them
        crowd = F.col("q") + F.when(F.col("m") > BLOCK, F.col("m")).otherwise(0)
        counts = counts.select(*cell, F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil(crowd / BLOCK).alias("qb"), (F.col("m") + F.col("q")).alias("in_cell"))
        near = spread_join(placed, counts, cell, "in_cell", placed.count())
        mine = near.where("NOT query").withColumn("i", F.pmod(F.xxhash64("node"), "mb"))
        # members: one copy for each block of queries; block 0 also compares the members with each other
        lives = mine.withColumn("j", F.explode(F.expr("sequence(0L, greatest(qb, 1L) - 1)"))).select(*cell, "i", "j", F.lit(False).alias("query"), (F.col("j") == 0).alias("inside"), "node", "copies", "vector")
        ask = near.where("query").withColumn("i", F.explode(F.expr("sequence(0L, mb - 1)")))
        own = mine.where("mb > 1").withColumn("other", F.explode(F.expr("filter(sequence(0L, mb - 1), z -> z > i)"))).drop("i").withColumnRenamed("other", "i")
        asks = ask.unionByName(own).withColumn("j", F.pmod(F.xxhash64("node", F.lit(3)), F.greatest("qb", F.lit(1)))).select(*cell, "i", "j", F.lit(True).alias("query"), F.lit(False).alias("inside"), "node", "copies", "vector")
        dealt = lives.unionByName(asks).withColumn("task", F.xxhash64(*cell, "i", "j")).repartition("task").sortWithinPartitions("task", "query")
        met = materialize(meet(dealt.select("task", "query", "inside", "node", "copies", "vector"), cosine), "links")
        linked = components(met.where("b IS NOT NULL"))
        sums = met.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        found = classes.join(sums, "node", "left").join(linked, "node", "left")
    else:
        found = classes.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.col("node"))
    found = found.select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node")["id"].alias("c"))
    out = spread_join(x.select("vec_id", F.when(F.col("ok"), F.col("h1")).alias("h1"), F.when(F.col("ok"), F.col("h2")).alias("h2")), found, ["h1", "h2"], "copies", rows, "left")
    out = out.withColumn("component_id", F.coalesce("c", "vec_id"))
    return out.select(
        F.col("vec_id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
