"""MinHash near-duplicates with b-bit signatures.

1. Each document's set of word shingles gives minima of seeded hashes; bands of minima are hashed,
   and the low b bits of all minima are packed into a signature.
2. Documents of equal sets form a class; only classes go on.
3. Within a bucket (one band's value) similarity is estimated from equal bits, corrected for chance
   agreement. Classes that may be alike are tied into units: a spanning forest, not all pairs.
4. Each unit's whole texts meet in one task, where links are confirmed on full sets while the unit is
   walked breadth first: what is linked already is not compared again. Large units are cut into
   blocks and every two blocks meet.

Bits and bands only decide what is compared. A link is confirmed by counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WordHash, components, documents, input_order, materialize, raw, slices, small, spread_join, text_id

BANDS = 25
ROWS = 5
HASHES = BANDS * ROWS
BITS = 2
SEED = 11
#: Standard deviations by which an estimate may fall short before a pair is no candidate.
SLACK = 4.0
#: Members of a bucket that are held at once; members of a unit, and shingles of theirs, that one task takes.
BUCKET = 4096
UNIT = 4096
UNIT_SHINGLES = 1 << 23

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; of all words where there are fewer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    size = min(size, len(h))
    x = h[:n]
    for k in range(1, size):
        x = mixed(x + np.uint64(k)) + h[k : k + n]
    return np.unique(mixed(x + np.uint64(size)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """Minimum of each hash over the set; long sets go by parts."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), step):
        best = np.minimum(best, (x[at : at + step, None] * a + b).min(axis=0))
    return best


def signature(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band hashes, and the low bits of the mixed minima, packed plane by plane."""
    low = mixed(m)
    by = low.reshape(BANDS, ROWS)
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * M2
    for k in range(ROWS):
        band = mixed(band + by[:, k])
    planes = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)) for p in range(BITS)]
    return band.astype(np.int64), np.concatenate(planes).tobytes()


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a packed signature to many: equal values, less those equal by chance."""
    width = one.shape[0] // BITS
    differ = (one ^ many).reshape(-1, BITS, width)
    differ = np.bitwise_or.reduce(differ, axis=1)
    equal = 1.0 - np.bitwise_count(differ).sum(axis=1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * similarity
    return similarity - SLACK * float(np.sqrt(equal * (1 - equal) / HASHES)) / (1 - chance)


def walk(n: int, alike) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1. alike(i, rest): which of rest are linked to i.
    Each member is compared only with those that no walk has reached yet."""
    rest = np.arange(n)
    edges = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = alike(i, rest)
            if hit.any():
                found = rest[hit]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                rest = rest[~hit]
    return edges


def profile(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """key, text_id, n_shingles, two halves of the set's fingerprint, bands and signature."""
    schema = f"{key} {dict(df.dtypes)[key]}, text_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary"

    def run(batches) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHash(SEED)
        a, b = permutations()
        last = {}
        for part in slices(batches):
            out = []
            for data in part.column(2).to_pylist():
                # lower() of bytes changes A-Z only; split() cuts at 0x20 and 0x09-0x0D
                x = shingles(data.lower().split(), size, hashes)
                if not len(x):
                    out.append((0, None, None, None, None))
                    continue
                print_ = xxhash.xxh3_128_intdigest(x.tobytes(), SEED)
                if print_ not in last:
                    if len(last) > 20_000:
                        last.clear()
                    last[print_] = signature(minima(x, a, b))
                band, bits = last[print_]
                out.append((len(x), (print_ >> 64) - (1 << 63), (print_ & (1 << 64) - 1) - (1 << 63), band, bits))
            n, high, low, bands, bits = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict(
                {
                    key: part.column(0),
                    "text_id": part.column(1),
                    "n_shingles": pa.array(n, pa.int64()),
                    "set_a": pa.array(high, pa.int64()),
                    "set_b": pa.array(low, pa.int64()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                    "bits": pa.array(bits, pa.binary()),
                }
            )

    return df.select(key, text_id(text).alias("text_id"), raw(text).alias("text")).mapInArrow(run, schema)


def groups(batches, key: str) -> Iterator[pa.Table]:
    """All rows of one key after another, from input sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and k[lo] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def ties(buckets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of each bucket's classes that may be alike. buckets: bucket, rep,
    bits, crowded; of a part of a crowded bucket all trees are tied to its smallest member, for members
    of other parts may link to any of them. Ties only say what is compared."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in groups(batches, "bucket"):
            ids = t.column("rep").to_numpy()
            if len(ids) > 1:
                bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                edges = walk(len(ids), lambda i, rest: agreement(bits[i], bits[rest]) >= least)  # noqa: B023
                if t.column("crowded")[0].as_py():
                    below = {j for _, j in edges}
                    edges += [(0, k) for k in range(1, len(ids)) if k not in below]
                for i, j in edges:
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return buckets.mapInArrow(run, "a long, b long")


class Postings:
    """Exact overlap of one set with many: members by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.values, start, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.start, self.count = owner[order], start, count
        self.spot = [np.searchsorted(self.values, s) for s in sets]

    def linked(self, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
        near = self.sizes[rest]
        size = self.sizes[i]
        fits = (100 * near >= percent * size) & (100 * size >= percent * near)  # else no overlap is enough
        if not fits.any():
            return fits
        if fits.sum() <= 48:
            both = np.array([np.intersect1d(self.sets[i], self.sets[j], assume_unique=True).size if f else 0 for j, f in zip(rest.tolist(), fits.tolist(), strict=True)])
        else:
            at = self.spot[i]
            many = self.count[at]
            first = np.repeat(self.start[at] - np.concatenate([[0], many.cumsum()[:-1]]), many)
            both = np.bincount(self.owner[first + np.arange(many.sum())], minlength=len(self.sets))[rest]
        return fits & (100 * both >= percent * (size + near - both))


def confirm(units: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that hold on full sets and link all of a unit that is linked at all.
    units: unit, rep, text (binary), sorted by unit within partitions."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(SEED)

        def found(ids, sets):
            own = Postings(sets)
            return [(ids[i], ids[j]) for i, j in walk(len(ids), lambda i, rest: own.linked(i, rest, percent))]

        # a text becomes its set as soon as it comes in, so that a unit's texts are never held together
        def sets():
            unit, ids, held = None, [], []
            for b in slices(batches, 4 << 20):
                for u, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if u != unit and ids:
                        yield ids, held
                        ids, held = [], []
                    unit = u
                    ids.append(r)
                    held.append(shingles(t.lower().split(), size, hashes))
            if ids:
                yield ids, held

        a, b = [], []
        for ids, held in sets():
            for i, j in found(ids, held):
                a.append(i)
                b.append(j)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_id, n_shingles, component_id (smallest key reachable over links), kept.

    Two documents are linked where 100 * shared >= percent * union of their sets. A text without
    words has an empty set and links with nothing. A row without a key takes part in nothing:
    component_id is null and it is kept. Rows that repeat a key are one node. Candidates miss a pair
    at exactly 0.8 with probability 5e-5, less above. An empty table gives no rows.
    """
    found = materialize(profile(df, size, key, text), "profiles")
    usable = found.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    # copies meet here: partial sums by class before the shuffle
    one = [F.first(c).alias(c) for c in ("bits", "bands", "n_shingles")]
    classes = usable.groupBy("set_a", "set_b").agg(F.min(F.struct(F.col(key).alias("rep"), "text_id")).alias("r"), F.count(F.lit(1)).alias("copies"), *one)
    classes = materialize(classes.select("set_a", "set_b", "r.rep", "r.text_id", "copies", "n_shingles", "bits", "bands"), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    # buckets of many classes are dealt to parts; each part is tied to the bucket's smallest member
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low")).where("n > 1")
    counts = materialize(counts.withColumn("parts", F.when(F.col("n") > BUCKET, F.ceil(2 * F.col("n") / BUCKET))), "buckets")
    pairs = spread_join(banded, counts, ["bucket"], "n", BANDS * classes.count())
    part = F.coalesce(F.pmod(F.xxhash64("rep"), "parts"), F.lit(0))
    pairs = pairs.withColumn("part", part).join(classes.select("rep", "bits"), "rep")
    dealt = pairs.select(F.xxhash64("bucket", "part").alias("bucket"), "rep", "bits", F.col("parts").isNotNull().alias("crowded")).repartition("bucket")
    least = least_estimate(percent / 100)
    own = ties(dealt.sortWithinPartitions("bucket", "rep"), least)
    across = pairs.where("parts IS NOT NULL").groupBy("bucket", "part").agg(F.min("rep").alias("a"), F.min("low").alias("b")).select("a", "b")
    unit = materialize(components(own.unionByName(across)), "units")
    held = unit.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.withColumn("blocks", 2 * F.ceil(F.greatest(F.col("n") / UNIT, F.col("s") / UNIT_SHINGLES))).where("blocks > 2").select("component", "blocks", "n")
    # every two blocks of a large unit meet in one task; an ordinary unit is one block
    wide = spread_join(unit, sizes, ["component"], "n", unit.count(), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    wide = wide.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    wide = wide.where("blocks = 1 OR other <> mine")
    wide = wide.select(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), F.col("node").alias("rep"))
    members = wide.join(classes.select("rep", "text_id"), "rep")
    texts = df.select(F.col(key).alias("rep"), text_id(text).alias("text_id"), raw(text).alias("text")).dropna(subset=["rep"])
    # `members` has one row a class that may have a partner; only their texts travel
    told = small(materialize(members, "members"))
    met = texts.join(told, ["rep", "text_id"]).select("unit", "rep", "text").repartition("unit").sortWithinPartitions("unit", "rep")
    linked = components(confirm(met, size, percent))
    result = classes.select("set_a", "set_b", "rep", "copies").join(linked, F.col("rep") == F.col("node"), "left")
    result = result.select("set_a", "set_b", "copies", F.coalesce("component", "rep").alias("_component"))
    out = spread_join(found.select(key, "text_id", "n_shingles", "set_a", "set_b"), result, ["set_a", "set_b"], "copies", found.count(), "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("_component", F.col(key)))
    out = out.withColumn("component_id", component)
    return out.select(key, "text_id", "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2).drop("text_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the smallest doc_id, any row with an id before
    those without. Rows are told apart by their place in docs: rows that repeat an id and a text are
    copies of each other, rows that repeat an id only aren't, and rows without an id are judged by their texts."""
    rows = input_order(docs, "_row", store=True)
    found = near_duplicates(rows, key="_row").select("_row", "component_id")
    told = materialize(found.join(rows.select("_row", F.col("doc_id").isNull().alias("_none"), "doc_id"), "_row"), "groups")
    stays = told.groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", "_row")).alias("b")).select("b._row")
    gone = materialize(told.select("_row").join(stays, "_row", "left_anti"), "gone")
    return rows.join(small(gone), "_row", "left_anti").select(*docs.columns)
