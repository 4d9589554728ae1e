"""Exact substring dedup by prefix-partitioned suffix trees.

A window is W consecutive words. Suffixes that may start a repeated window are dealt to groups by a
prefix that lies inside the window, not at its start: the anchor, those k of its words whose hash is
smallest. Equal windows share their anchor, and windows that follow each other and share one
form a segment, some W + 20 words of text, so that a suffix needn't bring W words of its own.

1. One pass over the texts emits segments as hashes: prefix, segment, document, place. Of equal
   segments the smallest document is the owner; the others are covered whole. Prefixes found in one
   document only are left: nothing repeats there.
2. Owners' segments that share a prefix with a different one send their words. A group too large
   for a task gets longer prefixes: its segments are halved by where the prefix stands in the window,
   and a half goes by all words that its windows have in common, 8, then some 29, 40, 45, 48 of W = 50.
   This goes on until groups fit, or the prefix is the window itself and needs no tree.
3. Each group's suffixes are put in order by doubling ranks, with the depth that neighbours share: the
   leaves of its suffix tree and the nodes between them. Leaves below a node of at least W words are
   windows that repeat; the smallest document below the node keeps them.
4. Covered stretches meet their document again, whose other words are kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WordHash, documents, materialize, raw, slices, spread_join, text_id
from quern.llm.neardup import mixed

WINDOW = 50
ANCHOR = 8
SEED = 23
#: Segments of a group that go to one task; larger groups are split by longer prefixes.
GROUP = 4096
#: Words of whole groups that are ranked at once.
RANKED = 500_000
BASE = np.uint64(0xD6E8FEB86659FD93)
M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k words from each place, by doubling. k is a power of two."""
    x, n = h, 1
    while n < k:
        x = mixed(x[:-n] * BASE + x[n:] + np.uint64(n)) if len(x) > n else x[:0]
        n *= 2
    return x


def sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest key in each window of `width`, the leftmost of equals: block minima
    from the left and from the right (van Herk)."""
    n = len(key)
    place = np.uint64(24)
    low = np.uint64((1 << 24) - 1)
    tagged = (key >> place << place) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = tagged
    by = full.reshape(-1, width)
    ahead = np.minimum.accumulate(by, axis=1).ravel()
    behind = np.minimum.accumulate(by[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)


def segments(h: np.ndarray, ends: np.ndarray, window: int, anchor: int):
    """Of concatenated documents (word hashes, ends): first window, number of windows, words from there
    to the prefix, prefix hash and segment hash of each segment."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = gram_hashes(h, anchor)
    at = sliding_argmin(gram, window - anchor + 1)
    n = len(h) - window + 1
    at = at[:n]
    starts = np.concatenate([[0], ends[:-1]])
    end_of = np.repeat(ends, ends - starts)[:n]
    inside = np.arange(n) + window <= end_of
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    edge = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    last = edge[np.searchsorted(edge, first, side="right")]
    count = last - first
    # sums of h[i] * BASE^i tell stretches apart; BASE is odd and so can be divided out
    power = np.full(len(h), BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(h * power)])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    back = np.full(len(h), inverse, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    whole = (total[first + count + window - 1] - total[first]) * back[first]
    return first, count, at[first] - first, gram[at[first]], mixed(whole + count.astype(np.uint64) * M)


def scan(df: DataFrame, key: str, text: str, window: int, anchor: int) -> DataFrame:
    """prefix, segment, id, text_id, first, n, ahead: the segments of all texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(SEED)

        def emit(own, names, words, ends, base=0):
            h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
            e = np.array(ends, dtype=np.int64)
            first, count, ahead, prefix, segment = segments(h, e, window, anchor)
            doc = np.searchsorted(e, first, side="right")
            before = np.concatenate([[0], e])[doc]
            return pa.RecordBatch.from_pydict(
                {
                    "prefix": pa.array(prefix.astype(np.int64)),
                    "segment": pa.array(segment.astype(np.int64)),
                    "id": pa.array(np.array(own, dtype=np.int64)[doc]),
                    "text_id": pa.array(np.array(names, dtype=np.int64)[doc]),
                    "first": pa.array((first - before + base).astype(np.int64)),
                    "n": pa.array(count.astype(np.int32), pa.int32()),
                    "ahead": pa.array(ahead.astype(np.int32), pa.int32()),
                }
            )

        for b in slices(batches):
            own, names, words, ends = [], [], [], []
            for i, name, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                w = data.split()
                if len(w) < window:
                    continue
                # a text of very many words goes by stretches that overlap by a window less one
                step = 8_000_000
                for lo in range(step, max(1, len(w) - window + 1), step):
                    yield emit([i], [name], part := w[lo : lo + step + window - 1], [len(part)], lo)
                part = w[: step + window - 1]
                if len(words) + len(part) > 2_000_000 and words:
                    yield emit(own, names, words, ends)
                    own, names, words, ends = [], [], [], []
                words += part
                own.append(i)
                names.append(name)
                ends.append(len(words))
            if words:
                yield emit(own, names, words, ends)

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), text_id(text), raw(text).alias("text"))
    return rows.mapInArrow(run, "prefix long, segment long, id long, text_id long, first long, n int, ahead int")


#: A suffix group's row: windows base to base + n - 1 of a segment and their words; the prefix of the
#: group stands `ahead` words from the first.
PIECE = "unit long, prefix long, segment long, id long, base int, n int, ahead int, words binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECE.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, cols, KINDS, strict=True)})


def cut_words(df: DataFrame, window: int) -> DataFrame:
    """The pieces of wanted segments, in groups by the shortest prefix. df: text (binary), id, wanted
    (array of prefix, segment, first, n, ahead)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for data, i, wanted in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                w = data.split()
                for s in wanted:
                    words = b" ".join(w[s["first"] : s["first"] + s["n"] + window - 1])
                    out.append((s["prefix"], s["prefix"], s["segment"], i, 0, s["n"], s["ahead"], words))
            yield batch_of(out)

    return df.mapInArrow(run, PIECE)


def span_of(ahead: int, most: int, level: int) -> tuple[int, int]:
    """Of the distances 0 to most from a window's start to its prefix: those that share a group with
    `ahead` after so many halvings."""
    lo, hi = 0, most
    for _ in range(level):
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if ahead > mid else (lo, mid)
    return lo, hi


def lengthen(df: DataFrame, window: int, most: int, level: int) -> DataFrame:
    """Pieces of groups that are too large after `level` halvings, halved again. A half goes by all words
    that windows of its distances have in common, so equal windows stay in one group."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="words"):
            out = []
            for _, prefix, segment, i, base, n, ahead, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words.split()
                lo, hi = span_of(ahead, most, level)
                mid = (lo + hi) // 2
                far = max(0, min(n, ahead - mid))  # windows whose prefix is further away than mid
                for at, m, least, greatest in ((0, far, mid + 1, hi), (far, n - far, lo, mid)):
                    if m:
                        core = w[ahead - least : ahead - greatest + window]
                        name = hashlib.blake2b(b"%d " % greatest + b" ".join(core), digest_size=8).digest()
                        out.append((int.from_bytes(name, "little", signed=True), prefix, segment, i, base + at, m, ahead - at, b" ".join(w[at : at + m + window - 1])))
            yield batch_of(out)

    return df.mapInArrow(run, PIECE)


def suffix_tree(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the tree of all suffixes in order (text, place in it), and how many words each shares
    with the one before: what a node holds is a stretch of leaves that share its depth. Ranks of
    1, 2, 4, ... words give the order, and the shared words by steps of falling size."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    n = len(rank)
    left = np.repeat(sizes.cumsum(), sizes) - np.arange(n)  # words from here to the text's end
    ranks, depth = [rank], 1
    while depth < sizes.max(initial=0):
        after = np.zeros(n, dtype=np.int64)
        whole = np.flatnonzero(left > depth)
        after[whole] = rank[whole + depth] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        ranks.append(rank)
        depth *= 2
    order = np.argsort(rank, kind="stable")
    here, prior = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(n, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        both = np.flatnonzero((left[order[1:]] - shared[1:] >= step) & (left[order[:-1]] - shared[1:] >= step))
        same = both[ranks[level][here[both]] == ranks[level][prior[both]]]
        shared[1 + same] += step
        # a stretch that reaches a text's end has nothing behind it to compare
        here[same] = np.minimum(here[same] + step, n - 1)
        prior[same] = np.minimum(prior[same] + step, n - 1)
    text = np.repeat(np.arange(len(texts)), sizes)[order]
    start = np.concatenate([[0], sizes.cumsum()[:-1]])
    return text, order - start[text], shared


def deep_leaves(texts: list[list[bytes]], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, smallest owner) of each leaf below an internal node of at least `window` words; the
    owner is that of the whole node. By text and place."""
    text, place, shared = suffix_tree(texts)
    if not len(text):
        return text, place, text
    first = np.flatnonzero(shared < window)  # a leaf, or the leaves of one of the topmost deep nodes
    least = np.minimum.reduceat(owners[text], first)
    size = np.diff([*first, len(text)])
    keep = np.repeat(size > 1, size)
    text, place, least = text[keep], place[keep], np.repeat(least, size)[keep]
    order = np.lexsort((place, text))
    return text[order], place[order], least[order]


def trees(pieces: DataFrame, window: int) -> DataFrame:
    """prefix, segment, id, at, n: stretches of windows of an owner's segment that a smaller
    document has too. pieces: sorted by unit within partitions."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def solve(rows):
            owners = np.array([r[3] for r in rows], dtype=np.int64)
            text, at, least = deep_leaves([r[5] for r in rows], owners, window)
            hit = least < owners[text]
            text, at = text[hit], at[hit]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff([*first, len(text)])
            t = text[first].tolist()
            pick = lambda k: pa.array([rows[j][k] for j in t], pa.int64())
            base = np.array([rows[j][4] for j in t], dtype=np.int64)
            return pa.RecordBatch.from_pydict({"prefix": pick(1), "segment": pick(2), "id": pick(3), "at": pa.array(at[first] + base), "n": pa.array(count.astype(np.int64))})

        rows, words, unit = [], 0, None
        for b in slices(batches, column="words"):
            for r in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 7)), strict=True):
                # a group stays together: a cut comes only where the unit changes
                if r[0] != unit and words > RANKED:
                    yield solve(rows)
                    rows, words = [], 0
                unit = r[0]
                w = r[5].split()
                words += len(w)
                rows.append((*r[:5], w))
        if rows:
            yield solve(rows)

    return pieces.mapInArrow(run, FOUND)


#: Windows at to at + n - 1 of an owner's segment that a smaller document has too.
FOUND = "prefix long, segment long, id long, at long, n long"


def repeats_in_groups(pieces: DataFrame, window: int, most: int, group: int) -> DataFrame:
    """FOUND, of pieces grouped by the shortest prefix; groups above `group` pieces get longer ones."""
    fit, level, alone = [], 0, None
    while True:
        counts = pieces.groupBy("unit").agg(F.count(F.lit(1)).alias("c"))
        if counts.where(F.col("c") > group).isEmpty():
            fit.append(pieces)
            break
        told = spread_join(pieces, counts.withColumn("large", F.col("c") > group), ["unit"], "c", pieces.count())
        told = materialize(told, "measured").select(*pieces.columns, "large")
        fit.append(told.where("NOT large").drop("large"))
        pieces = materialize(lengthen(told.where("large").drop("large"), window, most, level), "pieces")
        level += 1
        if 1 << level > most:  # one window a piece
            alone = pieces
            break
    whole = functools.reduce(DataFrame.unionByName, fit)
    out = trees(whole.repartition("unit").sortWithinPartitions("unit"), window)
    if alone is None:
        return out
    # where the prefix is the whole window, all leaves of its node are equal, of any number
    same = alone.groupBy("words").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c"))
    equal = spread_join(alone, same, ["words"], "c", alone.count()).where("low < id")
    return out.unionByName(equal.select("prefix", "segment", "id", F.col("base").cast("long").alias("at"), F.lit(1).cast("long").alias("n")))


def strip(df: DataFrame, key_type: str, key: str, window: int, keep_text: bool) -> DataFrame:
    """Drop the covered words. df: key, text (binary), covered (array of at, n in windows)."""
    schema = f"{key} {key_type}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, spans array<struct<first: long, n: long>>" if keep_text else "")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, digest, kept, spans = [], [], [], [], []
            for data, covered in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = data.split()
                total.append(len(w))
                cut: list[list[int]] = []
                for lo, hi in sorted((c["at"], c["at"] + c["n"] + window - 1) for c in covered or ()):
                    if cut and lo <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], hi)
                    else:
                        cut.append([lo, hi])
                edges = [0, *(x for c in cut for x in c), len(w)]
                w = [x for lo, hi in zip(edges[::2], edges[1::2], strict=True) for x in w[lo:hi]] if cut else w
                gone.append(total[-1] - len(w))
                text = b" ".join(w)
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text.decode("utf-8", "replace"))
                    spans.append([{"first": lo, "n": hi - lo} for lo, hi in cut])
            cols = {key: b.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))} if keep_text else {}))

    return df.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", keep_text: bool = True, group: int = GROUP) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and, where asked for, kept_text and spans (first, n: removed
    stretches of words) of every document.

    Words covered by a window whose words also start in a document of a smaller key go; windows are
    judged on the input. Null and empty texts have no words. A row without a key neither loses
    words nor makes others lose any. Rows of the same key never judge each other. Other columns of df
    aren't read. An empty table gives no rows. window must exceed anchor, a power of two; the key is a whole number.
    """
    if anchor & (anchor - 1) or not 1 < anchor < window:
        raise ValueError("anchor must be a power of two below the window")
    # stored, so that texts are cut once
    found = materialize(scan(df, key, text, window, anchor), "segments")
    total = found.count()
    by = ["prefix", "segment"]
    place = F.min(F.struct("id", "text_id", "first", "n", "ahead")).alias("o")
    owners = found.groupBy(*by).agg(place, F.max("id").alias("hi"), F.count(F.lit(1)).alias("c"))
    owners = materialize(owners.select(*by, F.col("o.id").alias("owner"), "o", "hi", "c"), "owners")
    met = owners.groupBy("prefix").agg(F.min("owner").alias("low"), F.max("hi").alias("high"), F.count(F.lit(1)).alias("s")).where("low < high AND s > 1").select("prefix", "s")
    varied = spread_join(owners.select(*by, "o"), met, ["prefix"], "s", total)
    want = varied.groupBy("o.id", "o.text_id").agg(F.collect_list(F.struct("prefix", "segment", "o.first", "o.n", "o.ahead")).alias("wanted")).withColumnRenamed("text_id", "_t")
    texts = df.select(key, text_id(text).alias("text_id"), raw(text).alias("text"))
    # both joins with the texts shuffle at every size: their other side grows with the corpus
    asked = texts.join(want, F.expr(f"cast({key} as long) = id AND text_id = _t"))
    pieces = materialize(cut_words(asked.select("text", "id", "wanted"), window), "pieces")
    deep = repeats_in_groups(pieces, window, window - anchor, group)
    deep = materialize(deep.groupBy(*by).agg(F.collect_list(F.struct("at", "n")).alias("deep")), "deep")
    # of equal segments, all but the smallest document's are covered whole; in that one, what trees found
    marks = owners.join(deep, by, "left").where("owner < hi OR deep IS NOT NULL").select(*by, "owner", "deep", "c")
    again = spread_join(found.select(*by, "id", "text_id", "first", "n"), marks, by, "c", total).where("id > owner OR deep IS NOT NULL")
    cover = F.expr("if(id > owner, array(named_struct('at', first, 'n', cast(n as long))), transform(deep, d -> named_struct('at', first + d.at, 'n', d.n)))")
    covered = again.select("id", "text_id", F.explode(cover).alias("x")).groupBy("id", "text_id").agg(F.collect_list("x").alias("covered"))
    covered = materialize(covered, "covered").withColumnRenamed("text_id", "_t")
    whole = texts.join(covered, F.expr(f"cast({key} as long) = id AND text_id = _t"), "left").select(key, "text", "covered")
    return strip(whole, dict(df.dtypes)[key], key, window, keep_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep_text=False)
