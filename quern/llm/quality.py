"""Quality classifier with hierarchical empirical Bayes.

A logistic model over words, their beginnings and shapes, fitted on a bounded sample of labelled documents,
gives each document's evidence. Labels, and evidence where there is none, are gathered by host and by
path under it. A site's rate is that of its other documents, without the one that is judged, and is shrunk
to the level above (path to host, host to the whole corpus) the more the fewer documents it has, with a
strength found by moments from the spread between sites. A document's odds are then moved from the
corpus' base rate to its path's. Where pages have addresses, `with_site` gives host and path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, materialize, raw, slices, small, spread_join, text_id
from quern.sources.tables import table

#: Labelled documents that the model is fitted on, at most: those of the smallest hash of their id.
SAMPLE = 8192
#: Hash buckets of words and stems, and how many of them the model keeps for each label: a size of the
#: model, as its features are; every document is judged by all of its words.
WIDTH = 18
HASHED = 1 << WIDTH
CHOSEN = 128
#: Characters of the beginnings of words that count as stems.
STEMS = (4, 5)
BITS = np.arange(16)
SEED = 41
RIDGE = 0.03
SHAPES = 10


class Shapes(dict):
    """Of each word, remembered up to a bound, in one number: the hash buckets of the word and of
    two beginnings, which its inflections share; flags of its shape; its length."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        core = w.strip(b".,;:!?\"'()|").lower()
        flags = (not core) | (not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?\"')") << 1 | core.isdigit() << 2 | w[:1].isupper() << 3
        text = core if core.isascii() else core.decode("utf-8", "replace").lower()
        x = xxhash.xxh3_64_intdigest(text, SEED) & HASHED - 1
        for n in STEMS:  # a short word is its own stem
            x = x << WIDTH | (xxhash.xxh3_64_intdigest(text[:n], SEED + n) & HASHED - 1 if len(text) > n else x & HASHED - 1)
        x = self[w] = x << 8 | flags << 4 | min(15, len(core))
        return x


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def features(texts: list[bytes], known: Shapes) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct buckets of the words and stems of each text, and its shape features."""
    words, shape = [], np.zeros((len(texts), SHAPES))
    for k, t in enumerate(texts):
        w = t.split()
        n = len(w)
        if not n:
            words.append(np.zeros(0, dtype=np.int32))
            shape[k, 9] = 1
            continue
        x = np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=n)
        flags, size = np.bincount((x >> 4) & 15, minlength=16) / n, x & 15
        u = distinct(x) >> 8
        words.append(distinct(np.concatenate([u >> WIDTH * i & HASHED - 1 for i in range(1 + len(STEMS))])).astype(np.int32))
        m = len(distinct(u))
        again = np.count_nonzero(x[1:] == x[:-1]) / max(1, n - 1)
        share = [flags[BITS >> i & 1 == 1].sum() for i in range(4)]
        shape[k] = [*share, size.mean() / 8, size.std() / 8, min(1.0, m / n**0.9), again, np.log1p(n) / 10, 0]
    return words, shape


def choose(pos: np.ndarray, seen: np.ndarray, p: int, n: int, most: int) -> np.ndarray:
    """The `most` buckets that tell a label best, by the squared difference of its two rates over the variance.
    pos, seen: documents with the label, and all, in which each bucket stands."""
    if not 0 < p < n:  # one class only
        return np.zeros(0, dtype=np.int64)
    both = seen / n
    score = (pos / p - (seen - pos) / (n - p)) ** 2 / np.maximum(both * (1 - both), 1e-9)
    score[seen < 4] = 0
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] > 0])


class Model:
    """For one label: chosen buckets, weights over them and the shapes, and the base rate."""

    def __init__(self, chosen: np.ndarray, words: list[np.ndarray], shape: np.ndarray, y: np.ndarray):
        self.rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.words = chosen
        self.column = np.full(HASHED, -1, dtype=np.int32)
        self.column[chosen] = np.arange(len(chosen))
        self.mean, self.scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
        self.w = np.zeros(1 + SHAPES)
        if y.min() == y.max():  # one class only: the base rate
            self.w[0] = np.log(self.rate / (1 - self.rate))
            return
        x = self.matrix(words, shape)
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-6
        for _ in range(25):  # Newton steps
            z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (z * (1 - z) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, x.T @ (y - z) - ridge * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def matrix(self, words: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words), 1 + SHAPES + len(self.words)))
        x[:, 0] = 1
        x[:, 1 : 1 + SHAPES] = (shape - self.mean) / self.scale
        if len(self.words):
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            at = self.column[np.concatenate(words)]
            ok = at >= 0
            x[row[ok], 1 + SHAPES + at[ok]] = 1
        return x

    def __call__(self, words: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        x = self.matrix(words, shape)[:, : len(self.w)]
        return 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))


def fit(df: DataFrame, labels: DataFrame, names: list[str], key: str, text: str, sample: int = SAMPLE, chosen: int = CHOSEN) -> dict[str, Model]:
    """One model a label, on at most `sample` labelled documents. The driver gets counts of buckets
    (HASHED rows at most) and, of each sampled document, its shapes and which chosen buckets it holds."""
    good = labels.select(F.col(key).alias("_key"), *[F.col(n).cast("int").alias(f"_{n}") for n in names]).dropna()
    # a bounded table: `sample` rows at most
    drawn = F.broadcast(good.groupBy("_key").agg(*[F.max(f"_{n}").alias(f"_{n}") for n in names]).orderBy(F.xxhash64("_key"), "_key").limit(sample))
    rows = df.join(drawn, df[key] == drawn["_key"]).select(*[(F.col(f"_{n}") > 0).cast("int").alias(f"_{n}") for n in names], F.xxhash64("_key").alias("_key"), raw(text).alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Shapes()
        for b in slices(batches):
            words, shape = features(b.column(b.num_columns - 1).to_pylist(), known)
            yield pa.RecordBatch.from_pydict({**{f"_{n}": b.column(k) for k, n in enumerate(names)}, "_key": b.column(len(names)), "words": pa.array(words, pa.list_(pa.int32())), "shape": pa.array(list(shape), pa.list_(pa.float64()))})

    found = materialize(rows.mapInArrow(run, ", ".join(f"_{n} int" for n in names) + ", _key long, words array<int>, shape array<double>"), "sample")
    sums = [F.sum(f"_{n}").cast("long").alias(f"_{n}") for n in names]
    total = found.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if not total["n"]:
        return {}
    counts = found.select(*[f"_{n}" for n in names], F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *sums).toArrow()
    spread = lambda c: np.bincount(counts.column("w").to_numpy(), counts.column(c).to_numpy(), HASHED)
    picked = {n: choose(spread(f"_{n}"), spread("n"), total[f"_{n}"], total["n"], chosen) for n in names}
    told = sorted({int(w) for c in picked.values() for w in c})
    kept = F.array_intersect("words", F.lit(np.array(told, dtype=np.int32))) if told else F.slice("words", 1, 0)
    # in the order of the key: sums come out the same however tasks ended
    rows = found.select(*[f"_{n}" for n in names], "_key", kept.alias("words"), "shape").toArrow().sort_by("_key")
    words = [np.asarray(w, dtype=np.int32) for w in rows.column("words").to_pylist()]
    shape = np.array(rows.column("shape").to_pylist())
    return {n: Model(picked[n], words, shape, rows.column(f"_{n}").to_numpy().astype(float)) for n in names}


def evidence(df: DataFrame, models: dict[str, Model], keep: list[str], text: str) -> DataFrame:
    """Columns of `keep`, and the probability of each label by the document alone."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + "".join(f", p_{n} double" for n in models)

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Shapes()
        for b in slices(batches, 4 << 20):
            words, shape = features(b.column(len(keep)).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(m(words, shape)) for m in models.values())], names=[*keep, *(f"p_{n}" for n in models)])

    return df.select(*keep, raw(text).alias("text")).mapInArrow(run, schema)


def with_site(df: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """df with the host of an address and the first folder of its path, in lower case; null where there is none."""
    own = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    folder = F.regexp_extract(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), r"^(/[^/]+)/", 1)
    return df.withColumn(host, own).withColumn(path, F.when(own.isNotNull(), F.lower(folder)))


def strength(sites: DataFrame) -> tuple[float, float]:
    """Mean rate, and documents that the level above counts for: mean * (1 - mean) / variance between
    sites - 1, by moments over sites weighed by size, kept between 1 and 10,000. One row on the driver."""
    n, s, v = (F.col(c) for c in ("_n", "_s", "_v"))
    # between sites: spread of their means less what chance within sites explains
    total, mean, square, chance = sites.agg(F.sum(n), F.sum(s) / F.sum(n), F.sum(s * s / n) / F.sum(n), F.sum(v / n - (s / n) * (s / n)) / F.sum(n)).first()
    if not total:
        return 0.5, 1.0
    between = max(square - mean * mean - chance, 1e-9)
    return mean, min(1e4, max(1.0, mean * (1 - mean) / between - 1))


def shrunk(df: DataFrame, value: str, host: str, path: str) -> DataFrame:
    """df with rate: that of the other documents of its path, shrunk to that of the others of its host,
    which is shrunk to the corpus' mean; and with mean. value: of each document, between 0 and 1. host
    and path hold no null."""
    x = F.col(value)
    paths = df.groupBy(host, path).agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_v"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy(host).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_v").alias("_v"))
    mean, over_host = strength(hosts)
    _, over_path = strength(paths)
    sites = paths.select(host, path, "_n", "_s").join(small(hosts.select(host, F.col("_n").alias("_hn"), F.col("_s").alias("_hs"))), host)
    out = spread_join(df, sites.withColumn("_many", F.col("_n")), [host, path], "_many", df.count())
    of_host = (F.col("_hs") - x + over_host * mean) / (F.col("_hn") - 1 + over_host)
    of_path = (F.col("_s") - x + over_path * of_host) / (F.col("_n") - 1 + over_path)
    return out.withColumn("rate", of_path).withColumn("mean", F.lit(mean)).drop("_n", "_s", "_hn", "_hs")


def logit(p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def classify(
    df: DataFrame, labels: DataFrame, good: str = "quality", bad: str = "toxic", host: str = "source", path: str = "lang",
    key: str = "doc_id", text: str = "text", sample: int = SAMPLE, chosen: int = CHOSEN,
) -> DataFrame:
    """key, text_id, evidence and posterior of both labels, kept.

    Kept: the posterior of `good` is at least a half and that of `bad` less. Without labels every
    document is kept. Labels with nulls aren't used, of several for a key the largest counts. Null
    hosts and paths are sites of their own; null and empty texts have no words. Repeated rows are judged
    alike. An empty table gives no rows. sample: labelled documents that the model is fitted on, at most;
    chosen: buckets of words that it keeps for a label. Labels beyond the sample count at their sites.
    """
    models = fit(df, labels, [good, bad], key, text, sample, chosen)
    if not models:
        half = F.lit(1.0)
        return df.select(key, text_id(text).alias("text_id"), *[half.alias(f"{a}_{b}") for b in (good, bad) for a in ("evidence", "posterior")], F.lit(True).alias("kept"))
    site = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c).cast("string")))
    x = df.select(F.col(key).alias("_key"), text_id(text).alias("text_id"), site(host).alias("host"), site(path).alias("path"), F.col(text).alias("text"))
    found = evidence(x, models, ["_key", "text_id", "host", "path"], "text")
    known = labels.select(F.col(key).alias("_key"), *[(F.col(n).cast("int") > 0).cast("double").alias(f"y_{n}") for n in (good, bad)]).dropna()
    known = known.groupBy("_key").agg(*[F.max(f"y_{n}").alias(f"y_{n}") for n in (good, bad)])
    out = materialize(found.join(small(known), "_key", "left"), "evidence")
    for n in (good, bad):
        out = shrunk(out.withColumn("_value", F.coalesce(f"y_{n}", f"p_{n}")), "_value", "host", "path")
        moved = logit(F.col(f"p_{n}")) + logit(F.col("rate")) - logit(F.col("mean"))
        out = out.withColumn(f"posterior_{n}", 1 / (1 + F.exp(-moved))).drop("_value", "rate", "mean")
    kept = (F.col(f"posterior_{good}") >= 0.5) & (F.col(f"posterior_{bad}") < 0.5)
    return out.select(F.col("_key").alias(key), "text_id", *[F.col(c).alias(c.replace("p_", "evidence_") if c.startswith("p_") else c) for n in (good, bad) for c in (f"p_{n}", f"posterior_{n}")], kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("text_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    found = classify(docs, table(spark, sf_dir, "labels"))
    gone = materialize(found.where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_id").alias("_gone_text")).distinct(), "rejected")
    left = docs.withColumn("_text_id", text_id())
    return left.join(small(gone), F.expr("doc_id <=> _gone AND _text_id = _gone_text"), "left_anti").drop("_text_id")
