"""Best-fit packing of documents into sequences by the sum of squares.

Only lengths matter for a packing, and there are at most `capacity` of them: the corpus is counted
by length, the counts are packed, longest first, and each piece takes its place by its rank among the
pieces of its length: by a hash, or by its place in the input where that is to be kept. Pieces of a
length are placed some at a time, a fixed share of them by each decision, so that a corpus of any size
takes as many decisions as its lengths do. Bins that hold the same are held as one with a number.

Where the order is kept, bins come in a random order, and each takes the first pieces of its lengths
that are left: early bins hold early pieces of every length. Sequences are then numbered by their
longest pieces, so that the first sequences hold the first part of the input.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, input_order, materialize, rank_in_group, rank_in_order, raw, slices, small, text_id

CAPACITY = 4096
END = 1
#: Decisions that the pieces of one length take, about; with them the work on the driver is bounded.
BATCHES = 128
#: Pieces of a length that are placed together by a task.
PART = 4096
SEED = 31
#: Marks that are a token of their own at the end of a word.
TAIL = ".,;:!?|%$*&#\"()"
#: Words that the tokenizer's normalizer leaves as they are, and its pattern whole.
LETTERS = "^[a-zß-öø-ÿ]+$"
#: Of the bytes of such words, those that another character stands for in the vocabulary.
MARKS = {"\x9f": "Ł", "\xa0": "ł", "\xad": "Ń"}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as little-endian bytes, by way of remembered words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words. Each word of some texts is looked up once. Words of Latin letters go to the tokenizer's merges
    in lower case, many at a time, without the marks behind them: each ends with one token that closes a
    word. So do other words of letters only, but through the whole tokenizer. All others go to it one by one.
    """

    def __init__(self, path: str, bound: int = 300_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.t.model)  # the same model, not a copy
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.closes = np.zeros(self.t.get_vocab_size(), dtype=bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # ids of words, of words without marks and in lower case, and of marks
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}
        self.bound = bound

    def ids(self, text: str) -> np.ndarray:
        # the fast form leaves out offsets, which nobody reads here
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def closed(self, n: int, ids: np.ndarray) -> list[bytes] | None:
        """The ids of n words apart, if each ends with a token that closes a word."""
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != n or ends[-1] != len(ids):
            return None
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def learn_latin(self, words: list[bytes]) -> None:
        text = b" ".join(words).decode("latin-1")
        for byte, mark in MARKS.items():
            text = text.replace(byte, mark)
        found = self.closed(len(words), np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))
        if found:
            self.words.update(zip(words, found, strict=True))
        else:
            self.learn(words)

    def learn_cores(self, cores: list[str]) -> None:
        plain = [c for c in cores if c.isalpha() and "İ" not in c]
        if plain:
            self.cores.update(zip(plain, self.closed(len(plain), self.ids(" ".join(plain))) or (), strict=False))
        for c in cores:
            if c not in self.cores:
                self.cores[c] = self.ids(c).tobytes()

    def learn(self, new: list[bytes]) -> None:
        if len(self.cores) > self.bound // 2:
            self.cores = {"": b""}
        cores, tails = [], []
        for s in b"\n".join(new).decode("utf-8", "replace").split("\n"):
            core = s.rstrip(TAIL)
            last = core[-1:]
            # in lower case the letter İ ends in a mark, which joins the marks behind it
            if (last.isalpha() or last.isdecimal()) and last != "İ" and "<|" not in s:
                cores.append(core.lower() if core.isascii() else core)
                tails.append(s[len(core) :])
            else:
                cores.append(s)
                tails.append("")
        self.learn_cores(list(set(cores).union(tails).difference(self.cores)))
        known = self.cores
        self.words.update(zip(new, [known[c] + known[t] if t else known[c] for c, t in zip(cores, tails, strict=True)], strict=True))

    def known(self, latin: list[bytes], others: list[bytes]) -> list[bytes]:
        """Ids of distinct words, and of others that may repeat some. The newest half of what is remembered stays."""
        for words, learn in ((latin, self.learn_latin), (others, self.learn)):
            new = [w for w in words if w not in self.words]
            if new:
                learn(new)
        found = [self.words[w] for w in itertools.chain(latin, others)]
        if len(self.words) > self.bound:
            self.words = dict(itertools.islice(self.words.items(), len(self.words) - self.bound // 2, None))
        return found

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of each of some distinct words, which two ids in the list are its own: of the word, or of the word without
        marks in lower case, and of the marks."""
        core = pc.ascii_rtrim(words, characters=TAIL)
        low = pc.ascii_lower(core)
        easy = pc.match_substring_regex(low, LETTERS).to_numpy(zero_copy_only=False)
        stem = np.asarray(pc.binary_length(core))
        marked = np.flatnonzero(easy & (stem < np.asarray(pc.binary_length(words))))
        plain = lambda x: x.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # noqa: E731; faster than to_pylist
        ends = pa.array([w[n:] for w, n in zip(plain(words.take(pa.array(marked))), stem[marked].tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        stems = low.filter(pa.array(easy)).dictionary_encode()
        latin, marks, hard = plain(stems.dictionary), ends.dictionary.to_pylist(), plain(words.filter(pa.array(~easy)))
        found = self.known(latin, [*marks, *hard])
        one, two = np.empty(len(words), dtype=np.int64), np.full(len(words), len(found))
        one[easy] = stems.indices
        one[~easy] = np.arange(len(latin) + len(marks), len(found))
        two[marked] = len(latin) + np.asarray(ends.indices)
        return one, two, [*found, b""]

    def __call__(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        data = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts.cast(pa.large_binary())
        # cuts at 0x20 and 0x09-0x0D, whatever the other bytes are; ends may give empty words, which have no ids
        split = pc.ascii_split_whitespace(data.view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        one, two, found = self.parts(words.dictionary)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, _ = gathered(np.frombuffer(b"".join(found), dtype="<u4"), size, np.stack([one, two], axis=1).ravel())
        out, end = gathered(flat, size[one] + size[two], np.asarray(words.indices))
        cuts = np.asarray(split.offsets)
        at = np.concatenate([[0], end])[cuts - cuts[0]].tolist()
        return [out[lo:hi].tobytes() for lo, hi in zip(at, at[1:], strict=False)]


def gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches that follow each other in `flat`, those asked for, one after another; and where each ends."""
    n = size[which]
    end = n.cumsum()
    # a stretch's place in `flat`, less its place in the result
    return flat[np.repeat((size.cumsum() - size)[which] - (end - n), n) + np.arange(n.sum())], end


@functools.cache
def encoder(path: str) -> Encoder:
    """One a Python worker: its next tasks find the words of those before."""
    return Encoder(path)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", order: str | None = None) -> DataFrame:
    """Pieces of documents: key, text_id, the column `order` if one is named, piece, start, length,
    ids_crc32, and ids as binary of little-endian unsigned 32-bit numbers, closed by the end id."""
    also = [order] if order else []
    schema = f"{key} {dict(df.dtypes)[key]}, text_id long, {''.join(f'{c} long, ' for c in also)}piece int, start long, length long, ids_crc32 long, ids binary"
    close = np.array([end], dtype="<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches, 2 << 20):
            own, names, at = [], [], []
            for k, ids in enumerate(encode(b.column(b.num_columns - 1))):
                ids += close
                for p in range(0, len(ids), 4 * capacity):
                    own.append(k)
                    names.append(p // (4 * capacity))
                    at.append(ids[p : p + 4 * capacity])
            take = pa.array(own, pa.int64())
            number = np.array(names, dtype=np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    key: b.column(0).take(take),
                    "text_id": b.column(1).take(take),
                    **({order: b.column(2).take(take)} if order else {}),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(number.astype(np.int64) * capacity),
                    "length": pa.array([len(x) // 4 for x in at], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in at], pa.int64()),
                    "ids": pa.array(at, pa.binary()),
                }
            )

    return df.select(key, text_id(text).alias("text_id"), *also, raw(text).alias("text")).mapInArrow(run, schema)


def sum_of_squares(counts: dict[int, int], capacity: int, batches: int = BATCHES, opens: bool = False) -> list[tuple[int, list[int]]]:
    """Kinds of sequences: how many alike there are, and the lengths in each, longest first.

    N(g) open bins have gap g. A piece of length s in a bin of gap g changes the sum of N(g)^2 by
    2 * (N(g - s) - N(g)) + 2, or by 1 - 2 * N(g) where it fills the bin; each goes where the sum
    becomes smallest. Of each length, at most 1/batches of its pieces are placed by one decision (one
    piece, where it has no more than `batches`). opens: whether a new bin, at a change of
    2 * N(capacity - s) + 1, is weighed too, or opened only where no bin fits.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[0] stays 0: full bins aren't open
    far = 4 * sum(counts.values()) + 4
    # bins alike: [how many, last node]; a node is a length and the node before it
    waiting: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    before, length = [-1], [0]
    full: list[list[int]] = []

    def grown(node: int, s: int) -> int:
        before.append(node)
        length.append(s)
        return len(before) - 1

    for s in sorted(counts, reverse=True):
        left, batch = counts[s], -(-counts[s] // batches)
        while left:
            here = count[s:capacity]
            best = -1
            if len(here):
                change = np.where(here > 0, 2 * (count[: capacity - s] - here) + 2, far)
                if here[0]:
                    change[0] = 1 - 2 * here[0]
                best = int(change.argmin())
                if not here[best] or (opens and 2 * count[capacity - s] + 1 < change[best]):
                    best = -1
            if best < 0:
                k = min(left, batch)
                (waiting[capacity - s] if s < capacity else full).append([k, grown(0, s)])
                count[capacity - s] += k if s < capacity else 0
                left -= k
                continue
            g = best + s
            k = min(left, batch, int(count[g]))
            left -= k
            count[g] -= k
            count[g - s] += k if g > s else 0
            to = waiting[g - s] if g > s else full
            while k:
                run = waiting[g][-1]
                m = min(k, run[0])
                to.append([m, grown(run[1], s)])
                run[0] -= m
                k -= m
                if not run[0]:
                    waiting[g].pop()
    out = []
    for runs in (full, *waiting):
        for m, node in runs:
            held = []
            while node:
                held.append(length[node])
                node = before[node]
            out.append((m, held[::-1]))
    return out


def plan(counts: dict[int, int], capacity: int, spread: bool = False, batches: int = BATCHES, opens: bool = False) -> dict[str, np.ndarray]:
    """Where each piece goes: pieces `low` to `high` - 1 of a length, by rank, stand at `at` in the
    sequences from `first` on. spread: sequences come in a random order."""
    kinds = sum_of_squares(counts, capacity, batches, opens)
    if spread:
        kinds = [kinds[i] for i in np.random.default_rng(SEED).permutation(len(kinds))]
    turn = dict.fromkeys(counts, 0)
    rows, first = [], 0
    for m, held in kinds:
        at = 0
        for s in held:
            rows.append((s, turn[s], turn[s] + m, first, at))
            turn[s] += m
            at += s
        first += m
    return dict(zip(("length", "low", "high", "first", "at"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(found: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """Sequence and offset of each piece. found: as of `pieces`, best a stored table. order: the column
    whose order sequences keep."""
    spark = found.sparkSession
    # at most `capacity` rows come to the driver, whatever the corpus
    counted = {int(r[0]): int(r[1]) for r in found.groupBy("length").agg(F.count(F.lit(1))).collect()}
    places = spark.createDataFrame(pa.table({f"_{k}": pa.array(v) for k, v in plan(counted, capacity, spread=order is not None).items()}))
    if order:
        ranked = rank_in_order(found, ["length"], order, ["piece"], "_rank")
    else:
        key_hash = F.xxhash64(F.col(key), "text_id", "piece")
        ranked = rank_in_group(found, ["length"], key_hash, [key, "text_id", "piece"], sum(counted.values()), "_rank")
    # ranks are cut in stretches, so that no task gets all pieces of a length
    places = places.withColumn("_part", F.explode(F.expr(f"sequence(_low div {PART}, (_high - 1) div {PART})")))
    at = ranked.withColumn("_of", F.expr(f"_rank div {PART}")).join(places, F.expr("length = _length AND _of = _part AND _rank >= _low AND _rank < _high"))
    out = at.withColumn("sequence_id", F.expr("_first + _rank - _low")).withColumn("offset", F.col("_at")).select(*found.columns, "sequence_id", "offset")
    if not order:
        return out
    out = materialize(out, "packed")
    # a bin's longest piece comes first
    lead = rank_in_order(out.where("offset = 0").select("sequence_id", order, "piece"), [], order, ["piece"], "_number")
    lead = lead.select(F.col("sequence_id").alias("_id"), "_number")
    return out.join(lead, F.col("sequence_id") == F.col("_id")).withColumn("sequence_id", F.col("_number")).select(*found.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", in_order: bool = False) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated and null keys are documents of
    their own. An empty table gives no rows. Columns beyond key and text aren't read.
    in_order: sequences follow the order of df's rows, else that of hashes.
    """
    order = "_order" if in_order else None
    found = pieces(input_order(df, order) if order else df, path or vocabulary(), capacity, key=key, order=order).drop("ids")
    return pack(materialize(found, "pieces"), capacity, key, order).drop("text_id", "_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in the mixed order, which is that of the files of docs and of the rows in them."""
    return pack_documents(docs, in_order=True)
