"""Secret scans: three base patterns, and a linear-chain conditional random field that adds spans.

The field tags words as begin (B), inside (I) or outside (O) of a secret. Its features are the
class of a word (shape, length, mixture of characters, key words), the classes of the word after and of
the two before, and how much the whole file looks like code. It is trained here on generated files of
prose, settings, code, logs and listings, in which hashes, names of versions and other random words that
are no secrets stand in other places than secrets do. Words whose margin for O is larger than any gain from
transitions are O on the best path, whatever their neighbours; Viterbi runs on the stretches between
them, and its result is that of a run over the whole text.

A span of the field inside a base span says nothing new and is left out; one that goes beyond it is kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import documents, raw, slices

KINDS = ("assign", "access", "hex", "crf")
# bytes patterns: only A-Z and a-z have two cases, and no byte of a longer character matches
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KEYS = re.compile(rb"(?i)passw|passphrase|secret|token|api_?key|credential|private|bearer|authorization|access_?key|auth_|[a-z]_key")
#: Beginnings that issuers give to their secrets (fixed values).
ISSUED = re.compile(rb"(?:sk|pk|rk|gh[opsu]|glpat|xox[abprs]|AKIA|eyJ)[-_A-Za-z0-9]{12,}")
NAMED = re.compile(rb"""[A-Za-z_.-]*(?i:passw|passphrase|secret|token|key|credential|auth)[A-Za-z_]*["']?[:=]+["']?(?=.)""")
EDGE = b"\"'`,;:()[]{}<>#!?*&$%@~^|."
MASK = "<secret>"

O, B, I = 0, 1, 2
CLASSES = 512
FIRST, LAST = CLASSES - 2, CLASSES - 1
FILES = 4


def word_class(w: bytes) -> int:
    """Shape of a word in one of 512 numbers: signs of code, whether a sign ties it to the next word, one
    of 16 kinds, one of 8 lengths."""
    core = w.strip(EDGE)
    n = len(core)
    code = any(c in b"={}();_<>[]\\" for c in w)
    tied = w.rstrip(b"\"'")[-1:] in (b"=", b":")
    size = 0 if n < 8 else 1 if n < 12 else 2 if n < 16 else 3 if n < 20 else 4 if n < 32 else 5 if n < 48 else 6
    digits = sum(48 <= c <= 57 for c in core)
    if not n or core in (b"=", b"==", b":=", b"-") or not core.strip(b"-"):
        kind, size = 0, 3 if b"=" in w else 2 if b":" in w else 1 if b"-" in w else 0
    elif ISSUED.match(core) and digits:
        kind = 12
    elif KEYS.search(core):
        kind = 1 if n < 24 else 2
    elif core.isdigit():
        kind = 3
    elif any(c >= 128 for c in core):
        kind = 4
    else:
        up = any(65 <= c <= 90 for c in core[1:])
        low = any(97 <= c <= 122 for c in core)
        other = sum(not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in core)
        mixed = up and low
        if not digits and not other:
            kind = 6 if mixed else 5
        elif b"://" in core or b"@" in core.strip(b"@") and b"." in core or core.startswith(b"www."):
            kind = 7
        elif other > n // 3:
            kind = 8
        elif digits and not other and all(c in b"0123456789abcdefABCDEF" for c in core):
            kind = 9
        elif digits and (low or up):
            kind = (13 if mixed else 10) if not other else (14 if mixed else 11)
        else:
            kind = 15
    return code << 8 | tied << 7 | kind << 3 | size


def shared() -> np.ndarray:
    """For each class the features that it shares with others, beside one of its own."""
    c = np.arange(CLASSES)
    parts = [c, c >> 3 & 15, c & 7, c >> 7, c >> 3 & 31, (c >> 8) << 4 | c >> 3 & 15]
    return np.concatenate([np.eye(x.max() + 1)[x] for x in parts], axis=1)


class Known(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        x = self[w] = word_class(w)
        return x


def file_kind(classes: np.ndarray) -> int:
    """How much of the text looks like code."""
    share = (classes >= 256).mean() if len(classes) else 0.0
    return int(share > 0.02) + int(share > 0.15) + int(share > 0.4)


Line = tuple[list[bytes], list[int]]


def training_files(n: int = 700, seed: int = 3) -> list[Line]:
    """Generated files, words with tags: each of one style, with secrets of many forms and what looks like them."""
    r = np.random.default_rng(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = letters + letters.upper() + digits
    num = lambda a, b: int(r.integers(a, b))
    pick = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    one = lambda *x: x[num(0, len(x))]
    word = lambda: pick(letters, num(1, 13))
    sure = lambda s: s[:2] + pick(digits, 2) + s[4:]
    hexed = lambda k: sure(pick("0123456789abcdef", k))
    uuid = lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
    many = lambda f, a, b: [f() for _ in range(num(a, b))]

    def secret() -> str:
        k, size = num(0, 7), num(16, 64)
        if k == 0:
            return hexed(one(32, 40, 64))
        if k == 1:
            return sure(pick(both, size))
        if k == 2:
            return sure(pick(both + "+/", size)) + "=="
        if k == 3:
            return one("sk-", "sk_live_", "ghp_", "xoxb-", "pk_") + sure(pick(both, size))
        if k == 4:
            return "AKIA" + pick(letters.upper() + digits, 16)
        if k == 5:
            return sure(pick(both + "_-", size))
        return one(letters, both)[0] + pick(both, num(5, 10)) + pick("!@%^*", 1) + pick(digits, 2)

    def name() -> str:
        return one("", "", word() + "_", word() + ".", word().upper() + "_") + one("password", "secret", "token", "api_key", "SECRET_KEY", "auth_token", "private_key", "credential", "passphrase", "DB_PASSWORD", "access_key")

    def plain() -> str:
        k = num(0, 16)
        if k < 9:
            return word()
        return [
            word().capitalize() + ".",
            word() + ",",
            pick(digits, num(1, 17)),
            f"https://{word()}.example.com/{word()}/{pick(digits, 3)}",
            f"{word()}.{pick(digits, 2)}@{word()}.example.com",
            ".".join(pick(digits, num(1, 4)) for _ in range(4)),
            f"20{pick(digits, 2)}-0{num(1, 9)}-1{num(0, 9)}",
        ][k - 9]

    def prose() -> list[tuple[str, int]]:
        out = [(x, O) for x in many(plain, 4, 14)]
        k = num(0, 10)
        if k == 5:
            out += [(name(), O), ("=", O), (one('"{}"', "{}").format(secret()), B)]
        if k == 0:
            out += [("the", O), (one("password", "passphrase", "token", "secret"), O), ("is", O), (secret(), B)]
        elif k == 1:
            out += [(one("password:", "passphrase:", "secret:", "token:"), O), (secret(), B)]
        elif k == 2:
            out += [(one("commit", "revision", "build", "order", "ticket", "see"), O), (one(hexed(40), hexed(12), pick(both, num(8, 20)), uuid()), O)]
        elif k == 3:
            out += [("the", O), (one("secret", "token", "password", "private"), O), (one("garden", "ring", "is", "was", "of", "door", "field"), O), (word(), O)]
        elif k == 4:
            half = lambda: sure(pick(letters.upper() + digits, 16))
            out += [(one("key:", "secret:", "token:"), O), (half(), B), (half(), I)]
        return out + [(x, O) for x in many(plain, 2, 10)]

    def settings() -> list[tuple[str, int]]:
        k, other = num(0, 8), one("path", "host", "id", "digest", "checksum", "version", "commit", "etag", "size", "name", "region")
        value = one(word(), pick(digits, num(1, 6)), uuid(), hexed(one(32, 40, 64)), "sha256:" + hexed(64), f"/{word()}/{word()}", f"v{num(0, 9)}.{num(0, 20)}.{num(0, 9)}", pick(both, num(8, 30)), "true")
        if k == 0:
            return [(name(), O), ("=", O), (one('"{}"', "'{}'", "{}").format(secret()), B)]
        if k == 1:
            return [(name() + ":", O), (one('"{}"', "{}").format(secret()), B)]
        if k == 2:
            return [(name() + one("=", ":") + secret(), B)]
        if k == 3:
            return [(name(), O), (one("=", ":"), O), (one('""', "null", "true", "$" + "{" + word().upper() + "}", word()), O)]
        if k == 4:
            return [(other + one("=", ":") + value, O)]
        return [(other, O), ("=", O), (one('"{}"', "{}").format(value), O)] if k < 7 else [(other + ":", O), (value, O)]

    def code() -> list[tuple[str, int]]:
        k = num(0, 8)
        if k == 0:
            return [("headers", O), ("=", O), ('{"Authorization":', O), ('"Bearer', O), (secret() + '"}', B)]
        if k == 1:
            return [(name(), O), ("=", O), (f'"{secret()}"', B)]
        if k == 2:
            return [("assert", O), (f"{word()}({word()})", O), ("==", O), (f'"{one(hexed(40), hexed(64), pick(both, 24))}"', O)]
        if k == 3:
            return [(name(), O), ("=", O), (one(f"os.environ['{one(word(), name()).upper()}']", f"read_{word()}()", "None"), O)]
        if k == 4:
            return [("def", O), (f"{word()}({word()},", O), (f"{word()}):", O), ("return", O), (word(), O)]
        if k == 5:
            return [("import", O), (f"{word()}.{word()}", O), ("#", O), *((x, O) for x in many(word, 2, 6))]
        return [(word(), O), ("=", O), (f"{word()}({pick(digits, 2)},", O), (f"{word()}[{num(0, 9)}])", O)]

    def log() -> list[tuple[str, int]]:
        out = [(f"20{pick(digits, 2)}-0{num(1, 9)}-1{num(0, 9)}", O), (":".join(pick(digits, 2) for _ in range(3)), O), (one("INFO", "WARN", "ERROR"), O), (f"id={one(uuid(), hexed(16), hexed(32))}", O)]
        out += [(x, O) for x in many(word, 2, 7)]
        if num(0, 6) == 0:
            return out + [("Authorization:", O), ("Bearer", O), (secret(), B)]
        return out + [(one("request", "etag", "digest", "session"), O), (one(hexed(32), uuid(), pick(both, num(10, 30))), O)]

    def listing() -> list[tuple[str, int]]:
        return [(one(hexed(40), hexed(64), uuid(), pick(both, num(20, 44))), O), (f"{word()}/{word()}.{one('py', 'bin', 'txt')}", O)]

    files = []
    for _ in range(n):
        style = [prose, prose, settings, settings, code, log, listing][num(0, 7)]
        lines = [x for _ in range(num(1, 6)) for x in style()]
        files.append(([x.encode() for x, _ in lines], [t for _, t in lines]))
    return files


class Field:
    """Weights: of a word's own class, of the classes before, two before and after, of the file, of transitions."""

    def __init__(self, own, before, second, after, file, move):
        self.own, self.before, self.second, self.after, self.file, self.move = own, before, second, after, file, move
        gain = move[:, :, None] + move[None, :, :]  # [y before, y, y after]
        alone = move[:, O][:, None] + move[O][None, :]
        #: No change of one tag to O loses more than this by transitions.
        self.most = float(max(0.0, (gain - alone[:, None, :]).max()))

    def scores(self, c: np.ndarray, file: int) -> np.ndarray:
        c = np.concatenate([[FIRST, FIRST], c, [LAST]])
        return self.own[c[2:-1]] + self.before[c[1:-2]] + self.second[c[:-3]] + self.after[c[3:]] + self.file[file]

    def viterbi(self, s: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """Best tags of a stretch between tags that are known (None: the text's edge)."""
        best = s[0] + (self.move[before] if before is not None else 0)
        back = []
        for k in range(1, len(s)):
            both = best[:, None] + self.move
            back.append(both.argmax(axis=0))
            best = both.max(axis=0) + s[k]
        if after is not None:
            best = best + self.move[:, after]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tag(self, c: np.ndarray, file: int) -> np.ndarray:
        s = self.scores(c, file)
        sure = s[:, O] - s[:, 1:].max(axis=1) > self.most
        tags = np.zeros(len(c), dtype=np.int8)
        open_ = np.flatnonzero(~sure)
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                lo, hi = int(run[0]), int(run[-1]) + 1
                tags[lo:hi] = self.viterbi(s[lo:hi], O if lo else None, O if hi < len(c) else None)
        return tags


@functools.cache
def trained(rounds: int = 120, rate: float = 0.3, decay: float = 5e-5) -> Field:
    """Maximum conditional likelihood by AdaGrad over forward-backward sums."""
    files = training_files()
    n, longest = len(files), max(len(w) for w, _ in files)
    size = np.array([len(w) for w, _ in files])
    inside = np.arange(longest)[None, :] < size[:, None]
    own, tags = np.full((n, longest + 3), LAST), np.zeros((n, longest), dtype=np.int64)
    own[:, :2] = FIRST
    file = np.zeros(n, dtype=np.int64)
    for k, (w, t) in enumerate(files):
        c = np.array([word_class(x) for x in w])
        own[k, 2 : 2 + len(c)], tags[k, : len(c)], file[k] = c, t, file_kind(c)
    spots = [own[:, 2:-1], own[:, 1:-2], own[:, :-3], own[:, 3:]]
    # a class weighs what its own feature and those it shares with others weigh together
    parts = shared()
    theta = [*(np.zeros((parts.shape[1], 3)) for _ in spots), np.zeros((FILES, 3)), np.zeros((3, 3))]
    sums = [np.full_like(x, 1e-8) for x in theta]
    real = np.eye(3)[tags] * inside[:, :, None]
    pairs = inside[:, 1:]
    moved = np.zeros((3, 3))
    np.add.at(moved, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    flat = [x.ravel() for x in spots]
    for _ in range(rounds):
        w = [*(parts @ x for x in theta[:4]), *theta[4:]]
        s = sum(x[at] for x, at in zip(w, spots, strict=False)) + w[4][file][:, None, :]
        a = np.zeros((n, longest, 3))
        b = np.zeros((n, longest, 3))
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            x = a[:, t - 1][:, :, None] + w[5]
            m = x.max(axis=1)
            step = m + np.log(np.exp(x - m[:, None, :]).sum(axis=1)) + s[:, t]
            a[:, t] = np.where(inside[:, t][:, None], step, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = w[5] + (s[:, t + 1] + b[:, t + 1])[:, None, :]
            m = x.max(axis=2)
            step = m + np.log(np.exp(x - m[:, :, None]).sum(axis=2))
            b[:, t] = np.where(inside[:, t + 1][:, None], step, 0.0)
        top = a[:, -1].max(axis=1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1))
        p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
        two = a[:, :-1, :, None] + w[5] + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        two = (np.exp(two) * pairs[:, :, None, None]).sum(axis=(0, 1))
        d = real - p
        grads = [parts.T @ np.stack([np.bincount(at, d[:, :, y].ravel(), CLASSES) for y in range(3)], axis=1) for at in flat]
        grads.append(np.stack([np.bincount(file, d[:, :, y].sum(axis=1), FILES) for y in range(3)], axis=1))
        grads.append(moved - two)
        for x, g, q in zip(theta, grads, sums, strict=True):
            g = g - decay * n * x
            q += g * g
            x += rate * g / np.sqrt(q)
    return Field(*(parts @ x for x in theta[:4]), *theta[4:])


def base_spans(data: bytes, longest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    out = []
    low = data.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[1]) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= 16]
    if longest >= 32:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return out


#: What may be at the ends of a secret; all else around a word of one is no part of it.
ENDS = re.compile(rb"[A-Za-z0-9+/=_!@%^*~-]")
QUOTE = re.compile(rb"""["'`]""")


def field_spans(data: bytes, words: list[bytes], field: Field, known: Known) -> list[tuple[int, int]]:
    """Spans of runs of B and I in bytes, without the name and sign before a value and quotes around it."""
    c = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    tags = field.tag(c, file_kind(c))
    hit = np.flatnonzero(tags)
    if not len(hit):
        return []
    last = int(hit[-1])
    spots = []
    for k, m in enumerate(WORD.finditer(data)):
        spots.append(m.span())
        if k == last:
            break
    out, run = [], []
    for k in hit.tolist():
        if run and (k != run[-1] + 1 or tags[k] == B):
            out.append((run[0], run[-1]))
            run = []
        run.append(k)
    out.append((run[0], run[-1]))
    spans = []
    for a, b in out:
        lo, hi = spots[a][0], spots[b][1]
        name = NAMED.match(data[lo:hi])
        lo += name.end() if name else 0
        while lo < hi and not ENDS.match(data[lo : lo + 1]):
            lo += 1
        quote = QUOTE.search(data, lo, hi)
        hi = quote.start() if quote else hi
        while lo < hi and not ENDS.match(data[hi - 1 : hi]):
            hi -= 1
        if hi > lo:
            spans.append((lo, hi))
    return spans


def find(data: bytes, field: Field, known: Known) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    words = data.split()
    if not words:
        return []
    base = base_spans(data, max(map(len, words)))
    # what lies within a base span says nothing new; what goes beyond one stays
    added = [(lo, 3, hi) for lo, hi in field_spans(data, words, field, known) if not any(s <= lo and hi <= e for s, _, e in base)]
    found = base + added
    if not found:
        return []
    if data.isascii():
        return sorted(found)
    edges = sorted({x for s, _, e in found for x in (s, e)})
    place, at, n = {}, 0, 0
    for x in edges:  # each stretch is decoded once
        n += len(data[at:x].decode("utf-8", "replace"))
        place[x], at = n, x
    return sorted((place[s], k, place[e]) for s, k, e in found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_crf (spans that the field added) of every document.

    Null and empty texts have no spans. Rows are independent: repeated and null keys pass through.
    An empty table gives no rows.
    """
    field = trained()
    schema = f"{key} {dict(df.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in slices(batches):
            all_ = [find(x, field, known) for x in b.column(1).to_pylist()]
            count = lambda k: pa.array([sum(s[1] == k for s in x) for x in all_], pa.int64())  # noqa: B023, E731
            base = [hashlib.sha256(written([s for s in x if s[1] < 3]).encode()).hexdigest() for x in all_]
            yield pa.RecordBatch.from_pydict({key: b.column(0), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": pa.array(base, pa.string()), "spans": pa.array([written(x) for x in all_], pa.string()), "n_crf": count(3)})

    return df.select(key, raw(text).alias("text")).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """df with every span in its texts put as <secret>, and the number of characters counted anew
    where there is such a column. Null texts stay null."""
    field = trained()
    names = df.columns
    schema = df.schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Known()
        at = names.index(text)
        for part in slices(batches, 4 << 20, text):
            texts, sizes, cols = [], [], list(part.columns)
            old = part.column(names.index(size)).to_pylist() if size in names else [None] * part.num_rows
            for t, n in zip(part.column(at).to_pylist(), old, strict=True):
                spans = find(t.encode("utf-8", "replace"), field, known) if t else []
                if spans:
                    out, here = [], 0
                    for s, _, e in spans:
                        if s >= here:
                            out += [t[here:s], MASK]
                        here = max(here, e)
                    t = "".join([*out, t[here:]])
                    n = len(t)
                texts.append(t)
                sizes.append(n)
            cols[at] = pa.array(texts, part.schema.field(at).type)
            if size in names:
                cols[names.index(size)] = pa.array(sizes, part.schema.field(names.index(size)).type)
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return redact(docs)
