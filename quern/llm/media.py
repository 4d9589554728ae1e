"""Media columns: texts as sound. The payload is stored as 8-bit mono WAV, read back by the wave
module, and described by short-time Fourier transforms whose spectral peaks are paired into
fingerprints, stored as time-coded arrays. Media and arrays are columns of the result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import documents, raw, slices

UNIT = 64
RATE = 8000
FRAME = 256
HOP = 128
#: First bin of each band; a frame has at most one peak a band.
BANDS = np.array([1, 4, 8, 16, 32, 64])
FAN = 4
REACH = 16


def payload_of(data: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes, frames_at_once: int = 8192) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame and bin of the spectral peaks, and the number of frames. Bounded memory at any length."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME)
    times, bins = [], []
    for first in range(0, n, frames_at_once):
        last = min(n, first + frames_at_once)
        part = x[first * HOP : (last - 1) * HOP + FRAME].astype(np.float64) - 128.0
        part = np.pad(part, (0, (last - first - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(frames * window, axis=1))[:, :-1]
        best = np.maximum.reduceat(size, BANDS, axis=1)
        where = np.stack([size[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, [*BANDS[1:], size.shape[1]], strict=True)], axis=1)
        t, band = np.nonzero((best >= best.mean(axis=1, keepdims=True)) & (best > 1e-6))
        times.append(t + first)
        bins.append(where[t, band])
    return np.concatenate(times), np.concatenate(bins), n


def fingerprint(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Pairs of a peak and the next ones in reach: time << 32 | bin << 20 | other bin << 8 | distance."""
    out = []
    for k in range(1, FAN + 1):
        a, b = slice(0, -k), slice(k, None)
        gap = times[b] - times[a]
        near = gap <= REACH
        code = (times[a].astype(np.int64) << 32) | (bins[a].astype(np.int64) << 20) | (bins[b].astype(np.int64) << 8) | gap
        out.append(code[near])
    return np.sort(np.concatenate(out))


def describe(data: bytes) -> dict:
    media = store(payload_of(data))
    back = load(media)
    times, bins, n = peaks(back)
    pairs = fingerprint(times, bins)
    return {
        "n_bytes": len(data),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-UNIT:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{n}:{len(times)}:{len(pairs)}:{zlib.crc32(pairs.astype('<i8').tobytes()):08x}",
        "media": media,
        "fingerprint": pairs,
    }


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """One row a document: its key, digests and, where kept, media (binary WAV) and fingerprint
    (array of longs, see `fingerprint`).

    A null text counts as empty; an empty one is a unit of zeros. Equal texts get equal values.
    Rows are independent: repeated and null keys pass through. An empty table gives no rows.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, {DIGESTS}" + (", media binary, fingerprint array<long>" if keep_media else "")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            found = [describe(x) for x in b.column(1).to_pylist()]
            cols = {key: b.column(0)}
            kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
            if keep_media:
                kinds |= {"media": pa.binary(), "fingerprint": pa.list_(pa.int64())}
            cols |= {k: pa.array([f[k] for f in found], kind) for k, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(cols)

    return df.select(key, raw(text).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, and the stored media and fingerprints that they are of."""
    return to_media(documents(spark, sf_dir))
