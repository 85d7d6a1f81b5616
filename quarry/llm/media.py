"""Media columns: payloads as WAV sounds, and fingerprints of pairs of spectral peaks.

A payload is stored as unsigned 8-bit mono samples of a WAV file, which keeps every byte. The features come from the
samples that are read back: short-time Fourier transforms, the strongest peaks of each frame, and pairs of a peak with
peaks of the next frames. A pair is one 32-bit code (first bin, second bin, frames between) with the time of its first
peak: an array of (time << 32 | code), ascending. These arrays are written to a table of the shared folder, and the
feature of a row comes from the array that is read from there.

Null and empty payloads are padded to one block of zeros and have no peaks; equal payloads give equal media and equal
features; of bins that tie in strength the lower one comes first; very long payloads are transformed in parts of _FRAMES
frames, each without its mean; repeated rows each get theirs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of, tune, written

RATE, BLOCK = 8000, 64
WINDOW, HOP, PEAKS, FAN, REACH = 512, 256, 2, 2, 4
#: Frames that are transformed at once.
_FRAMES = 2048
_HANN = np.hanning(WINDOW).astype(np.float32)


def padded(data: bytes) -> bytes:
    """Zeros behind it, up to a positive multiple of a block."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8 bits")
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins (PEAKS a frame, strongest first) and whether each is a peak: above both neighbours and above silence."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-(len(x) - WINDOW) // HOP) + 1) if len(x) > WINDOW else 1
    bins, real = [], []
    for k in range(0, n, _FRAMES):
        m = min(_FRAMES, n - k)
        part = np.zeros((m - 1) * HOP + WINDOW, np.float32)
        got = x[k * HOP : k * HOP + len(part)].astype(np.float32)
        part[: len(got)] = got - got.mean() if len(got) else got
        frames = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(frames * _HANN, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        local = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        top = np.argsort(-local, axis=1, kind="stable")[:, :PEAKS]
        bins.append(top + 1)
        real.append(np.take_along_axis(local, top, 1) > 1e-3)
    return np.concatenate(bins), np.concatenate(real)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs: time << 32 | first bin << 16 | second bin << 4 | frames between."""
    bins, real = peaks(samples)
    codes = []
    for gap in range(1, min(REACH, len(bins) - 1) + 1):
        for i in range(PEAKS):
            j = (i + gap) % PEAKS if gap > FAN // 2 else i
            ok = np.flatnonzero(real[:-gap, i] & real[gap:, j])
            codes.append((ok.astype(np.int64) << 32) | (bins[ok, i].astype(np.int64) << 16) | (bins[ok + gap, j].astype(np.int64) << 4) | gap)
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def media_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: a table of the shared folder with the texts' UTF-8 as sounds."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col(doc_id), text_of(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "media")[0]


def fingerprints(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests and the peak pairs, as a table of the shared folder."""
    tune(media.sparkSession)
    kind = dict(media.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            rows = []
            for m in b.column(2):
                data = m.as_py()
                samples = from_wav(data)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), fingerprint(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peaks"])

    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peaks array<long>"), "fingerprints")[0]


def features(media: DataFrame) -> DataFrame:
    """The fingerprints with a feature: the number of pairs and the digest of the stored array."""
    pairs = F.array_join(F.transform("peaks", lambda x: x.cast("string")), ",")
    return fingerprints(media).withColumn("feature", F.concat_ws(":", F.size("peaks").cast("string"), F.sha2(pairs.cast("binary"), 256)))


def offsets(query: np.ndarray, other: np.ndarray) -> dict[int, int]:
    """How many pairs two arrays share, by the time between them: a peak of this count is a match."""
    where: dict[int, list[int]] = {}
    for x in other.tolist():
        where.setdefault(x & 0xFFFFFFFF, []).append(x >> 32)
    out: dict[int, int] = {}
    for x in query.tolist():
        for t in where.get(x & 0xFFFFFFFF, ()):
            out[t - (x >> 32)] = out.get(t - (x >> 32), 0) + 1
    return out
