"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak fingerprints.

A payload (UTF-8 bytes of a text, zero bytes up to a positive multiple of BLOCK) becomes the samples of a mono 8-bit WAV,
written by the wave module and stored as a binary column in the shared folder. From the stored bytes, read back by the
wave module, come the samples again, a windowed Fourier transform of frames of FRAME samples every HOP, the strongest
PEAKS bins of each frame that exceed both neighbours, and for each peak its pairs with the peaks of the next SPAN frames.
A fingerprint is the array of (time, code) of all pairs, in order: code = first bin, second bin and distance packed. The
arrays are stored as two columns, `times` and `codes`, of the table of features.

All frames of a sound are used. A row is worked out alone, so memory is bounded by the longest text. Cases: null and
empty texts are one block of zeros, whose array is empty; repeated rows and equal texts get equal values; a null doc_id
is kept; ids are whole numbers; other columns are ignored.
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

from .common import slices, stash

BLOCK = 64
RATE = 8000
FRAME = 128
HOP = 64
PEAKS = 2
SPAN = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(raw: bytes) -> bytes:
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrogram(payload: bytes) -> np.ndarray:
    """Magnitudes: a row for each frame, a column for each frequency; the last frame is padded with silence."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128.0
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate(
        [x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]
    ) if (n - 1) * HOP + FRAME > len(x) else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: HOP][:n]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of all pairs of peaks."""
    m = spectrogram(payload)
    inner = m[:, 2:-1]  # without the constant part
    peak = (inner > m[:, 1:-2]) & (inner >= m[:, 3:]) & (inner > 1.0)
    height = np.where(peak, inner, 0.0)
    bins = np.argpartition(-height, PEAKS, axis=1)[:, :PEAKS]
    bins.sort(axis=1)
    real = np.take_along_axis(height, bins, axis=1) > 0
    times, codes = [], []
    for step in range(1, SPAN + 1):
        if len(bins) <= step:
            break
        for a in range(PEAKS):
            for b in range(PEAKS):
                both = np.flatnonzero(real[:-step, a] & real[step:, b])
                times.append(both)
                codes.append(((bins[both, a] + 2) << 16) | ((bins[both + step, b] + 2) << 8) | step)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): the WAVs of all rows, written to the shared folder and read back."""

    def run(batches):
        for b in slices(batches, 256):
            raw = [(x or "").encode("utf-8", "replace") for x in b.column(1).to_pylist()]
            media = pa.array([to_wav(payload_of(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stash(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


#: Columns of media_features.
FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, times array<int>, codes array<int>"


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests and time-coded fingerprints from the stored bytes (FIELDS)."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]

    def run(batches):
        for b in slices(batches, 256):
            rows, times, codes = [], [], []
            for m in b.column(2).to_pylist():
                p = from_wav(m)
                t, c = fingerprint(p)
                frames = max(1, -(-(len(p) - FRAME) // HOP) + 1)
                rows.append(
                    (
                        len(p),
                        hashlib.sha256(p).hexdigest(),
                        zlib.crc32(p[-BLOCK:]),
                        len(m),
                        hashlib.sha256(m).hexdigest(),
                        frames,
                    )
                )
                times.append(t)
                codes.append(c)
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in times])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (times, codes)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *made, *lists], [x.split()[0] for x in FIELDS.split(", ")]
            )

    return media.mapInArrow(run, FIELDS)


def store_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """FIELDS of all rows: the WAVs are stored and read back, and what comes from them is stored, arrays and all."""
    return stash(media_features(store_media(docs, id_col, text)), "fingerprints", compression="zstd")


def op9_wav_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents as WAVs; the feature is a digest of the frames, the number of pairs and the stored time-coded arrays."""
    rows = store_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2(F.concat_ws(",", F.col("times").cast("array<string>"), F.col("codes").cast("array<string>")), 256)
    feature = F.concat_ws(
        ":", F.col("frames").cast("string"), F.size("times").cast("string"), F.substring(digest, 1, 32)
    )
    return rows.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
