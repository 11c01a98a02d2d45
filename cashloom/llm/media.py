"""Operator 6: media columns. Bytes stored as WAV by the wave module, and spectral-peak fingerprints.

The samples are read back from the stored file, cut into overlapping frames and put through a short-time
Fourier transform. In each of four bands the strongest bin of a frame is a peak if no frame near it has
a stronger one in that band. Each peak is paired with the next few: a pair's code holds both bins and the
frames between them, and its time code is the frame of the first. The feature columns are the two
parallel arrays.
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
from pyspark.sql import functions as F

from .common import documents, pieces, whole_text

UNIT = 192
FRAME, HOP = 2 * UNIT, UNIT
RATE = 8_000
BANDS = (2, 24, 56, 104, 193)
NEAR = 2
PARTNERS = 3
MOST_APART = 63
#: Frames that are transformed at once: bounds a worker's memory for texts of any length.
BLOCK_FRAMES = 8_192


def to_wav(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAV file."""
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


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


_window = np.hanning(FRAME).astype(np.float32)


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength and bin of the strongest bin of each frame and band; a last frame is filled with silence."""
    n = len(samples) // HOP
    strength = np.empty((n, len(BANDS) - 1), np.float32)
    bins = np.empty((n, len(BANDS) - 1), np.int64)
    for at in range(0, n, BLOCK_FRAMES):
        upto = min(n, at + BLOCK_FRAMES)
        part = samples[at * HOP : (upto - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (upto - at - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _window
        spectrum = np.abs(np.fft.rfft(frames, axis=1))
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            band = spectrum[:, low:high]
            best = band.argmax(axis=1)
            bins[at:upto, b] = best + low
            strength[at:upto, b] = band[np.arange(upto - at), best]
    return strength, bins


def pair_codes(strength: np.ndarray, bins: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and frame of each pair of peaks; frames of different owners never meet."""
    is_peak = strength > 1e-3
    for d in range(1, NEAR + 1):
        same = (owner[d:] == owner[:-d])[:, None]
        is_peak[d:] &= ~same | (strength[d:] > strength[:-d])
        is_peak[:-d] &= ~same | (strength[:-d] >= strength[d:])
    frame, band = np.nonzero(is_peak)
    f, o = bins[frame, band], owner[frame]
    found = []
    for j in range(1, PARTNERS + 1):
        apart = frame[j:] - frame[:-j]
        ok = (o[j:] == o[:-j]) & (apart <= MOST_APART)
        code = (f[:-j] * 256 + f[j:]) * 64 + apart
        found.append((o[:-j][ok], code[ok], frame[:-j][ok], np.full(ok.sum(), j)))
    who, code, time, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, code, time, who))
    return who[order], code[order], time[order]


def store_documents(docs: DataFrame) -> DataFrame:
    """Each whole text of ``docs`` (doc_id, text; other columns are ignored) as a WAV file.

    Returns doc_id, n_bytes (of the text in UTF-8) and media binary, one row per row. A null text counts
    as empty; the samples are the text's bytes and spaces up to a positive multiple of UNIT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data = batch.column("data").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("data"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and fingerprints of stored WAV files (doc_id, n_bytes, media).

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codes
    array<bigint> and times array<int>, all computed from what is read back. Equal files, equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            media = batch.column("media").to_pylist()
            payloads = [from_wav(m) for m in media]
            peaks = [band_peaks(np.frombuffer(p, np.uint8)) for p in payloads]
            owner = np.repeat(np.arange(len(peaks)), [len(s) for s, _ in peaks])
            first = np.cumsum([0, *(len(s) for s, _ in peaks)])[:-1]
            if len(owner):
                who, code, time = pair_codes(np.concatenate([s for s, _ in peaks]), np.concatenate([b for _, b in peaks]), owner)
                time = time - first[who]
            else:
                who = code = time = np.zeros(0, np.int64)
            ends = pa.array(np.searchsorted(who, np.arange(len(media) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(code.astype(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(time.astype(np.int32))),
                ],
                names,
            )

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codes", "times"]
    kinds = ["bigint", "bigint", "bigint", "string", "bigint", "bigint", "string", "array<bigint>", "array<int>"]
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media_features(store_documents(documents(spark, sf_dir)))
    line = F.concat_ws(";", F.array_join(F.col("codes").cast("array<string>"), ","), F.array_join(F.col("times").cast("array<string>"), ","))
    return got.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat(F.size("codes").cast("string"), F.lit(":"), F.sha2(line, 256)).alias("feature"), "codes", "times",
    )
