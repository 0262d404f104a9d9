"""Media columns: a payload stored as WAV samples, and spectral fingerprints of what is read back.

The payload's bytes are the 8-bit samples of a mono WAV file, which is lossless. The samples read back
are cut into overlapping frames, a short-time Fourier transform gives the strongest bin of each frame
and of its bands, and pairs of such peaks in one frame or near ones make time-coded fingerprints.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT, FILL, RATE = 576, b"\xff", 8000
#: Samples between frames; frames transformed at once (bounds memory for long payloads); frames ahead
#: of a peak that it is paired with.
HOP, BLOCK, REACH = 288, 2048, 3

#: First bins of the bands that give a peak each, and the end of the last.
BANDS = (1, 24, 72, 144, UNIT // 2 + 1)

_TAPER = np.hanning(UNIT)


def pad(body: bytes) -> bytes:
    """``body`` filled up to a positive multiple of UNIT."""
    whole = max(UNIT, -(-len(body) // UNIT) * UNIT)
    return body + FILL * (whole - len(body))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as sink:
        sink.setnchannels(1)
        sink.setsampwidth(1)
        sink.setframerate(RATE)
        sink.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as source:
        return source.readframes(source.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(strongest bin of each frame, strongest bin of each of its bands), 0 where a frame or band is flat.

    Magnitudes are rounded so that ties are stable.
    """
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    frames = np.lib.stride_tricks.sliding_window_view(x, UNIT)[::HOP]
    bands = np.zeros((len(frames), len(BANDS) - 1), np.int64)
    top = np.zeros(len(frames), np.int64)
    for start in range(0, len(frames), BLOCK):
        part = frames[start : start + BLOCK]
        spectrum = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _TAPER, axis=1)
        power = np.rint(spectrum.real**2 + spectrum.imag**2)
        place, height = np.arange(len(part)), np.zeros((len(part), len(BANDS) - 1))
        for i, (a, b) in enumerate(zip(BANDS[:-1], BANDS[1:], strict=True)):
            best = a + power[:, a:b].argmax(axis=1)
            height[:, i] = power[place, best]
            bands[start : start + len(part), i] = np.where(height[:, i] > 0, best, 0)
        top[start : start + len(part)] = bands[start + place, height.argmax(axis=1)]
    return top, bands


def pairs(top: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """frame << 20 | first bin << 11 | second bin << 2 | frames between; by frame, then the rest.

    A frame's strongest bin is paired with the peaks of its other bands and with the strongest bins of the
    next REACH frames.
    """
    frame = np.arange(len(top))
    found = [(frame, top, band, 0) for band in bands.T]
    found += [(frame[:-n], top[:-n], top[n:], n) for n in range(1, REACH + 1)]
    codes = []
    for at, first, second, between in found:
        real = (first > 0) & (second > 0) & ((first != second) | (between > 0))
        codes.append(at[real] << 20 | first[real] << 11 | second[real] << 2 | between)
    return np.sort(np.concatenate(codes))


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """doc_id, media (the WAV file), sizes and digests of payload and file, fingerprints, feature.

    A null text is an empty one: its payload is UNIT bytes of fill. Equal texts give equal values; repeated
    rows are kept; an empty table gives an empty result; other columns are not read. Narrow: no shuffle;
    a task holds one Arrow batch and one row's frames, BLOCK at a time.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprints", "media")}
            for body in batch.column("body"):
                body = body.as_py()
                stored = to_wav(pad(body))
                payload = from_wav(stored)
                codes = pairs(*peaks(payload))
                out["n_bytes"].append(len(body))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(f"pairs={len(codes)};md5={hashlib.md5(codes.astype('<i8').tobytes()).hexdigest()}")
                out["fingerprints"].append(codes)
                out["media"].append(stored if keep_media else None)
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "fingerprints": pa.list_(pa.int64()), "media": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out]
            )

        return apply

    rows = common.text_bytes(docs, id_col, text_col)
    schema = (
        f"{common.typed(rows, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string, fingerprints array<long>, media binary"
    )
    return common.map_batches(rows, make, schema)
