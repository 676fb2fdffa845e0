"""Media columns: texts as 8-bit WAV, short-time spectra of it, and peak-pair fingerprints.

A text's bytes, padded with zeros to a positive multiple of 64, are the samples of a mono WAV file that
the wave module writes and reads. Overlapping Hann windows are transformed, each frame's strongest bin
in each of four bands is a peak if it stands out in its band over the frames beside it, and each peak is
paired with the next few peaks. A pair's hash has both bins and the frames between; the hashes and
the frames at which they begin are two arrays side by side.

Rows: a null or empty text is 64 zero bytes, which have no peaks. Equal texts have equal values. Spectra
are computed piece by piece, so a very long text takes memory for its bytes and its peaks only.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_only

UNIT, RATE = 64, 8000
FRAME, HOP, FRAMES_AT_ONCE = 256, 128, 2048
BANDS = (2, 12, 28, 60, 128)
FAN_OUT, FARTHEST = 3, 63


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((1, 1, RATE, len(samples), "NONE", "not compressed"))
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth(), file.getframerate()) != (1, 1, RATE):
            raise ValueError("not an 8-bit mono file of this rate")
        return file.readframes(file.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its magnitude, by frame and band."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    bins = np.empty((frames, len(BANDS) - 1), np.int16)
    size = np.empty((frames, len(BANDS) - 1), np.float32)
    for k in range(0, frames, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, frames - k)
        part = x[k * HOP : (k + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window)
        power = spectrum.real**2 + spectrum.imag**2
        for b in range(len(BANDS) - 1):
            own = power[:, BANDS[b] : BANDS[b + 1]]
            at = own.argmax(1)
            bins[k : k + n, b] = at + BANDS[b]
            size[k : k + n, b] = own[np.arange(n), at]
    return bins, size


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of peak pairs, the frames at which they begin, and the number of peaks."""
    bins, size = band_peaks(samples)
    edge = np.full((1, size.shape[1]), -1, np.float32)
    peak = (size > np.vstack([edge, size[:-1]])) & (size >= np.vstack([size[1:], edge])) & (size > 1)
    time, band = np.nonzero(peak)
    freq = bins[time, band].astype(np.int32)
    hashes, begins = [], []
    for ahead in range(1, FAN_OUT + 1):
        gap = time[ahead:] - time[:-ahead]
        near = gap <= FARTHEST
        hashes.append((freq[:-ahead] << 13 | freq[ahead:] << 6 | gap)[near])
        begins.append(time[:-ahead][near])
    hashes, begins = np.concatenate(hashes), np.concatenate(begins)
    order = np.lexsort((hashes, begins))
    return hashes[order].astype(np.int32), begins[order].astype(np.int32), len(time)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and media, the WAV file."""

    def make():
        def work(keys, texts):
            return {"doc_id": keys, "n_bytes": [len(t.encode()) for t in texts], "media": [to_wav(payload(t)) for t in texts]}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """doc_id and n_bytes of a table (doc_id, n_bytes, media), digests of the file and its samples, the
    number of peaks, and the time-coded arrays: hashes of peak pairs and the frames at which they begin."""

    def make():
        def one(file: bytes) -> tuple:
            samples = from_wav(file)
            hashes, begins, peaks = fingerprint(samples)
            return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), peaks, hashes, begins

        def work(keys, files):
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peaks", "hashes", "frames")
            return {"key": keys} | dict(zip(names, zip(*map(one, files), strict=True), strict=True))

        return work

    own = media.selectExpr("struct(doc_id, n_bytes) as key", "media")
    schema = (
        "key struct<doc_id: long, n_bytes: long>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, peaks int, hashes array<int>, frames array<int>"
    )
    return map_texts(own, make, schema, column="media").select("key.*", *[c.split()[0] for c in schema.split(", ")[2:]])


def features(prints: DataFrame) -> DataFrame:
    """The table with ``feature`` in place of peaks and arrays: peaks:pairs:crc32, by which equal arrays have
    equal features."""
    pairs = F.crc32(F.concat(F.array_join("hashes", ","), F.lit(";"), F.array_join("frames", ",")))
    feature = F.concat_ws(":", "peaks", F.size("hashes"), F.lower(F.lpad(F.hex(pairs), 8, "0")))
    return prints.withColumn("feature", feature).drop("peaks", "hashes", "frames")
