"""Media columns: texts as 8-bit WAV files, short-time spectra and pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import rows_of

RATE, BLOCK = 8000, 64
FRAME, HOP, NEAR, FAN, REACH = 128, 64, 1, 3, 32
BATCH_BYTES, CHUNK_FRAMES = 16 << 20, 4096


def to_wav(data: bytes) -> bytes:
    """A WAV file of unsigned 8-bit samples: the bytes, then bytes 0 up to a positive multiple of BLOCK."""
    padded = data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))
    out = io.BytesIO()
    with wave.open(out, "wb") as to:
        to.setnchannels(1)
        to.setsampwidth(1)
        to.setframerate(RATE)
        to.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(sample rate, samples) of a WAV file as the wave module reads it."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.getframerate(), file.readframes(file.getnframes())


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame of the first peak, code) of each pair of spectral peaks, by time.

    Frames of FRAME samples under a Hann window are Fourier transformed. The strongest bin of a frame is a peak if
    no frame within NEAR has a stronger one (the first of equals). Each peak is paired with the next FAN peaks within
    REACH frames; a code holds both bins (8 bits each) and the frames between them.
    """
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.concatenate([x, np.full(FRAME - len(x), 128, np.uint8)])
    n = 1 + (len(x) - FRAME) // HOP
    window = np.hanning(FRAME).astype(np.float32)
    bins, power = np.empty(n, np.int64), np.empty(n, np.float32)
    for at in range(0, n, CHUNK_FRAMES):
        to = min(n, at + CHUNK_FRAMES)
        frames = np.lib.stride_tricks.sliding_window_view(x[at * HOP : (to - 1) * HOP + FRAME], FRAME)[::HOP].astype(np.float32) - 128
        spectrum = np.abs(np.fft.rfft(frames * window, axis=1))[:, 1:]
        bins[at:to] = spectrum.argmax(1)
        power[at:to] = spectrum[np.arange(to - at), bins[at:to]]
    around = np.pad(power, NEAR, constant_values=-1)
    before = np.max([around[k : k + n] for k in range(NEAR)], axis=0)
    after = np.max([around[NEAR + k : NEAR + k + n] for k in range(1, NEAR + 1)], axis=0)
    peaks = np.flatnonzero((power > before) & (power >= after))
    times, codes = [], []
    for k in range(1, FAN + 1):
        a, b = peaks[:-k], peaks[k:]
        near = b - a <= REACH
        times.append(a[near])
        codes.append((bins[a] << 16 | bins[b] << 8 | (b - a))[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def _written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent(ids, sizes, media):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    for rows in rows_of(batches):
        ids, sizes, media, held = [], [], [], 0
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            data = (text or "").encode("utf-8", "surrogatepass")
            ids.append(doc_id)
            sizes.append(len(data))
            media.append(to_wav(data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield sent(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield sent(ids, sizes, media)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "rate", "times", "codes"]
    for batch in batches:
        out = {n: [] for n in names}
        for doc_id, n_bytes, media in zip(*(batch.column(i) for i in range(3))):
            data = media.as_py()
            rate, samples = from_wav(data)
            times, codes = peak_pairs(samples)
            row = (doc_id.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), rate, times, codes)
            for name, value in zip(names, row):
                out[name].append(value)
        if out["doc_id"]:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)


def wav_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every document row: its UTF-8 text as a WAV file; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_written, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the WAV files of (doc_id, n_bytes, media) back: sizes, digests, sample rate, and peak pairs as the arrays times and codes.

    One row per row; equal files give equal values. Files are read one at a time, so a task holds one batch.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, rate int, times array<long>, codes array<long>")


def op5_rows(docs: DataFrame) -> DataFrame:
    found = media_features(wav_column(docs))
    pairs = F.concat_ws(";", F.array_join(F.col("times").cast("array<string>"), ","), F.array_join(F.col("codes").cast("array<string>"), ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.size("times").cast("string"), F.lit(":"), F.md5(pairs)).alias("feature"), "times", "codes")
