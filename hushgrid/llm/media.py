"""Media columns: audio stored as WAV bytes, with log-mel features in fixed-shape Arrow tensors.

Storing is lossless: the payload's bytes are the 8-bit samples of a mono WAV. Features come from the stored
bytes: polyphase resampling by 3/4, log-mel filterbanks over overlapped frames, and energy segments between two
thresholds (hysteresis). The features of a recording are an Arrow stream of windows: a fixed-shape tensor of
frames x bands, and the window's time span. They are a stored column too, from which digests are read back.

Values are computed in double precision and stored as half floats on a grid of 1/32, so that the last bits of a
product, which differ between processors, change no stored value.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 16_000
UP, DOWN, TAPS = 3, 4, 8
FRAME, HOP, BANDS = 256, 128, 24
#: Frames of one tensor, and steps of a stored value.
WINDOW, GRID = 32, 32
UNIT = 192


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces appended up to a positive multiple of 192, and the number before."""
    data = (text or "").encode("utf-8")
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(size, b" "), len(data)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV of 8-bit samples, padded to an even length as the format asks."""
    pad = b"\0" * (len(samples) & 1)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + len(pad)) + head + samples + pad


def from_wav(media: bytes) -> bytes:
    """The samples of such a WAV: walks the chunks to ``data``."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("WAV without samples")


@lru_cache(maxsize=1)
def phases() -> list[np.ndarray]:
    """Windowed-sinc low-pass, one set of taps for each phase."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) / DOWN * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return [np.ascontiguousarray(h[p::UP][::-1]) for p in range(UP)]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN: each output sample meets the taps of its phase alone."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(DOWN)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(-(-n // UP) * UP)
    for r in range(UP):  # output r, r + UP, ...: input place and phase step together
        place, phase = divmod(r * DOWN, UP)
        got = windows[place::DOWN] @ phases()[phase]
        k = len(out) // UP
        out[r::UP] = got[:k] if len(got) >= k else np.pad(got, (0, k - len(got)))
    return out[:n]


@lru_cache(maxsize=1)
def filterbank() -> np.ndarray:
    """Triangular mel filters over the bins of a frame."""
    rate = RATE * UP // DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (bins[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    down = (points[2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.clip(np.minimum(up, down), 0, None)


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x bands, on the grid of stored values; a signal shorter than a frame is padded with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((n, BANDS), dtype=np.float16)
    window = np.hanning(FRAME)
    for k in range(0, n, 1024):
        spectrum = np.fft.rfft(frames[k : k + 1024] * window)
        power = spectrum.real**2 + spectrum.imag**2
        out[k : k + 1024] = np.round(np.log(power @ filterbank() + 1e-6) * GRID) / GRID
    return out


def segments(mel: np.ndarray, high: float = 0.5, low: float = 0.0) -> list[tuple[float, float]]:
    """Time spans that begin above mean + high and last until below mean + low (in deviations of frame energy)."""
    energy = mel.astype(np.float64).mean(axis=1)  # sums of grid values are exact
    spread = float(energy.std())
    if spread < 1e-6:
        return []
    z = (energy - energy.mean()) / spread
    set_ = np.where(z > high, 1, np.where(z < low, 0, -1))
    last = np.maximum.accumulate(np.where(set_ >= 0, np.arange(len(z)), -1))
    on = np.where(last >= 0, set_[np.maximum(last, 0)], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    step = HOP / (RATE * UP // DOWN)
    return [(a * step, b * step) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


TENSOR = pa.fixed_shape_tensor(pa.float16(), [WINDOW, BANDS])


def analyse(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """Arrow stream of (tensor, start_s, end_s, frames), and the energy segments."""
    x = (np.frombuffer(from_wav(media), dtype=np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x))
    n = -(-len(mel) // WINDOW)
    padded = np.zeros((n * WINDOW, BANDS), dtype=np.float16)
    padded[: len(mel)] = mel
    step = HOP / (RATE * UP // DOWN)
    first = np.arange(n) * WINDOW
    frames = np.minimum(WINDOW, len(mel) - first)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), WINDOW * BANDS)
    batch = pa.record_batch([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(first * step), pa.array((first + frames) * step), pa.array(frames.astype(np.int32))], names=["tensor", "start_s", "end_s", "frames"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), segments(mel)


def feature(tensors: bytes, spans: list[tuple[float, float]]) -> str:
    """A short text of the stored features: shape, frames, mean, spans, and a digest of the tensor values."""
    with pa.ipc.open_stream(tensors) as stream:
        batch = stream.read_all().combine_chunks().to_batches()[0]
    values = batch.column("tensor").storage.values.to_numpy()
    frames = int(sum(batch.column("frames").to_pylist()))
    mean = float(values[: frames * BANDS].mean(dtype=np.float64))
    digest = hashlib.sha256(values.astype("<f2").tobytes()).hexdigest()[:16]
    covered = sum(b - a for a, b in spans)
    return f"logmel {batch.num_rows}x{WINDOW}x{BANDS} frames={frames} mean={mean:.4f} segments={len(spans)} active_s={covered:.4f} sha256={digest}"


def media_column(text: Column) -> Column:
    """struct(n_bytes, media): the stored form of a text."""

    @F.arrow_udf("n_bytes bigint, media binary")
    def run(texts: pa.Array) -> pa.Array:
        return common.by_parts(one)(texts)

    def one(part: pa.Array) -> pa.Array:
        made = [payload(t) for t in part.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for _, n in made], type=pa.int64()), pa.array([to_wav(p) for p, _ in made], type=pa.binary())], names=["n_bytes", "media"])

    return run(text)


def store(docs: DataFrame, path: str) -> str:
    """Write doc_id, n_bytes, media (WAV) as Parquet; null texts count as empty, all rows are kept."""
    made = docs.select("doc_id", media_column(F.col("text")).alias("m")).select("doc_id", "m.n_bytes", "m.media")
    made.write.option("compression", "zstd").parquet(path)
    return path


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def audio_features(media: Column) -> Column:
    """struct(tensors, segments) of a stored media column: an Arrow stream of fixed-shape tensors with time spans, and the energy segments; nulls for null."""

    @F.arrow_udf("tensors binary, segments array<struct<start_s:double,end_s:double>>")
    def run(stored: pa.Array) -> pa.Array:
        return common.by_parts(one, 128)(stored)

    def one(part: pa.Array) -> pa.Array:
        got = [(None, None) if m is None else analyse(m) for m in part.to_pylist()]
        spans = pa.array([None if s is None else [{"start_s": a, "end_s": b} for a, b in s] for _, s in got], type=SPANS)
        return pa.StructArray.from_arrays([pa.array([t for t, _ in got], type=pa.binary()), spans], names=["tensors", "segments"])

    return run(media)


def media_digests(media: Column) -> Column:
    """struct of the digests of a stored media column and of the payload in it; nulls for null."""

    @F.arrow_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string")
    def run(stored: pa.Array) -> pa.Array:
        return common.by_parts(one)(stored)

    def one(part: pa.Array) -> pa.Array:
        rows = []
        for m in part.to_pylist():
            data = None if m is None else from_wav(m)
            rows.append((None,) * 5 if m is None else (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest()))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
        return pa.StructArray.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    return run(media)


def store_features(media: DataFrame, path: str) -> str:
    """Write doc_id, n_bytes, the digests of the media, tensors and segments of stored media (doc_id, n_bytes, media) as Parquet."""
    digests, features = media_digests(F.col("media")), audio_features(F.col("media"))
    made = media.select("doc_id", "n_bytes", digests.alias("d"), features.alias("f")).select("doc_id", "n_bytes", "d.*", "f.*")
    made.write.option("compression", "zstd").parquet(path)
    return path


def feature_text(tensors: Column, segments: Column) -> Column:
    """The short text of stored features; null for null."""

    @F.arrow_udf("string")
    def run(stored: pa.Array, spans: pa.Array) -> pa.Array:
        return common.by_parts(one)(stored, spans)

    def one(stored: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else feature(t, [(x["start_s"], x["end_s"]) for x in s]) for t, s in zip(stored.to_pylist(), spans.to_pylist())], type=pa.string())

    return run(tensors, segments)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    media = spark.read.parquet(store(docs, common.scratch(spark, "media")))
    featured = spark.read.parquet(store_features(media, common.scratch(spark, "features")))
    return featured.withColumn("feature", feature_text(F.col("tensors"), F.col("segments"))).drop("tensors", "segments")
