"""Media columns: bytes as 8-bit sound, and features of it as fixed-shape tensors.

A payload is stored as an 8-bit mono PCM WAVE file, which keeps every byte. Its features come
from the stored samples: polyphase resampling by a ratio of small numbers, log energies of an
overlapped mel filterbank, and segments by hysteresis, a segment starting where the energy
passes an upper threshold and lasting until it falls below a lower one. Log-mel frames are cut
into tensors of one shape, padded at the end; a sound's tensors are a fixed-shape Arrow tensor column with
their time spans, stored as an Arrow stream. Long sounds are worked on in slices of frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import texts

#: Samples a second; resampling up and down; taps of the low-pass filter for each phase; samples of a
#: frame and of a hop; mel bands; frames of a tensor; segments open above and close below these many
#: decibels over the mean.
RATE, UP, DOWN, TAPS, FRAME, HOP, BANDS, SHAPE_FRAMES, OPEN_DB, CLOSE_DB = 8000, 3, 4, 16, 256, 128, 24, 16, 1.0, -0.5
#: Frames that are worked on at once.
SLICE = 2048


def payload(text: bytes, unit: int = 64) -> bytes:
    """The bytes, and zeros up to a positive multiple of ``unit``."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def encode_wave(data: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of 8-bit mono samples."""
    pad = b"\0" * (len(data) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(data) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(data)) + data + pad


def decode_wave(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono WAVE file; other files are an error."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A Hann-windowed sinc low-pass filter, a row for each of the ``up`` phases."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resampled(n: int, up: int = UP, down: int = DOWN) -> int:
    """Samples that ``n`` of them become."""
    return -(-n * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, first: int = 0, after: int | None = None) -> np.ndarray:
    """Polyphase resampling by up / down: output samples ``first`` to ``after``. Each takes the one phase of the
    filter that its place between the input samples needs; zeros lie before and after the input."""
    phases = _phases(up, down, taps)
    after = resampled(len(x), up, down) if after is None else after
    out = np.empty(max(0, after - first), np.float32)
    low = first * down // up - taps // 2  # of the inputs that are seen
    high = max(0, after - 1) * down // up + taps
    wide = np.zeros(max(0, high - low), np.float32)
    own = x[max(0, low) : max(0, high)]
    wide[max(0, -low) : max(0, -low) + len(own)] = own
    for k in range(min(up, len(out))):  # outputs k, k + up, ... share a phase, and their inputs are evenly spaced
        at = (first + k) * down
        start = at // up - taps // 2 - low
        n = len(range(k, len(out), up))
        seen = np.lib.stride_tricks.as_strided(wide[start:], (n, taps), (down * wide.itemsize, wide.itemsize), writeable=False)
        out[k::up] = seen @ phases[at % up]
    return out


@cache
def _mel(frame: int, bands: int, rate: float) -> np.ndarray:
    """Overlapped triangles, evenly spaced in mel: (frequency bins, bands)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, fall = (f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, fall)).astype(np.float32)


def n_frames(samples: int, frame: int = FRAME, hop: int = HOP) -> int:
    return max(1, 1 + -(-(samples - frame) // hop))


def log_mel(part: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bands) log10 mel energies and each frame's energy in decibels; the last frame is
    padded with zeros."""
    n = n_frames(len(part), frame, hop)
    padded = np.zeros((n - 1) * hop + frame, np.float32)
    padded[: len(part)] = part[: len(padded)]
    seen = np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop] * np.hanning(frame).astype(np.float32)
    spectrum = np.fft.rfft(seen, axis=1)
    energy = spectrum.real**2 + spectrum.imag**2
    mels = np.log10(energy.astype(np.float32) @ _mel(frame, bands, rate) + 1e-6)
    return mels.astype(np.float32), (10 * np.log10((seen * seen).mean(axis=1) + 1e-9)).astype(np.float32)


def segments(power: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frames [first, after) of the segments: from where the level passes ``open_db`` over the mean
    until it falls below ``close_db`` over it."""
    level = power - power.mean()
    state = np.where(level >= open_db, 1, np.where(level < close_db, -1, 0))
    firm = np.where(state != 0, np.arange(1, len(state) + 1), 0)
    last = np.maximum.accumulate(firm)  # the latest frame that decided
    on = (last > 0) & (state[np.maximum(last - 1, 0)] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel frames, their level and the seconds of a hop, of 8-bit samples, a slice of frames at a time."""
    raw = np.frombuffer(samples, np.uint8)
    total, own_rate = resampled(len(raw)), rate * UP / DOWN
    frames = n_frames(total)
    found = []
    for i in range(0, frames, SLICE):
        first, after = i * HOP, min(total, (min(frames, i + SLICE) - 1) * HOP + FRAME)
        low, high = max(0, first * DOWN // UP - TAPS) // DOWN * DOWN, after * DOWN // UP + 2 * TAPS
        x = (raw[low:high].astype(np.float32) - 128) / 128
        shift = low // DOWN * UP  # outputs before the slice's first input
        found.append(log_mel(resample(x, first=first - shift, after=after - shift), own_rate))
    mels, power = (np.concatenate(v) for v in zip(*found, strict=True))
    return mels, power, HOP / own_rate


TENSOR = pa.fixed_shape_tensor(pa.float32(), (SHAPE_FRAMES, BANDS))
_TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("values", TENSOR)])


def tensors(mels: np.ndarray, hop_s: float) -> pa.RecordBatch:
    """Tensors of (SHAPE_FRAMES, BANDS) with their time spans and the number of frames that are no padding."""
    n = -(-len(mels) // SHAPE_FRAMES)
    full = np.zeros((n * SHAPE_FRAMES, BANDS), np.float32)
    full[: len(mels)] = mels
    first = np.arange(n) * SHAPE_FRAMES
    after = np.minimum(first + SHAPE_FRAMES, len(mels))
    values = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), SHAPE_FRAMES * BANDS))
    return pa.RecordBatch.from_arrays([pa.array(first * hop_s), pa.array(after * hop_s), pa.array(after - first, pa.int32()), values], schema=_TENSORS)


def store_tensors(batch: pa.RecordBatch) -> bytes:
    """The tensors as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_next_batch()


def frames_of(stored: pa.RecordBatch) -> np.ndarray:
    """The log-mel frames, without padding, of stored tensors."""
    flat = stored.column("values").storage.flatten().to_numpy().reshape(-1, BANDS)
    kept = np.arange(SHAPE_FRAMES)[None, :] < stored.column("frames").to_numpy()[:, None]
    return flat[kept.ravel()]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            data = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([encode_wave(payload(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media binary)``: each whole text's UTF-8 bytes, padded with zeros to a
    positive multiple of 64, as a WAVE file of 8-bit samples. Null texts are empty; a row per input
    row, null ids and repeated rows too; an empty table gives no rows. Other columns are not
    read."""
    return texts(docs, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, segments array<struct<start_s: double, end_s: double>>, feature string, tensors binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), spans, pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "segments", "feature", "tensors"]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for media in part.column(2).to_pylist():
                samples, rate = decode_wave(media)
                mels, power, hop_s = features(samples, rate)
                found = segments(power)
                stored = store_tensors(tensors(mels, hop_s))
                mels = frames_of(read_tensors(stored))  # what is described is what was stored
                digest = hashlib.md5(np.round(mels * 64).astype("<i2").tobytes()).hexdigest()
                mean = ",".join(f"{x:.2f}" for x in mels.mean(axis=0, dtype=np.float64))
                text = f"frames={len(mels)};segments={len(found)};voiced={sum(b - a for a, b in found)};mel={mean};digest={digest}"
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(mels), [{"start_s": a * hop_s, "end_s": b * hop_s} for a, b in found], text, stored))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def describe(media: DataFrame) -> DataFrame:
    """Read stored sounds ``(doc_id, n_bytes, media)`` back: what was stored, the time spans of the
    segments, the log-mel ``tensors`` (an Arrow stream of ``start_s, end_s, frames`` and fixed-shape tensors), and a text of
    the features (frames, segments, mean log-mel bands, a digest of all frames in steps of 1/64)."""
    return media.mapInArrow(_describe, _FEATURES)


def _tensor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = read_tensors(stored)
            n = found.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()), *found.columns[:3], found.column("values").storage.cast(pa.list_(pa.float32()))], ["doc_id", "part", "start_s", "end_s", "frames", "values"])


def tensor_rows(described: DataFrame) -> DataFrame:
    """``(doc_id, part int, start_s, end_s, frames int, values array<float>)``: stored tensors, a row each, in row
    order; every array has the same length."""
    return described.select("doc_id", "tensors").mapInArrow(_tensor_rows, "doc_id long, part int, start_s double, end_s double, frames int, values array<float>")
