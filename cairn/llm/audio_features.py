"""Media columns: texts as 8-bit mono WAV sound, and features of stored sound.

Features are computed from the stored bytes: polyphase resampling, log-mel energies of overlapping
frames, and segments by energy with hysteresis. Mel frames are stored in fixed-shape tensors of
TENSOR_FRAMES by MELS with the time span that each covers; the last one of a sound is padded. A sound is resampled
and transformed in portions of frames, so besides its bytes and tensors no more than a portion is held.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import balanced

#: Samples per second of what is stored, and the resampling ratio before the features.
RATE, UP, DOWN = 24_000, 2, 3
#: Bytes of a payload are a multiple of this: 8 ms.
UNIT = 192
#: Samples of a frame and between frames after resampling (25 and 10 ms at 16 kHz), of the transform, and mel bands.
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: Frames in a tensor, and frames worked on at once.
TENSOR_FRAMES, PORTION = 64, 4096
#: A segment begins at this many dB over the quietest tenth of frames and ends below the second figure.
OPEN_DB, CLOSE_DB = 3.0, 1.5
TENSOR_SHAPE = (TENSOR_FRAMES, MELS)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, then spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def to_wav(data: bytes) -> bytes:
    """A RIFF/WAVE file with one channel of unsigned 8-bit samples."""
    if len(data) >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GB")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(data), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(data)) + data


def from_wav(media: bytes) -> bytes:
    """The samples of such a file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, mono8 = 12, False
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            mono8 = (kind, channels, bits) == (1, 1, 8)
        elif name == b"data":
            if not mono8:
                raise ValueError("one channel of 8-bit samples is expected")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=1)
def _phases(taps: int = 16) -> np.ndarray:
    """The low-pass filter of the resampler, one row per phase: (UP, taps)."""
    n = np.arange(UP * taps) - (UP * taps - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * taps)
    h *= UP / h.sum()
    return h.reshape(taps, UP).T[:, ::-1].copy()


def length_of(n: int) -> int:
    """Samples of a sound of n samples after resampling."""
    return -(-n * UP // DOWN)


def resample(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Samples first to last - 1 at UP/DOWN times the rate of 8-bit `samples`; `first` is a multiple of UP.

    Each output sample is one phase of the filter over the input around it; silence surrounds the sound.
    """
    bank = _phases()
    taps = bank.shape[1]
    begin, need = first * DOWN // UP - taps // 2, -(-(last - first) * DOWN // UP) + taps + DOWN
    a, z = max(0, begin), max(0, min(len(samples), begin + need))
    x = np.zeros(need)
    x[a - begin : max(a, z) - begin] = (samples[a : max(a, z)].astype(np.float64) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, taps)
    out = np.empty(last - first)
    # Outputs m, m + UP, m + 2 UP, ... share a phase and advance by DOWN input samples.
    for k in range(min(UP, len(out))):
        at, phase = divmod(k * DOWN, UP)
        mine = out[k::UP]
        mine[:] = windows[at::DOWN][: len(mine)] @ bank[phase]
    return out


@lru_cache(maxsize=1)
def _mel_bank() -> np.ndarray:
    """Triangles on the mel scale: (FFT / 2 + 1, MELS)."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * rate / FFT
    up, down = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Portions of (frames, MELS) in dB of overlapping Hann-windowed frames of 8-bit `samples`; a short sound is padded to one frame."""
    size = length_of(len(samples))
    count = max(0, size - FRAME) // HOP + 1
    window, bank = np.hanning(FRAME), _mel_bank()
    for at in range(0, count, PORTION):
        n = min(PORTION, count - at)
        first, last = at * HOP, (at + n - 1) * HOP + FRAME
        x = resample(samples, first, min(last, size))
        x = np.concatenate([x, np.zeros(last - first - len(x))])
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window, FFT, axis=1)) ** 2
        yield 10 * np.log10(power @ bank + 1e-6)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that open at OPEN_DB above the floor and last until the energy falls below CLOSE_DB above it."""
    floor = np.partition(energy, len(energy) // 10)[len(energy) // 10]
    mark = np.where(energy >= floor + OPEN_DB, 1, np.where(energy < floor + CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] > 0), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All mel frames of a sound and its segments in frames.

    In double precision and rounded: products of the same sound may differ in their last bits from one worker
    to another, and what is stored must not.
    """
    mel = np.concatenate([np.round(part, 4).astype(np.float32) for part in log_mel(np.frombuffer(samples, np.uint8))])
    return mel, segments(np.round(mel.astype(np.float64).mean(axis=1), 6))


def span_ms(first: int, last: int) -> tuple[float, float]:
    """Milliseconds that frames first to last - 1 cover."""
    ms = 1000 * DOWN / (RATE * UP)
    return first * HOP * ms, ((last - 1) * HOP + FRAME) * ms


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, media (WAV bytes). Null text: as if empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, 1):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    kind = df.select(id_col).dtypes[0][1]
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


class Tensors(NamedTuple):
    """The tensors of one sound: mel (n, TENSOR_FRAMES, MELS), zero beyond the last frame; frames and time span (ms) of each;
    segments as spans of time (ms)."""

    mel: np.ndarray
    frames: list[int]
    spans: list[tuple[float, float]]
    segments: list[tuple[float, float]]

    def array(self) -> pa.ExtensionArray:
        """mel as Arrow's canonical fixed-shape tensors."""
        values = pa.FixedSizeListArray.from_arrays(pa.array(self.mel.ravel()), TENSOR_FRAMES * MELS)
        return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), TENSOR_SHAPE), values)


def tensors_of(media: bytes) -> Tensors:
    """The tensors of a stored sound."""
    mel, parts = features(from_wav(media))
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.zeros((n, TENSOR_FRAMES, MELS), np.float32)
    full.reshape(-1, MELS)[: len(mel)] = mel
    held = [min(TENSOR_FRAMES, len(mel) - TENSOR_FRAMES * t) for t in range(n)]
    return Tensors(full, held, [span_ms(TENSOR_FRAMES * t, TENSOR_FRAMES * t + held[t]) for t in range(n)], [span_ms(a, z) for a, z in parts])


def tensors(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows of stored sound -> one row per tensor: id, tensor (number), start_ms, end_ms, frames (unpadded), mel array<float>.

    mel is a tensor of TENSOR_SHAPE in row order, see as_tensor_table(). A null sound has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, media in enumerate(batch.column(1).to_pylist()):
                if media is None:
                    continue
                made = tensors_of(media)
                n = len(made.mel)
                offsets = np.arange(n + 1, dtype=np.int32) * (TENSOR_FRAMES * MELS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, k))), pa.array(range(n), pa.int32()), pa.array([s[0] for s in made.spans]), pa.array([s[1] for s in made.spans]), pa.array(made.frames, pa.int32()), pa.ListArray.from_arrays(offsets, made.mel.ravel())],
                    ["id", "tensor", "start_ms", "end_ms", "frames", "mel"],
                )

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(run, f"id {kind}, tensor int, start_ms double, end_ms double, frames int, mel array<float>")
    return out.withColumnRenamed("id", id_col)


def as_tensor_table(table: pa.Table) -> pa.Table:
    """The Arrow table of tensors() with mel as Arrow's canonical fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), TENSOR_SHAPE)
    flat = table.column("mel").combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    values = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), TENSOR_FRAMES * MELS)
    return table.set_column(table.column_names.index("mel"), pa.field("mel", kind), pa.ExtensionArray.from_storage(kind, values))


def summary(made: Tensors) -> str:
    """Frames, tensors, segments, the time that they cover, and a digest of tensors (in whole decibels), time spans and segments."""
    digest = hashlib.sha256(np.rint(made.array().to_numpy_ndarray()).astype(np.int8).tobytes())
    digest.update(np.array([*made.spans, *made.segments]).round(3).tobytes())
    active = sum(z - a for a, z in made.segments)
    return f"frames={sum(made.frames)};tensors={len(made.frames)};end_ms={made.spans[-1][1]:.1f};segments={len(made.segments)};active_ms={active:.1f};mel={digest.hexdigest()[:32]}"


def digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Rows of stored sound with n_bytes -> id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All is read from the stored bytes; feature is the summary() of their tensors. A null sound has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                if media is None:
                    rows.append((None,) * 6)
                    continue
                back = from_wav(media)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), summary(tensors_of(media))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.select(id_col).dtypes[0][1]
    out = df.select(df[id_col].alias("id"), "n_bytes", df[media_col].alias("media")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as sound by store(), and the digests() of what is stored.

    Null text: as if empty, 192 spaces. Equal texts have equal values; ids may be null or repeat; other columns are not read.
    """
    return digests(store(df, id_col, text_col), id_col)
