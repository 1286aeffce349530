"""Audio columns: 8-bit PCM WAV storage, polyphase resampling, overlapped log-mel frames, hysteresis segments.

Null texts are empty; an empty text is one block of padding. Equal bytes give equal values: every clip is computed on its
own, in fixed chunks, so neither batch nor partition changes a result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

BLOCK = 576
RATE_IN, UP, DOWN = 12_000, 2, 3
RATE = RATE_IN * UP // DOWN
TAPS = 12
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 16
CHUNK_FRAMES = 4096
HIGH_DB, LOW_DB = 1.5, 0.5


def pad_payload(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of BLOCK."""
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def wav_write(payload: bytes, rate: int = RATE_IN) -> bytes:
    """Mono unsigned 8-bit PCM in a RIFF container."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_read(media: bytes) -> tuple[int, bytes]:
    """(rate, sample bytes); raises ValueError on anything but what wav_write makes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def filter_bank(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass split into ``up`` phases of ``taps`` coefficients, each phase with unit gain at 0 Hz."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    phases = h.reshape(taps, up).T
    return (phases / phases.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, bank: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: each output phase is one strided product, no zero is ever multiplied."""
    taps = bank.shape[1]
    n_out = len(x) * up // down
    y = np.empty(n_out, np.float32)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for p in range(up):
        count = len(range(p, n_out, up))
        base, phase = divmod(p * down, up)
        y[p::up] = windows[base::down][:count] @ bank[phase][::-1]
    return y


def mel_matrix(rate: int = RATE, n_fft: int = FRAME, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    lo, mid, hi = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T.astype(np.float32)


class Analyser:
    """Log-mel frames and segments of one clip; holds the constant tables."""

    def __init__(self) -> None:
        self.bank, self.mel = filter_bank(), mel_matrix()
        self.window = np.hanning(FRAME).astype(np.float32)

    def log_mel(self, samples: bytes) -> Iterator[np.ndarray]:
        """Chunks of (frames, MELS), CHUNK_FRAMES frames at most; memory doesn't grow with the clip beyond its bytes."""
        u8 = np.frombuffer(samples, np.uint8)
        step = CHUNK_FRAMES * HOP
        total = len(u8) * UP // DOWN
        lead = TAPS * DOWN  # left context; a multiple of DOWN keeps the phases in step
        for start in range(0, max(total, 1), step):
            lo = start * DOWN // UP
            back = min(lead, lo)
            hi = min(len(u8), (start + step + FRAME) * DOWN // UP + DOWN)
            x = (u8[lo - back : hi].astype(np.float32) - 128) / 128
            y = resample(x, self.bank)[back * UP // DOWN :]
            count = max(1, -(-(min(step, total - start)) // HOP))
            need = (count - 1) * HOP + FRAME
            y = np.concatenate([y, np.zeros(max(0, need - len(y)), np.float32)])[:need]
            frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * self.window
            spectrum = np.fft.rfft(frames, axis=1)
            power = spectrum.real**2 + spectrum.imag**2
            yield np.log10(power.astype(np.float32) @ self.mel + 1e-6)

    @staticmethod
    def segments(energy: np.ndarray, high_db: float = HIGH_DB, low_db: float = LOW_DB) -> np.ndarray:
        """Hysteresis: a segment opens above the clip's median + high_db and closes below median + low_db."""
        db = 10 * energy
        mid = np.median(db)
        event = np.where(db > mid + high_db, 1, np.where(db < mid + low_db, -1, 0))
        last = np.maximum.accumulate(np.where(event != 0, np.arange(len(db)), -1))
        on = (last >= 0) & (event[np.maximum(last, 0)] == 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        return edge.reshape(-1, 2)

    def clip(self, samples: bytes) -> tuple[str, np.ndarray, np.ndarray, int]:
        """Feature string, segments (n, 2) and log-mel frames in blocks (n, TENSOR_FRAMES, MELS), the last one padded with silence,
        and the number of frames; spans in frames."""
        total, square, parts = np.zeros(MELS), np.zeros(MELS), []
        for m in self.log_mel(samples):
            total += m.sum(0, dtype=np.float64)
            square += np.square(m, dtype=np.float64).sum(0)
            parts.append(m)
        mel = np.concatenate(parts)
        n = len(mel)
        mean = total / n
        sd = np.sqrt(np.maximum(square / n - mean**2, 0))
        seg = self.segments(mel.mean(1))
        active = (seg[:, 1] - seg[:, 0]).sum() * HOP / RATE if len(seg) else 0.0
        blocks = np.full((-(-n // TENSOR_FRAMES), TENSOR_FRAMES, MELS), np.float32(-6))
        blocks.reshape(-1, MELS)[:n] = mel
        feature = f"frames={n};segments={len(seg)};active_s={active:.3f};mel=" + ",".join(f"{x:.2f}" for x in mean) + ";sd=" + ",".join(f"{x:.2f}" for x in sd)
        return feature, seg, blocks, n


DIGESTS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
SPAN = "start_s: double, end_s: double"
CLIP = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    f"segments array<struct<{SPAN}>>, tensors array<struct<{SPAN}, tensor: array<float>>>"
)
HELD_VALUES = 4_000_000  # tensor values in one Arrow batch, at least


def _lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of ``counts`` structs."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _seconds(frames: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0), *frames]) * HOP / RATE, pa.float64())


def clips(df: DataFrame) -> DataFrame:
    """One row per document: the stored clip's digests and feature, its segments, and its log-mel frames as tensors of the fixed
    shape (TENSOR_FRAMES, MELS), row by row in ``tensor``, each with its time span. ``as_tensor_array`` gives the Arrow type."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, digests, segments, blocks, sizes = zip(*rows)
        flat = np.concatenate([b.ravel() for b in blocks])
        per = [np.arange(len(b)) * TENSOR_FRAMES for b in blocks]
        tensor = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TENSOR_FRAMES * MELS), pa.int32()), pa.array(flat))
        columns = [pa.array(ids, pa.int64())] + [pa.array(c, t) for c, t in zip(zip(*digests), DIGESTS.values())]
        columns.append(_lists([len(x) for x in segments], {"start_s": _seconds([x[:, 0] for x in segments]), "end_s": _seconds([x[:, 1] for x in segments])}))
        stop = [np.minimum(x + TENSOR_FRAMES, n) for x, n in zip(per, sizes)]
        columns.append(_lists([len(b) for b in blocks], {"start_s": _seconds(per), "end_s": _seconds(stop), "tensor": tensor}))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *DIGESTS, "segments", "tensors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, rows, held = Analyser(), [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode()
                media = wav_write(pad_payload(raw))
                _, back = wav_read(media)
                feature, segments, blocks, n = a.clip(back)
                digests = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append((doc_id, digests, segments, blocks, n))
                held += blocks.size
                if held >= HELD_VALUES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return texts(df).mapInArrow(run, CLIP)


def as_tensor_array(column: pa.ChunkedArray | pa.Array) -> pa.FixedShapeTensorArray:
    """A collected column of tensor values as a fixed-shape Arrow tensor array."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, TENSOR_FRAMES * MELS))
