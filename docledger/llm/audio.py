"""Audio columns: lossless 8-bit samples in WAV form, and features of fixed shape.

``store`` puts a payload of bytes into a WAV file (one channel, unsigned 8-bit samples at
``SOURCE_RATE``), ``samples_of`` reads the samples back, byte for byte. ``features_of`` then

1. resamples to ``RATE`` (3/4 of the source rate) with a polyphase low-pass filter: each of the
   3 phases has its own taps, and no sample is computed that is not kept;
2. takes log-mel energies of frames of ``FRAME`` samples, one every ``HOP`` (they overlap by half);
3. finds active segments by energy with hysteresis: a segment opens at a frame above the upper
   threshold and goes on until one falls below the lower; thresholds stand at fixed shares
   between the quietest and the loudest frame;
4. pools the frames of each of ``TIMES`` equal time spans into a ``TIMES`` x ``MELS`` tensor.

All steps work in blocks of frames with the samples around them, so memory is bounded
whatever the length. Sums are quantised to 1/8 dB, away from rounding noise.

``tensor_table`` gives the tensors as Arrow's fixed-shape tensor type with their time spans.

Nulls and blanks: a null text is an empty one; its payload is 64 zero bytes. Signals shorter than
a frame are padded with silence to one frame. A constant signal has no segment. Equal payloads
give equal results. Repeated rows are kept; a null ``doc_id`` passes through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    FloatType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .common import small_batches

SOURCE_RATE = 16_000
UP, DOWN = 3, 4
RATE = SOURCE_RATE * UP // DOWN
FRAME, HOP = 512, 256
MELS, TIMES = 16, 8
#: A segment opens above the upper share of the energy range and closes below the lower.
OPENS, CLOSES = 0.6, 0.4
_TAPS = 24  # of each phase
_BLOCK = 1024  # frames looked at together
_ALIGN = 64


def _low_pass() -> np.ndarray:
    """Windowed sinc at the tighter of the two band limits, as (phase, tap)."""
    n = UP * _TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return h.reshape(_TAPS, UP).T.copy()


def _mel_bank() -> np.ndarray:
    """(bins, mels): triangles evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / RATE)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_PHASES, _BANK, _WINDOW = _low_pass(), _mel_bank(), np.hanning(FRAME)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(-(-len(raw) // _ALIGN), 1) * _ALIGN - len(raw)), len(raw)


def store(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload's bytes."""
    pad = b"\0" if len(payload) % 2 else b""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SOURCE_RATE, SOURCE_RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resampled(signal: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Output samples [begin, end) of the resampled signal; silence lies around the signal."""
    first, last = begin // UP, -(-end // UP)
    # output 3m + p is phase p over the inputs up to floor((3m + p) * 4 / 3)
    offsets = [(p * DOWN) // UP for p in range(UP)]
    phase = [(p * DOWN) % UP for p in range(UP)]
    low, high = first * DOWN - _TAPS + 1, (last - 1) * DOWN + max(offsets) + 1
    part = np.zeros(high - low)
    a, b = max(low, 0), min(high, len(signal))
    if b > a:
        part[a - low : b - low] = signal[a:b]
    view = np.lib.stride_tricks.sliding_window_view(part, _TAPS)
    out = np.empty((last - first, UP))
    for p in range(UP):
        out[:, p] = view[offsets[p] :: DOWN][: last - first] @ _PHASES[phase[p]][::-1]
    return out.reshape(-1)[begin - first * UP : end - first * UP]


def frame_energies(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log-mel energies in dB, and (frames) energies in dB."""
    signal = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    n = -(-len(signal) * UP // DOWN)
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    mel, energy = np.empty((frames, MELS)), np.empty(frames)
    for at in range(0, frames, _BLOCK):
        stop = min(at + _BLOCK, frames)
        part = resampled(signal, at * HOP, (stop - 1) * HOP + FRAME)
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(view * _WINDOW, axis=1)) ** 2
        mel[at:stop] = 10 * np.log10(power @ _BANK + 1e-6)
        energy[at:stop] = 10 * np.log10((view**2).mean(axis=1) + 1e-9)
    return _quantised(mel), _quantised(energy)


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.round(x * 8) / 8


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[first frame, frame after) of the active segments."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1:
        return []
    opens, closes = energy > low + OPENS * (high - low), energy >= low + CLOSES * (high - low)
    # a run of frames that stay above the lower threshold counts from its first opening frame
    edge = np.flatnonzero(np.diff(np.concatenate([[0], closes.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    starts = np.flatnonzero(opens)
    at = np.searchsorted(starts, runs[:, 0])
    found = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < runs[:, 1])
    return [(int(starts[i]), int(e)) for i, e in zip(at[found], runs[found, 1])]


def features_of(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """(tensor, its time spans, active segments): times in seconds."""
    mel, energy = frame_energies(samples)
    bounds = np.linspace(0, len(mel), TIMES + 1)
    low = np.minimum(bounds[:-1].astype(int), len(mel) - 1)
    high = np.maximum(np.ceil(bounds[1:]).astype(int), low + 1)
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0)])
    tensor = _quantised((sums[high] - sums[low]) / (high - low)[:, None]).astype(np.float32)
    seconds = lambda a, b: (a * HOP / RATE, ((b - 1) * HOP + FRAME) / RATE)
    return tensor, [seconds(a, b) for a, b in zip(low.tolist(), high.tolist())], [seconds(a, b) for a, b in segments(energy)]


_MEDIA = StructType([StructField("media", BinaryType()), StructField("n_bytes", LongType())])
_FLOATS = ArrayType(FloatType())
_READ = StructType(
    [
        StructField("payload_bytes", LongType()),
        StructField("payload_sha256", StringType()),
        StructField("tail_crc32", LongType()),
        StructField("media_bytes", LongType()),
        StructField("media_sha256", StringType()),
        StructField("feature", StringType()),
        StructField("tensor", _FLOATS),
        StructField("span_start", _FLOATS),
        StructField("span_end", _FLOATS),
        StructField("segment_start", _FLOATS),
        StructField("segment_end", _FLOATS),
    ]
)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media`` (the stored WAV file) and ``n_bytes`` (of the text); columns of those names go."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in _MEDIA.names]

    @F.pandas_udf(_MEDIA)
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = [payload_of(t) for t in texts]
        return pd.DataFrame({"media": [store(p) for p, _ in rows], "n_bytes": [n for _, n in rows]})

    return small_batches(docs).withColumn("__m", stored(F.col(text))).select(*kept, "__m.media", "__m.n_bytes")


def with_features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with what its stored files hold: digests of the samples and the file, the feature
    tensor (row by row, ``TIMES`` x ``MELS``) with its time spans, and the active segments.
    ``feature`` is the tensor in halves of a dB above -60 dB, two hexadecimal digits each. Columns named like
    these go."""
    kept = [F.col(f"`{c}`") for c in media.columns if c not in _READ.names]

    @F.pandas_udf(_READ)
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for m in files:
            m = bytes(m)
            samples = samples_of(m)
            tensor, spans, active = features_of(samples)
            code = np.clip((tensor + 60) * 2, 0, 255).astype(np.uint8)
            pair = lambda xs: tuple([float(x[i]) for x in xs] for i in (0, 1))
            rows.append((
                len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-_ALIGN:]), len(m),
                hashlib.sha256(m).hexdigest(), code.tobytes().hex(), tensor.reshape(-1), *pair(spans), *pair(active),
            ))
        return pd.DataFrame(rows, columns=_READ.names)

    return small_batches(media).withColumn("__f", read(F.col(column))).select(*kept, "__f.*")


def tensor_table(rows: pa.Table, tensor: str = "tensor") -> pa.Table:
    """An Arrow table of ``with_features`` rows with the tensors in Arrow's fixed-shape type."""
    flat = rows[tensor].combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (TIMES, MELS))
    values = flat.flatten().cast(pa.float32())
    held = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, TIMES * MELS))
    return rows.set_column(rows.column_names.index(tensor), tensor, held)
