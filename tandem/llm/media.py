"""Media columns: lossless 8-bit audio and its features.

A payload of bytes is stored as unsigned 8-bit samples of a mono WAV file. The samples read back are brought to the
analysis rate by a polyphase filter; overlapped frames give log-mel energies, and their loudness is cut into segments with
hysteresis. Energies are stored as fixed-shape Arrow tensors, each with its time span.
"""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Payloads are filled up to a multiple of this with bytes 32.
UNIT = 192
RATE, UP, DOWN = 8000, 3, 4
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 32
OPEN_DB, CLOSE_DB = -1.0, -3.0


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), filled up to a positive multiple of UNIT."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def store(payload: bytes) -> bytes:
    """A mono WAV file with a byte per sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(payload), "NONE", None))
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


@functools.cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc filter for a change of rate by up / down, one row per phase."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(n / widest) * np.hamming(len(n)) / widest * up
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    return taps.reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: output i is one phase's taps against the inputs around i * down / up; as the filter is
    centred, the length is ceil(len(x) * up / down)."""
    phases = low_pass(up, down)
    length = phases.shape[1]
    centre = 8 * max(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(length), x, np.zeros(length)])
    out = np.empty(n)
    for p in range(up):
        # the outputs whose place in the raised rate leaves rest p
        at = np.array([i for i in range(up) if (i * down + centre) % up == p])
        for first in at:
            index = np.arange(first, n, up)
            if not len(index):
                continue
            newest = (index * down + centre) // up
            windows = np.lib.stride_tricks.sliding_window_view(padded, length)
            step = down
            start = int(newest[0]) + 1
            out[index] = windows[start : start + step * len(index) : step][: len(index)] @ phases[p][::-1]
    return out


@functools.cache
def mel_bank(rate: float, bins: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.linspace(0, rate / 2, bins)
    rise = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@functools.cache
def _hann(n: int) -> np.ndarray:
    return np.hanning(n)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies of overlapped frames, and the frames' loudness in dB. Signals are padded with zeros to one frame, or
    to the next full hop, so that the last frame covers the last sample."""
    x = np.concatenate([x, np.zeros(FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    power = np.empty((len(frames), FRAME // 2 + 1))
    for at in range(0, len(frames), 1024):  # bounded memory for very long signals
        spectrum = np.fft.rfft(frames[at : at + 1024] * _hann(FRAME))
        power[at : at + 1024] = spectrum.real**2 + spectrum.imag**2
    mel = np.log(power @ mel_bank(rate, FRAME // 2 + 1, MELS) + 1e-6)
    return mel.astype(np.float32), 10 * np.log10(power.sum(axis=1) + 1e-9)


def segments(loud: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """Frame spans [start, end): a span opens at loudness >= median + open_db and ends before the first one under median +
    close_db."""
    level = float(np.median(loud))
    state = np.where(loud >= level + open_db, 1, np.where(loud < level + close_db, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


TENSOR = pa.schema([("mel", pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensors(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of tensors [FRAMES, MELS] with their time spans; the last one is filled up with zeros."""
    n = max(1, -(-len(mel) // FRAMES))
    full = np.zeros((n * FRAMES, MELS), dtype=np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * FRAMES * HOP / rate
    end = (np.minimum((np.arange(n) + 1) * FRAMES, len(mel)) - 1) * HOP / rate + FRAME / rate
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, MELS))
    out = io.BytesIO()
    with pa.ipc.new_stream(out, TENSOR) as w:
        w.write_batch(pa.RecordBatch.from_arrays([column, pa.array(start), pa.array(end)], schema=TENSOR))
    return out.getvalue()


def features(payload: bytes) -> tuple[bytes, list[dict]]:
    """The tensors, and the loud segments in seconds."""
    x = resample((np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128) / 128)
    rate = RATE * UP / DOWN
    mel, loud = log_mel(x - x.mean(), rate)
    spans = [{"start_s": a * HOP / rate, "end_s": ((b - 1) * HOP + FRAME) / rate} for a, b in segments(loud)]
    return tensors(mel, rate), spans


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), payload (read back from it), tensors (Arrow stream) and segments.

    Null and empty texts give a payload of UNIT spaces. Every text is worked on by itself, so that equal texts give equal
    values. Repeated rows give repeated rows; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t.as_py() for t in part.column(1)]
                sizes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
                media = [store(payload_of(t)) for t in texts]
                payloads = [read_back(m) for m in media]
                made = [features(p) for p in payloads]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], SPANS)],
                    ["doc_id", "n_bytes", "media", "payload", "tensors", "segments"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, tensors binary, segments array<struct<start_s double, end_s double>>")
