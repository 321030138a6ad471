"""Media columns: audio clips and their features (operator 3).

A clip is stored as an 8-bit mono WAV file in a binary column.  `features` reads the
stored file back and computes, for every clip:

* polyphase resampling by up/down: each output phase has its own branch of the
  low-pass filter, so no sample is computed that is thrown away;
* log-mel filterbanks over frames that overlap by half;
* segments of the frames' energy with hysteresis: a segment opens above a high mark
  and lasts until the energy falls below a low one;
* a fixed-shape tensor (`BINS` x `BANDS`, float32) of mean log-mel values over equal
  stretches of the clip, and the segments' time spans in seconds.

Spark has no tensor type, so the column `tensor` holds each clip's tensor as an Arrow
tensor message, which carries its own type, shape and dimension names, and lives in
Parquet as binary; `tensors` turns such a column into Arrow's fixed-shape tensor array.

Long clips are worked through in blocks of `BLOCK` frames, so memory holds a clip's
bytes and one block.  All arithmetic depends on the clip alone: equal clips have equal
features, whatever batch they are in.

Defined results: a null text is the empty payload, padded to 64 zero bytes like any
other; frames go on until the last one holds the last resampled sample that any byte
reaches, and are zero-padded beyond it, so a short clip has one frame.  A file that is
no 8-bit mono WAV raises ValueError.  Repeated rows give repeated rows; an empty table
gives an empty table.  Only id and text are looked at, so other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brookql.llm.exchange import stored
from brookql.llm.text import lean, utf8

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 24
FRAME, HOP, BANDS, BINS = 256, 128, 20, 16
BLOCK = 1024
ALIGN = 64


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file of the payload's bytes."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV file."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, 20)
    n = struct.unpack_from("<I", media, 40)[0]
    if (kind, channels, bits) != (1, 1, 8) or media[36:40] != b"data" or len(media) < 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44 : 44 + n], rate


def filter_branches(up: int, down: int, taps: int) -> np.ndarray:
    """[phase, tap]: a Hann-windowed sinc low-pass at the lower of both rates, split by output phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(cut * t) * cut * np.hanning(n + 2)[1:-1]
    return (h * up / h.sum()).reshape(taps, up).T


_BRANCHES = filter_branches(UP, DOWN, TAPS)


def resample(x: np.ndarray, first: int, n: int, up: int = UP, down: int = DOWN, branches: np.ndarray = _BRANCHES) -> np.ndarray:
    """Output samples first, ..., first + n - 1 of x resampled by up/down; x is zero beyond its ends."""
    taps = branches.shape[1]
    out = np.empty(n)
    for phase in range(up):
        # outputs o with (o * down) % up == phase share this branch
        o = np.arange(n) + first
        mine = np.flatnonzero((o * down) % up == phase)
        if not len(mine):
            continue
        at = o[mine] * down // up
        lo, hi = int(at[0]) - taps + 1, int(at[-1]) + 1
        part = np.zeros(hi - lo)
        a, b = max(lo, 0), min(hi, len(x))
        if a < b:
            part[a - lo : b - lo] = (x[a:b].astype(float) - 128) / 128
        step = int(at[1] - at[0]) if len(at) > 1 else 1
        rows = np.lib.stride_tricks.sliding_window_view(part, taps)[::step]
        out[mine] = rows @ branches[phase][::-1]
    return out


def n_frames(samples: int) -> int:
    """Frames over a clip, its resampled tail (where the filter still reaches the last samples) included."""
    n = -(-(samples + TAPS - 1) * UP // DOWN)
    return max(1, 1 - (FRAME - n) // HOP)


def mel_bank(rate: float, frame: int, bands: int) -> np.ndarray:
    """[frequency, band]: triangles evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


_BANK = mel_bank(RATE * UP / DOWN, FRAME, BANDS)
_WINDOW = np.hanning(FRAME + 1)[:-1]


def log_mel(x: np.ndarray):
    """(first frame, log-mel rows, log energies) a block of frames, over the whole clip."""
    frames = n_frames(len(x))
    for f in range(0, frames, BLOCK):
        k = min(BLOCK, frames - f)
        y = resample(x, f * HOP, (k - 1) * HOP + FRAME)
        rows = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(rows, axis=1)) ** 2
        yield f, np.log(power @ _BANK + 1e-6), np.log((rows**2).sum(axis=1) + 1e-6)


def segments(energy: np.ndarray) -> np.ndarray:
    """[start, end) frames whose energy stays above the low mark after passing the high one."""
    low, high = np.quantile(energy, [0.35, 0.65])
    sign = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    on = (last >= 0) & (sign[np.maximum(last, 0)] > 0)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1)


def clip_features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tensor [BINS, BANDS] float32, spans [n, 2] in seconds) of one clip."""
    x = np.frombuffer(samples, np.uint8)
    frames = n_frames(len(x))
    sums, sizes, energy = np.zeros((BINS, BANDS)), np.zeros(BINS), np.empty(frames)
    for f, mel, e in log_mel(x):
        where = (np.arange(f, f + len(e)) * BINS) // frames
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        sums[where[cut]] += np.add.reduceat(mel, cut, axis=0)
        sizes[where[cut]] += np.diff(np.append(cut, len(e)))
        energy[f : f + len(e)] = e
    tensor = (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)
    return tensor, segments(energy) * (HOP * DOWN / UP / RATE)


def _payloads(column):
    data, offsets = utf8(column)
    for a, b in zip(offsets[:-1], offsets[1:]):
        raw = data[a:b].tobytes()
        yield len(raw), raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


STORED = "n_bytes long, media binary"
FEATURES = "n_bytes long, media binary, tensor binary, spans array<struct<start:double,end:double>>"
SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
#: Clips handed to Spark at once.
CLIPS = 64


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text as a WAV file."""

    def run(batches):
        for batch in batches:
            size, media = [], []
            for i, (n, payload) in enumerate(_payloads(batch.column(text))):
                size.append(n)
                media.append(encode_wav(payload))
                if len(media) == CLIPS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(i + 1 - len(media), len(media)), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])
                    size, media = [], []

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` long, {STORED}")


def tensor_message(values: np.ndarray) -> bytes:
    """A [BINS, BANDS] float32 array as an Arrow tensor message."""
    sink = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(values, np.float32), dim_names=["time", "band"]), sink)
    return sink.getvalue().to_pybytes()


def read_tensor(message: bytes) -> np.ndarray:
    return pa.ipc.read_tensor(pa.BufferReader(message)).to_numpy()


def tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """A column of tensor messages as Arrow's fixed-shape tensor array."""
    values = [read_tensor(m.as_py()).ravel() for m in column]
    kind = pa.fixed_shape_tensor(pa.float32(), (BINS, BANDS), dim_names=["time", "band"])
    flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.float32))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, BINS * BANDS))


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """store()'s columns with each clip's tensor (an Arrow tensor message) and time spans."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, CLIPS):
                part = batch.slice(lo, CLIPS)
                found, spans = [], []
                for m in part.column("media"):
                    t, s = clip_features(decode_wav(m.as_py())[0])
                    found.append(tensor_message(t))
                    spans.append([{"start": float(a), "end": float(b)} for a, b in s])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, "n_bytes", "media")), pa.array(found, pa.binary()), pa.array(spans, SPANS)], names=[key, "n_bytes", "media", "tensor", "spans"])

    return media.mapInArrow(lean(run), f"`{key}` long, {FEATURES}")


def digest(featured: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row a clip of features(): sizes and hashes of the payload as read back, of the file, and of the features."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments"]

    def run(batches):
        for batch in batches:
            rows = []
            for media, tensor, spans in zip(batch.column("media"), batch.column("tensor"), batch.column("spans").to_pylist()):
                media = media.as_py()
                back, _ = decode_wav(media)
                seconds = np.array([(s["start"], s["end"]) for s in spans]).reshape(-1, 2)
                # rounded, so that the last bits of the arithmetic don't matter
                marks = np.round(read_tensor(tensor.as_py()).astype(float) * 64).astype("<i4").tobytes() + np.round(seconds * 1000).astype("<i4").tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(marks).hexdigest()[:32], len(spans)))
            columns = list(zip(*rows)) or [[]] * (len(names) - 2)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return featured.mapInArrow(lean(run), f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments long")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return digest(features(media))


QUERIES = {"op3_audio_features": op3_audio_features}
ORACLE_SQL: dict[str, str] = {}
