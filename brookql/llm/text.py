"""Vectorised text primitives shared by the corpus operators.

Everything here works on the raw UTF-8 buffers of Arrow string columns with
numpy, a chunk of a few megabytes at a time, so that a Python worker's memory is
bounded by the chunk (or by the longest single text) and not by the batch.

Null texts count as empty.  Hashes are 64-bit; they are the same on every worker
and in every process, because all constants come from a fixed generator.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; the numpy temporaries are about 60 times this.
CHUNK_BYTES = 1 << 18


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # no glibc
    _trim = None


def release() -> None:
    """Give freed memory back to the system: idle Python workers are kept, and would hold it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(f):
    """f, a function for mapInArrow or applyInArrow, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            try:
                yield from f(batches)
            finally:
                release()

        return run

    @functools.wraps(f)
    def call(*tables):
        try:
            return f(*tables)
        finally:
            release()

    # Spark looks at the signature to tell how a function wants its group
    call.__signature__ = inspect.signature(f)
    return call


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = _splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BASE = 0xD1342543DE82EF95
_BASE_INV = pow(BASE, -1, 1 << 64)
STEP = 0xA0761D6478BD642F


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + (1 << 17))
            a = np.full(n, BASE, dtype=U64)
            a[0] = 1
            b = np.full(n, _BASE_INV, dtype=U64)
            b[0] = 1
            self.up, self.down = np.cumprod(a), np.cumprod(b)
        return self.up, self.down


_powers = _Powers()


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    is_word = np.ones(256, dtype=bool)
    for lo, hi in separators:
        is_word[lo : hi + 1] = False
    return is_word


#: Words of everything but ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ASCII letters (lower-cased), digits and all non-ASCII bytes.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 8192):
    """Row ranges (lo, hi) of at most `rows` rows and `limit` bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] = sum of code(data[i]) * BASE**i for i < j."""
    up, _ = _powers.get(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


#: Words of more bytes than this are hashed one at a time.
LONG_WORD = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word data[start:end]: eight bytes a step, mixed in between; long words by BLAKE2.

    No sum of powers: such sums collide for regular words (Thue-Morse) whatever the base.
    """
    size = end - start
    out = _splitmix(size.astype(U64) * U64(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = size[live] - at
        lane = lanes[start[live] + at] & _TAIL[np.minimum(left, 8)]
        out[live] = _splitmix((out[live] ^ lane) * U64(STEP))
        live, at = live[left > 8], at + 8
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(view[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of some rows: byte bounds, row bounds and hashes.

    data, offsets: the rows' bytes; start, end: byte bounds of each word; rows:
    rows[r]:rows[r+1] are the words of row r; hash: 64 bits a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> None:
        self.data, self.offsets = data, offsets
        folded = LOWER[data] if lower else data
        inside = is_word[folded]
        n = len(data)
        first = inside.copy()
        last = inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < n)]
            first[edges] = inside[edges]
            last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.start, offsets)
        self.hash = word_hash(folded, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words (indices) and hashes of all windows of `size` words within a row."""
        h = sequence_hash(self.hash, size)
        at = np.arange(len(h))
        if len(h):
            at = at[at + size <= np.repeat(self.rows[1:], np.diff(self.rows))[: len(h)]]
        return at, h[at]

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and row offsets of the kept words, joined by one space."""
        start, length = self.start, self.end - self.start
        rows = self.rows
        if keep is not None:
            start, length = start[keep], length[keep]
            rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        ends = np.cumsum(length + 1)
        begins = ends - length - 1
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(start - begins, length + 1)
        out = self.data[np.minimum(source, max(len(self.data) - 1, 0))] if total else np.zeros(0, np.uint8)
        out[ends - 1] = 0x20
        bounds = np.concatenate([[0], ends])[rows]
        return out, bounds

    def joined_sha256(self, keep: np.ndarray | None = None) -> list[str]:
        out, bounds = self.joined(keep)
        view = memoryview(out)
        return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]


def sequence_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` neighbours, by doubling: O(log size) passes."""
    done, width = None, 0
    power, unit = word_hash, 1
    mult = STEP
    left = size
    while left:
        if left & 1:
            if done is None:
                done, width = power, unit
            else:  # `done` stands before `power`
                m = len(word_hash) - width - unit + 1
                if m <= 0:
                    return np.zeros(0, U64)
                done = done[:m] * U64(mult) + power[width : width + m]
                width += unit
        left >>= 1
        if left:
            m = len(power) - unit
            if m <= 0:
                return np.zeros(0, U64)
            power = power[:m] * U64(mult) + power[unit : unit + m]
            unit *= 2
            mult = mult * mult % (1 << 64)
    return _splitmix(done + U64(size))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which beats np.unique's hash table here."""
    values = np.sort(values)
    if len(values):
        first = np.empty(len(values), bool)
        first[0] = True
        np.not_equal(values[1:], values[:-1], out=first[1:])
        values = values[first]
    return values


def words_of(column, is_word: np.ndarray, lower: bool, limit: int = CHUNK_BYTES):
    """(lo, hi, Words) for consecutive row ranges of a string column."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets, limit):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, Words(data[a:b], offsets[lo : hi + 1] - a, is_word, lower)


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of `length` places lie in any [start, end)."""
    step = np.zeros(length + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def row_sums(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of flags over each rows[r]:rows[r+1]."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def row_runs(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of maximal runs of set flags within each row."""
    first = flags.copy()
    if len(flags):
        first[1:] &= ~flags[:-1]
        edges = rows[1:-1]
        edges = edges[edges < len(flags)]
        first[edges] = flags[edges]
    return row_sums(first, rows)
