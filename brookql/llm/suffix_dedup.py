"""Suffix-array deduplication of repeated byte strings (operator 2).

Every byte covered by a string of `length` bytes that also starts earlier is removed.
The suffixes that can matter are sorted by a distributed, common-prefix-aware merge
sort:

1. Anchors.  Of the seeds (strings of `seed` bytes) inside each window of `length`
   bytes, the one of least hash is the window's anchor; equal windows have equal
   anchors at equal places.  Consecutive windows mostly share their anchor, so there
   are few.  Blocks of documents learn from exchange.py which of their anchors occur
   more than once; no other window can repeat.
2. Runs.  Each block sorts the suffixes that start at its repeated anchors, cut where
   the last window that needs them ends, and front-codes them: a common-prefix length
   and the remaining bytes.  Runs go out by anchor hash, so that all suffixes with an
   anchor meet.  Suffixes that are equal within a block travel once.
3. Merge.  A loser tree merges the runs.  Every run's head carries the length of the
   prefix it shares with the suffix put out last; heads are compared by that length
   alone where it differs, and otherwise only from there on, so known prefixes are
   never compared again.  The merged order comes with its array of common prefixes.
4. Groups.  Suffixes with a common prefix of a whole seed form a group.  A window that
   starts j bytes before its anchor equals another just if the suffixes at both anchors
   share length - j bytes, which the array of common prefixes says, and the bytes
   before the anchors share j, which a second order of those bytes, read backwards,
   says with its own array.  Of equal windows all but the first in (document,
   position) order are repeats; runs of them, as intervals, go back to the documents'
   blocks.  No hash takes part in this decision.

An anchor with more than `HOT` occurrences (a line that a third of all documents share)
would make a group without bound.  Its windows take part by their own hashes instead:
each block announces its distinct ones, spread over all buckets, and learns which
occur in an earlier block (exchange.py).  Both ways give the same answer for a window.
Occurrences are counted exactly, so none escapes this.

Defined results: null texts are empty; a text shorter than a window loses nothing;
matches never cross documents.  Documents without an id come last; rows of equal id
count as documents in the order of their texts, and repeated rows as several documents.
An empty table gives an empty table.  Very long texts are looked at a piece at a time,
but a block holds its texts whole.  `remove_repeats` keeps other columns, whatever their
names.  Bytes are cut wherever windows say,
also within a character, so kept bytes need not be valid UTF-8; `remove_repeats`
drops the torn parts of a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from brookql.llm import exchange as ex
from brookql.llm.text import _powers, _splitmix, covered, lean, prefix_hash, row_runs, row_sums, utf8

U64 = np.uint64
LENGTH, SEED = 100, 32
CHUNK = 1 << 18
PLACE_BITS = 20
#: Suffixes searched for repeated windows at once; a single group may hold more.
BATCH = 8000
LAST = np.iinfo(np.int64).max
#: Occurrences beyond which an anchor's windows are looked up one by one.
HOT = 2000
#: What a blob holds.
RUN, CUTS, HASHES = 0, 1, 2
RUN_SCHEMA = "bucket int, part int, kind int, blob binary"
CUT_SCHEMA = "part int, kind int, blob binary"


def pieces(offsets: np.ndarray, length: int):
    """(first row, row bounds) of stretches to look at together: some whole rows, or a part of a long one.

    Parts of a long row overlap by length - 1 bytes, so each window lies in one part.
    """
    lo, n = 0, len(offsets) - 1
    while lo < n:
        if offsets[lo + 1] - offsets[lo] > CHUNK:
            for a in range(int(offsets[lo]), int(offsets[lo + 1]) - length + 1, CHUNK):
                yield lo, np.array([a, min(a + CHUNK + length - 1, offsets[lo + 1])])
            lo += 1
            continue
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1
        long = np.flatnonzero(np.diff(offsets[lo : hi + 1]) > CHUNK)
        hi = lo + int(long[0]) if len(long) else max(hi, lo + 1)
        yield lo, offsets[lo : hi + 1]
        lo = hi


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, seed: int):
    """For each anchor: its hash, place, and the first and last window starts that have it.

    Places count from bounds[0].
    """
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, U64), none, none, none
    p = prefix_hash(data)
    _, down = _powers.get(len(p))
    h = _splitmix((p[seed:] - p[:-seed]) * down[: len(p) - seed])
    least = (h >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(h), dtype=U64)
    span, width = length - seed + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    start = np.arange(len(least))
    ok = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - start >= length
    start = start[ok]
    place = (least[ok] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    if not len(start):
        return np.zeros(0, U64), none, none, none
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(start)) - 1
    # anchors are least hashes, so they crowd the low end; hashed again, they fill all buckets alike
    return _splitmix(h[place[first]] * U64(0x9FB21C651E98DF25)), place[first], start[first], start[last]


def _ordered(table: pa.Table, key: str, text: str) -> pa.Table:
    named = pa.table({"k": table.column(key).cast(pa.int64()).fill_null(LAST), "t": table.column(text).fill_null("")})
    return table.take(pc.sort_indices(named, sort_keys=[("k", "ascending"), ("t", "ascending")]))


def _announcer(text: str, length: int, seed: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table.column(text))
        found = [anchors(data, b, length, seed)[0] for _, b in pieces(offsets, length)]
        h, c = ex.distinct_counts(np.concatenate(found) if found else np.zeros(0, U64))
        return ex.announce(table.column("part")[0].as_py(), h, c, n)

    return run


def neighbours(mat: np.ndarray) -> np.ndarray:
    """How many bytes each row of mat, from the second on, shares with the one before."""
    differ = mat[1:] != mat[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), mat.shape[1])


def by_bytes(mat: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix."""
    return np.argsort(np.ascontiguousarray(mat).view(f"S{mat.shape[1]}").ravel(), kind="stable")


def encode_run(mat: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray, row: np.ndarray, place: np.ndarray) -> bytes:
    """A sorted run: front-coded suffixes, the bytes left of their anchors, and where they stand."""
    n, width = mat.shape
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = np.minimum(neighbours(mat), np.minimum(size[1:], size[:-1]))
    column = np.arange(width)
    tail = mat[(column >= lcp[:, None]) & (column < size[:, None])]
    return b"".join([np.array([n, len(tail)], "<u4").tobytes(), lcp.astype("<u2").tobytes(), size.astype("<u2").tobytes(), left_size.astype("<u2").tobytes(), row.astype("<u4").tobytes(), place.astype("<u8").tobytes(), tail.tobytes(), left.tobytes()])


def decode_run(blob: bytes):
    n, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    at = 8
    fields = []
    for kind in ("<u2", "<u2", "<u2", "<u4", "<u8"):
        fields.append(np.frombuffer(blob, kind, n, at))
        at += n * fields[-1].itemsize
    return (*fields, blob[at : at + m], blob[at + m :])


class Run:
    """Reads a front-coded run, one suffix at a time."""

    def __init__(self, lcp, size, tail: bytes) -> None:
        self.lcp, self.size, self.tail = lcp.tolist(), size.tolist(), tail
        self.at, self.end, self.offset, self.head = 0, len(lcp), 0, b""

    def next(self) -> tuple[bytes, int] | None:
        """The next suffix and the prefix it shares with the one before it in this run."""
        if self.at == self.end:
            return None
        shared, size = self.lcp[self.at], self.size[self.at]
        more = max(0, size - shared)
        self.head = self.head[: min(shared, size)] + self.tail[self.offset : self.offset + more]
        self.offset += more
        self.at += 1
        return self.head, shared


def common_prefix(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix of x and y, given that it is `at` at least."""
    if x == y:
        return len(x)
    n = min(len(x), len(y))
    step = 16
    while at < n and x[at : at + step] == y[at : at + step]:
        at += step
    at = min(at, n)
    while at < n and x[at] == y[at]:
        at += 1
    return at


def merge(runs: list[Run]):
    """Loser-tree merge: yields (run, its suffix number, prefix shared with the suffix put out before).

    A head's shared length is kept up to date against the last suffix put out.  Of two
    heads the one that shares more with it comes first; only equal lengths need bytes,
    and those from that length on.  The loser keeps the length it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    shared = [0] * k
    for r, run in enumerate(runs):
        got = run.next()
        heads[r] = got[0] if got else None
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        sa, sb = shared[a], shared[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        at = common_prefix(x, y, sa)
        if x[at:] <= y[at:]:
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield top, runs[top].at - 1, shared[top]
        got = runs[top].next()
        if got:
            heads[top], shared[top] = got
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, losers[node] = play(losers[node], top)
            node //= 2


def window_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
    """(start, hash) of the windows lo, ..., hi of each range, some ranges at a time."""
    for a in range(0, len(lo), 2048):
        first, size = lo[a : a + 2048], (hi - lo)[a : a + 2048] + length
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        p = prefix_hash(data[at])
        _, down = _powers.get(len(p))
        h = _splitmix((p[length:] - p[:-length]) * down[: len(p) - length])
        ok = np.arange(len(h)) + length <= np.repeat(ends, size)[: len(h)]
        yield at[: len(h)][ok], h[ok]


def intervals(start: np.ndarray, length: int, offsets: np.ndarray) -> np.ndarray:
    """(row, begin, end) of the runs of sorted window starts."""
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])])) if len(start) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    base = offsets[row[first]]
    return np.stack([row[first], start[first] - base, start[last] + length - base], axis=1).astype("<i8")


def _sorter(key: str, text: str, length: int, seed: int, n: int, hot: int):
    """A block's runs of repeated suffixes, its windows about hot anchors, and the cuts that are settled within it."""
    width = 2 * length - seed

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if docs.num_rows:
            part = docs.column("part")[0].as_py()
            data, offsets = utf8(_ordered(docs, key, text).column(text))
            found = []
            for _, b in pieces(offsets, length):
                h, place, lo, hi = anchors(data, b, length, seed)
                found.append((h, place + b[0], lo + b[0], hi + b[0]))
            h, place, lo, hi = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
            own, total = ex.distinct_counts(h)
            far, far_total = ex.answers(told, totals=True)
            hit, at = ex.member(far, own)
            total[at[hit]] = far_total[hit]
            total = total[np.searchsorted(own, h)]
            again, many = (total > 1) & (total <= hot), total > hot
            if many.any():
                out += _hot_windows(data, offsets, part, lo[many], hi[many], length, n)
            if again.any():
                out += _block_runs(data, offsets, part, h[again], place[again], lo[again], hi[again], length, width, n)
        b, p, k, x = zip(*out) if out else ((), (), (), ())
        return pa.table({"bucket": pa.array(b, pa.int32()), "part": pa.array(p, pa.int32()), "kind": pa.array(k, pa.int32()), "blob": pa.array(x, pa.binary())})

    return run


def _hot_windows(data, offsets, part, lo, hi, length, n):
    found = list(window_hashes(data, lo, hi, length))
    start, h = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([start, h])
    start, h = start[order], h[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    again = np.sort(start[~first])
    out = [(part % n, part, CUTS, intervals(again, length, offsets).tobytes())] if len(again) else []
    told = ex.announce(part, h[first], None, n)
    return out + [(b, part, HASHES, x) for b, x in zip(told.column("bucket").to_pylist(), told.column("blob").to_pylist())]


def _block_runs(data, offsets, part, h, place, lo, hi, length, width, n):
    end = hi + length
    # equal stretches about equal anchors travel once: the first stands for the rest
    same = np.zeros(len(h), U64)
    for a in range(0, len(h), 4096):
        b = min(a + 4096, len(h))
        size = end[a:b] - lo[a:b]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) + np.repeat(lo[a:b] - first[:-1], size)
        p = prefix_hash(data[at])
        _, down = _powers.get(len(p))
        same[a:b] = _splitmix((p[first[1:]] - p[first[:-1]]) * down[first[:-1]] + size.astype(U64) * U64(4096) + (place - lo)[a:b].astype(U64))
    order = np.argsort(same, kind="stable")
    fresh = np.empty(len(order), bool)
    fresh[order] = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    row = np.searchsorted(offsets, lo, side="right") - 1
    base = offsets[row]
    out = []
    if not fresh.all():
        gone = ~fresh
        blob = np.stack([row[gone], (lo - base)[gone], (end - base)[gone]], axis=1).astype("<i8").tobytes()
        out.append((part % n, part, CUTS, blob))
    h, place, lo, end, row, base = h[fresh], place[fresh], lo[fresh], end[fresh], row[fresh], base[fresh]
    bucket_order = np.argsort(h, kind="stable")
    cut = ex.split(h[bucket_order], n)
    column = np.arange(width)
    for bucket in np.flatnonzero(cut[1:] > cut[:-1]):
        mine = bucket_order[cut[bucket] : cut[bucket + 1]]
        size = end[mine] - place[mine]
        mat = np.where(column < size[:, None], data[np.minimum(place[mine][:, None] + column, len(data) - 1)], 0).astype(np.uint8)
        order = np.argsort(size, kind="stable")  # of padded rows that look alike, the shorter suffix comes first
        order = order[by_bytes(mat[order])]
        mine, mat, size = mine[order], mat[order], size[order]
        left_size = place[mine] - lo[mine]
        first = np.cumsum(left_size) - left_size
        left = data[np.arange(left_size.sum()) + np.repeat(lo[mine] - first, left_size)]
        out.append((int(bucket), part, RUN, encode_run(mat, size, left, left_size, row[mine], place[mine] - base[mine])))
    return out


def _merger(length: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        parts, kinds = table.column("part").to_pylist(), table.column("kind").to_pylist()
        blobs = [b.as_py() for b in table.column("blob")]
        answers: list[tuple[int, bytes]] = [(p, b) for p, k, b in zip(parts, kinds, blobs) if k == CUTS]
        hashes = table.filter(pc.equal(table.column("kind"), HASHES))
        later = ex.answer_later(hashes) if hashes.num_rows else None
        turn = sorted((i for i, k in enumerate(kinds) if k == RUN), key=lambda i: parts[i])
        runs, fields = [], []
        for i in turn:
            lcp, size, left_size, row, place, tail, left = decode_run(blobs[i])
            runs.append(Run(lcp, size, tail))
            fields.append((size, left_size, row, place, left))
        stock = Suffixes(fields, np.array([parts[i] for i in turn], np.int64))
        group: list[tuple[int, int]] = []
        batch: list[tuple[int, int]] = []
        for r, i, shared in merge(runs):
            if shared < seed:
                if len(group) > 1:
                    batch += group
                    if len(batch) > BATCH:
                        answers += stock.repeated(batch, length, seed)
                        batch = []
                group = []
            group.append((stock.first[r] + i, shared))
        if len(group) > 1:
            batch += group
        answers += stock.repeated(batch, length, seed)
        found = pa.table({"part": pa.array([p for p, _ in answers], pa.int32()), "kind": pa.array([CUTS] * len(answers), pa.int32()), "blob": pa.array([b for _, b in answers], pa.binary())})
        if later is not None:
            found = pa.concat_tables([found, later.add_column(1, "kind", pa.array([HASHES] * later.num_rows, pa.int32()))])
        return found

    return run


class Suffixes:
    """The suffixes of a bucket's runs, numbered run by run."""

    def __init__(self, fields: list, parts: np.ndarray) -> None:
        gather = lambda k: np.concatenate([f[k].astype(np.int64) for f in fields]) if fields else np.zeros(0, np.int64)
        self.size, self.left_size, self.row, self.place = (gather(k) for k in range(4))
        counts = [len(f[0]) for f in fields]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(int).tolist()
        self.part = np.repeat(parts, counts)
        self.left = np.frombuffer(b"".join(f[4] for f in fields) or b"\0", np.uint8)
        self.left_end = np.cumsum(self.left_size)

    def repeated(self, group: list[tuple[int, int]], length: int, seed: int) -> list[tuple[int, bytes]]:
        """Intervals of windows that occurred earlier, by part.

        group: numbers of suffixes in merged order, and the prefix each shares with the one before.
        """
        if not group:
            return []
        g, lcp = np.array(group, np.int64).T
        n, reach = len(g), length - seed
        size, left_size = self.size[g], self.left_size[g]
        column = np.arange(reach)
        back = np.where(column < left_size[:, None], self.left[np.maximum(self.left_end[g][:, None] - 1 - column, 0)], 0).astype(np.uint8)
        by = by_bytes(back)
        shared_left = np.zeros(n, np.int64)
        shared_left[1:] = neighbours(back[by])
        order = np.lexsort([self.place[g], self.row[g], self.part[g]])
        again = np.zeros((n, reach + 1), bool)
        left = np.empty(n, np.int64)
        for j in range(reach + 1):
            own = order[(left_size[order] >= j) & (size[order] >= length - j)]
            if len(own) < 2:
                continue
            left[by] = np.cumsum(shared_left < j)
            key = np.cumsum(lcp < length - j)[own] * (n + 1) + left[own]
            turn = np.argsort(key, kind="stable")
            key = key[turn]
            again[own[turn[1:][key[1:] == key[:-1]]], j] = True
        # window starts ascend as j descends
        steps = np.zeros((n, reach + 3), np.int8)
        steps[:, 1:-1] = again[:, ::-1]
        steps = np.diff(steps, axis=1)
        who, begin = np.nonzero(steps == 1)
        end = np.nonzero(steps == -1)[1]
        origin = self.place[g[who]] - reach
        found = np.stack([self.row[g[who]], origin + begin, origin + end - 1 + length], axis=1).astype("<i8")
        part = self.part[g[who]]
        by_part = np.argsort(part, kind="stable")
        part, found = part[by_part], found[by_part]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        return [(int(part[a]), found[a:b].tobytes()) for a, b in zip(edges, np.append(edges[1:], len(part)))]


def _cutter(key: str, text: str, length: int, emit):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return emit(docs, np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
        docs = _ordered(docs, key, text)
        data, offsets = utf8(docs.column(text))
        kinds = told.column("kind").to_pylist()
        blobs = [np.frombuffer(b.as_py(), "<i8").reshape(-1, 3) for k, b in zip(kinds, told.column("blob")) if k == CUTS]
        earlier = ex.answers(told.filter(pc.equal(told.column("kind"), HASHES)))
        if len(earlier):
            for _, b in pieces(offsets, length):
                enough = np.diff(b) >= length
                for start, h in window_hashes(data, b[:-1][enough], b[1:][enough] - length, length):
                    blobs.append(intervals(start[ex.member(h, earlier)[0]], length, offsets))
        cut = np.concatenate(blobs) if blobs else np.zeros((0, 3), np.int64)
        base = offsets[cut[:, 0]]
        return emit(docs, data, offsets, covered(len(data), base + cut[:, 1], base + cut[:, 2]))

    return run


def _digest(key: str):
    def emit(docs, data, offsets, gone) -> pa.Table:
        kept = data[~gone].tobytes()
        lost = row_sums(gone, offsets)
        size = np.diff(offsets)
        ends = np.cumsum(size - lost)
        return pa.table({
            key: docs.column(key).cast(pa.int64()),
            "n_bytes": pa.array(size, pa.int64()),
            "n_removed": pa.array(lost, pa.int64()),
            "n_spans": pa.array(row_runs(gone, offsets), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept[b - a : b]).hexdigest() for a, b in zip(size - lost, ends)], pa.string()),
        })

    return emit


def _cleaned(text: str):
    def emit(docs, data, offsets, gone) -> pa.Table:
        lost = row_sums(gone, offsets)
        texts = docs.column(text).to_pylist()
        for r in np.flatnonzero(lost):
            a, b = offsets[r], offsets[r + 1]
            texts[r] = data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")
        at = docs.schema.get_field_index(text)
        return docs.set_column(at, text, pa.array(texts, pa.string())).drop_columns(["part"])

    return emit


def _removed(docs: DataFrame, key: str, text: str, columns: list[str], length: int, seed: int, emit, ddl: str, hot: int = HOT) -> DataFrame:
    n = ex.block_count(docs.sparkSession)
    dealt = ex.grouped(ex.blocks(docs, key, n, columns, text), n)
    spoken = dealt.groupBy("part").applyInArrow(lean(_announcer(text, length, seed, n)), ex.BLOB_SCHEMA)
    told = spoken.groupBy("bucket").applyInArrow(lean(ex.answer_totals), ex.ANSWER_SCHEMA)
    # a block may send a bucket two kinds of blobs, so there are fewer buckets than in the first exchange
    runs = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lean(_sorter(key, text, length, seed, max(1, n // ex.BLOCKS_PER_PARTITION), hot)), RUN_SCHEMA)
    cuts = runs.groupBy("bucket").applyInArrow(lean(_merger(length, seed)), CUT_SCHEMA)
    return dealt.groupBy("part").cogroup(cuts.groupBy("part")).applyInArrow(lean(_cutter(key, text, length, emit)), ddl)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """A row a document: n_bytes, n_removed, n_spans, kept_sha256."""
    ddl = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _removed(docs, key, text, [text], length, seed, _digest(key), ddl, hot)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with repeated bytes removed from the text; other columns stay."""
    safe, back = ex.without(docs, "part")
    rest = [c for c in safe.columns if c != key]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.select(key, *rest).schema)
    out = _removed(safe, key, text, rest, length, seed, _cleaned(text), ddl).select(*[f"`{c}`" for c in safe.columns])
    return back(out)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM texts WHERE len(h) >= 200)),
ordered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM starts),
cuts AS (SELECT doc_id, i, i + 100 AS j FROM ordered WHERE again),
fresh AS (SELECT *, i > coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY i), -1) AS f FROM cuts),
spans AS (SELECT doc_id, min(i) AS i, max(j) AS j FROM (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM fresh) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, i, j, lag(j) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM spans),
kept AS (SELECT doc_id, count(*) AS n, sum(j - i) AS gone, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (i - coalesce(before, 0))) || CASE WHEN after IS NULL THEN substr(h, 2 * j + 1) ELSE '' END, '' ORDER BY i) AS h
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLE_SQL = {"op2_suffix_array_dedup": SQL}
