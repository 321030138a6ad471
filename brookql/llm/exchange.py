"""Distributed lookups of fingerprints, a block of documents at a time.

Three operators ask the same question of billions of fingerprints: which of mine
occur in other documents?  One row per fingerprint would cost tens of bytes and a
JVM object each, so the exchange works on blocks:

1. `blocks()` deals the documents into `part`s that are ranges of the order key, of
   about equal bytes of text.
2. Each part announces its *distinct* fingerprints, sorted and byte-plane coded,
   as one blob per bucket of the hash space (`announce`).  A passage that a third
   of all documents share is announced once a part, not once a document.
3. Each bucket merges its blobs and answers every part that shares a fingerprint
   with another part (`answer`).
4. Each part's documents meet the answers in a cogroup.

No step gathers more than one part's texts or one bucket's blobs in a task; both
counts follow spark.sql.shuffle.partitions, to be set by input size as usual.  A part
sends a bucket at most one blob, so there are at most parts x buckets of them, as many
as any shuffle has segments; at 100 TB and 100,000 parts a blob still has about 10 KB.
Lost executors only cost their own blocks: every step is a deterministic function
of its input.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Parts and buckets per shuffle partition: small blocks even out the tasks.
BLOCKS_PER_PARTITION = 2
#: Ranges of rows that are weighed for each part.
FINE = 4
#: Settings while a table is written: a query's shuffle files go as it ends, for what it wrote no longer
#: needs them, and texts reach Python in smaller batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
BLOB_SCHEMA = "bucket int, part int, blob binary"
ANSWER_SCHEMA = "part int, blob binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    conf = spark.sparkContext.getConf()
    return (conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def block_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * BLOCKS_PER_PARTITION


def blocks(df: DataFrame, key: str, n: int, columns: list[str], text: str = "text", spread: bool = False) -> DataFrame:
    """df's key and columns with `part`, a range of the key: equal keys share a part.

    A null key sorts after all others; rows without a key share the last part, or with
    `spread` are dealt by their text over parts of their own, as many as they have bytes
    for.  Parts hold about equal numbers of bytes of
    text: the texts' bytes are summed over `FINE` times as many ranges of equal numbers
    of rows, and neighbours are put together.  The driver holds those ranges' bounds
    and sums, 16 bytes for each; the plan holds the parts' bounds as one array.
    """
    bounds: list[int] = []
    unkeyed = 0
    if n > 1:
        probs = [i / (FINE * n) for i in range(1, FINE * n)]
        fine = df.select(F.percentile_approx(key, probs, min(20 * FINE * n, 1_000_000))).head()[0]
        bounds = sorted(set(fine or []))
        # the last of the sizes is that of rows without a key
        size = [0] * (len(bounds) + 2)
        place = F.coalesce(_below(bounds, F.col(key)), F.lit(len(bounds) + 1)) if bounds else F.when(F.col(key).isNull(), 1).otherwise(0)
        for r in df.groupBy(place.alias("r")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("b")).collect():
            size[r.r] = r.b
        unkeyed = round(n * size[-1] / max(1, sum(size)))
        ends = np.cumsum(size[:-1])
        # the last fine bound below each n-th of the bytes
        at = np.searchsorted(ends, [ends[-1] * i / n for i in range(1, n)], side="left")
        bounds = sorted({bounds[min(a, len(bounds) - 1)] for a in at.tolist()}) if bounds else []
    last = F.lit(len(bounds))
    if spread and unkeyed > 1:
        last = len(bounds) + 1 + F.pmod(F.xxhash64(text), F.lit(unkeyed))
    part = F.when(F.col(key).isNull(), last).otherwise(_below(bounds, F.col(key)) if bounds else F.lit(0))
    return df.select(F.col(key), *columns, part.cast("int").alias("part"))


def _below(bounds: list[int], key):
    """How many of the sorted bounds are below the key: a binary search within the plan."""
    table, n = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), len(bounds)
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) < key), at + step).otherwise(at))
    return F.when(key.isNotNull(), found)


def without(df: DataFrame, name: str):
    """df with a column of that name renamed, and a function that renames it back."""
    if name not in df.columns:
        return df, lambda out: out
    other = f"_{name}"
    while other in df.columns:
        other = "_" + other
    return df.withColumnRenamed(name, other), lambda out: out.withColumnRenamed(other, name)


def grouped(df: DataFrame, n: int) -> DataFrame:
    """df dealt by part, as every consumer of it needs it: Spark reuses the one exchange."""
    return df.repartition(max(1, n // BLOCKS_PER_PARTITION), "part")


# -- coding ---------------------------------------------------------------------


def pack(hashes: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct hashes (and counts) as byte planes of their high-half gaps.

    Gaps of the high 32 bits, and counts, have mostly zero upper bytes, which Spark's
    shuffle compression removes; the low halves stay as they are: about 6 bytes a hash.
    """
    n = len(hashes)
    high = (hashes >> U64(32)).astype(np.uint32)
    gaps = high.copy()
    gaps[1:] -= high[:-1]
    planes = np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(n, 4).T)
    low = (hashes & U64(0xFFFFFFFF)).astype("<u4")
    tail = b"" if counts is None else np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(n, 4).T).tobytes()
    return np.uint32(n).tobytes() + planes.tobytes() + low.tobytes() + tail


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(blob, np.uint8)
    n = int(raw[:4].view("<u4")[0])
    gaps = np.ascontiguousarray(raw[4 : 4 + 4 * n].reshape(4, n).T).view("<u4").ravel()
    high = np.cumsum(gaps, dtype=np.uint32).astype(U64)
    low = np.frombuffer(blob, "<u4", n, 4 + 4 * n).astype(U64)
    tail = raw[4 + 8 * n : 4 + 12 * n]
    counts = np.ascontiguousarray(tail.reshape(4, n).T).view("<u4").ravel() if n and len(tail) else None
    return (high << U64(32)) | low, counts


def split(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bounds of each bucket's run within sorted hashes; buckets are hash ranges."""
    edges = np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def announce(part: int, hashes: np.ndarray, counts: np.ndarray | None, n_buckets: int) -> pa.Table:
    """One blob for each bucket that any of the sorted distinct hashes falls in."""
    at = split(hashes, n_buckets)
    full = np.flatnonzero(at[1:] > at[:-1])
    blobs = [pack(hashes[at[b] : at[b + 1]], None if counts is None else counts[at[b] : at[b + 1]]) for b in full]
    return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([part] * len(full), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def distinct_counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(np.append(first, len(hashes)))


def _merged(table: pa.Table):
    """All hashes of a bucket's blobs, sorted by (hash, part): hash, part, count, group starts."""
    parts = table.column("part").to_numpy()
    got = [unpack(b.as_py()) for b in table.column("blob")]
    h = np.concatenate([x for x, _ in got])
    p = np.repeat(parts, [len(x) for x, _ in got])
    c = np.concatenate([(np.ones(len(x), np.uint32) if c is None else c) for x, c in got])
    by_part = np.argsort(parts, kind="stable")
    if not np.array_equal(by_part, np.arange(len(parts))):
        order = np.argsort(p, kind="stable")
        h, p, c = h[order], p[order], c[order]
    order = np.argsort(h, kind="stable")
    h, p, c = h[order], p[order], c[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h, p, c, first


def _replies(h: np.ndarray, p: np.ndarray, c: np.ndarray | None) -> pa.Table:
    order = np.argsort(p, kind="stable")
    h, p = h[order], p[order]
    c = None if c is None else c[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(p))
    blobs = [pack(h[a:b]) + (b"" if c is None else c[a:b].astype("<u4").tobytes()) for a, b in zip(first, ends)]
    return pa.table({"part": pa.array(p[first], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def answer_later(table: pa.Table) -> pa.Table:
    """Tell each part which of its hashes an earlier part has too."""
    h, p, _, first = _merged(table)
    later = np.ones(len(h), bool)
    later[first] = False
    return _replies(h[later], p[later], None)


def answer_totals(table: pa.Table) -> pa.Table:
    """Tell each part the summed count of those of its hashes that other parts have too."""
    h, p, c, first = _merged(table)
    size = np.diff(np.append(first, len(h)))
    total = np.add.reduceat(c, first) if len(first) else c
    many = np.repeat(size > 1, size)
    return _replies(h[many], p[many], np.repeat(total, size)[many])


# -- references: where a hash stands first ----------------------------------------


def ask_first(table: pa.Table) -> pa.Table:
    """Ask the earliest part of each hash that later parts have too where it stands there."""
    h, p, _, first = _merged(table)
    size = np.diff(np.append(first, len(h)))
    h, p = h[first[size > 1]], p[first[size > 1]]
    out = _replies(h, p, None)
    return out.add_column(1, "bucket", pa.array([table.column("bucket")[0].as_py()] * out.num_rows, pa.int32()))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(len(x), 8).T).tobytes()


def pack_places(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Hashes with the documents and places where they stand, in the order of those, whose gaps are small."""
    order = np.lexsort([place, doc])
    return np.uint32(len(h)).tobytes() + h[order].astype("<u8").tobytes() + _planes(doc[order]) + _planes(place[order])


def unpack_places(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, place) of all blobs, sorted by hash."""
    hs, ds, ps = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        blob = blob.as_py()
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        hs.append(np.frombuffer(blob, "<u8", n, 4))
        for into, at in ((ds, 4 + 8 * n), (ps, 4 + 16 * n)):
            into.append(np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()))
    h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
    order = np.argsort(h)
    return h[order], d[order], p[order]


def tell_places(spoken: pa.Table, found: pa.Table) -> pa.Table:
    """Tell each part, of its hashes that an earlier part has too, where they stand first."""
    if not spoken.num_rows or not found.num_rows:
        return pa.table({"part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    h, p, _, first = _merged(spoken)
    later = np.ones(len(h), bool)
    later[first] = False
    h, p = h[later], p[later]
    known, doc, place = unpack_places(found.column("blob"))
    at = np.searchsorted(known, h)
    order = np.argsort(p, kind="stable")
    h, p, at = h[order], p[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    blobs = [pack_places(h[a:b], doc[at[a:b]], place[at[a:b]]) for a, b in zip(edges, np.append(edges[1:], len(p)))]
    return pa.table({"part": pa.array(p[edges], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def answers(table: pa.Table, totals: bool = False):
    """A part's answers: sorted hashes, and with totals their counts."""
    hs, cs = [], []
    for blob in table.column("blob"):
        blob = blob.as_py()
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        hs.append(unpack(blob)[0])
        if totals:
            cs.append(np.frombuffer(blob, "<u4", n, 4 + 8 * n))
    h = np.concatenate(hs) if hs else np.zeros(0, U64)
    order = np.argsort(h)
    if totals:
        c = np.concatenate(cs) if cs else np.zeros(0, np.uint32)
        return h[order], c[order].astype(np.int64)
    return h[order]


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where it would be."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = len(table) - 1
    return table[at] == values, at
