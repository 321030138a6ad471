"""Exact n-gram Jaccard self-join of documents (operator 10).

Rare-first prefix filtering: shingles are ordered by their document frequency over
the whole corpus (ties by hash).  Two sets of similarity t or more must share one of
the first p = n - ceil(t n) + 1 shingles of each in that order, so only prefixes are
joined.  The stages:

1. Frequencies.  Blocks of documents announce their distinct shingles and learn the
   corpus-wide counts (exchange.py).  Shingles that no other text has come first in
   the order and match nothing: a document whose prefix is all such shingles cannot
   link and is settled here.  This leaves the few documents with repeated content.
2. Classes.  Documents with equal sets collapse into one class, which carries its least
   id and is numbered by 64 bits of its set's hash.
3. Candidates.  Prefix shingles of the classes are joined, in two turns.  First each shingle's most central holder (the one in whose order it
   stands earliest) is paired with all other holders; the components of the verified
   pairs are labels.  Then holders with different labels are paired with one another.
   A group of near copies thus costs a pair a member, not a pair for every two.
   Length, positional and suffix filters run within the join: an overlap is at most
   1 + sum over hash cells of min(shingles left in either suffix).
4. Verification.  Each distinct pair once, by intersecting the repeated shingles; pairs
   of the first turn are not looked at again in the second.
5. Components of the links (components.py), named by their least document.  Where an id
   stands on rows with different sets, their classes are linked by it.

Defined results: words are maximal runs of bytes other than ASCII white space, with
A-Z lower-cased.  A text of fewer words than a shingle is one shingle; null, empty
or blank texts have none and link with nothing.  Rows with equal ids count as one
document for components, with the links of all their texts.  Rows without an id have no
links and a null component.  An empty table gives an empty table.  Very long texts are
cut whole, one at a time (text.py).  Only id and text are looked at, so other columns
may have any names; `keep_one` keeps them as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm import exchange as ex
from brookql.llm.components import components
from brookql.llm.text import SPACED, distinct, lean, sequence_hash, words_of

CELLS = 8
U64 = np.uint64


def shingle_sets(column, size: int):
    """Sorted distinct shingle hashes of each row, in turn."""
    for lo, hi, w in words_of(column, SPACED, True):
        h = sequence_hash(w.hash, size)
        for r in range(hi - lo):
            a, b = w.rows[r], w.rows[r + 1]
            if b - a >= size:
                yield distinct(h[a : b - size + 1])
            else:
                yield sequence_hash(w.hash[a:b], int(b - a)) if b > a else np.zeros(0, U64)


def _class(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _local(table: pa.Table, text: str, size: int):
    """Each row's set and class, and the block's distinct shingles with their numbers of classes."""
    sets = list(shingle_sets(table.column(text), size))
    classes = [_class(s) for s in sets]
    own = {c: s for c, s in zip(classes, sets)}
    h, c = ex.distinct_counts(np.concatenate(list(own.values())) if own else np.zeros(0, U64))
    return sets, classes, h, np.minimum(c, 255)


def _announcer(text: str, size: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, h, c = _local(table, text, size)
        return ex.announce(table.column("part")[0].as_py(), h, c, n)

    return run


def _settler(key: str, text: str, size: int, num: int, den: int):
    """Splits a block into settled rows and rows that may link, with their repeated shingles in order."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        n_of, unique, cls, toks = [], [], [], []
        if docs.num_rows:
            sets, classes, h, df = _local(docs, text, size)
            far_h, far_df = ex.answers(told, totals=True)
            hit, at = ex.member(far_h, h)
            df[at[hit]] = far_df[hit]
            for s, c in zip(sets, classes):
                n = len(s)
                f = df[np.searchsorted(h, s)]
                shared = s[f > 1]
                alive = n > 0 and n - len(shared) < n - -(-num * n // den) + 1
                n_of.append(n)
                unique.append(n - len(shared))
                cls.append(c)
                toks.append(shared[np.argsort(f[f > 1], kind="stable")].tobytes() if alive else None)
        return pa.table({key: docs.column(key).cast(pa.int64()) if docs.num_rows else pa.array([], pa.int64()), "n_shingles": pa.array(n_of, pa.int64()), "n_unique": pa.array(unique, pa.int64()), "class": pa.array(cls, pa.binary()), "toks": pa.array(toks, pa.binary())})

    return run


def _prefixes(num: int, den: int):
    """(shingle, id, size, place in order, shingles left after it, by cell) for each prefix shingle."""

    def run(batches):
        for b in batches:
            for i, n, u, toks in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("u").to_pylist(), b.column("toks")):
                t = np.frombuffer(toks.as_py(), U64)
                k = max(0, min(len(t), n - -(-num * n // den) + 1 - u))
                if not k:
                    continue
                cell = (t & U64(CELLS - 1)).astype(np.int64)
                left = np.bincount(cell, minlength=CELLS) - np.cumsum(np.eye(CELLS, dtype=np.int64)[cell[:k]], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[:k].view(np.int64)), pa.array(np.full(k, i)), pa.array(np.full(k, n, np.int32)), pa.array((u + np.arange(k)).astype(np.int32)), pa.array((len(t) - 1 - np.arange(k)).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(left.ravel().astype(np.int32)), CELLS).cast(pa.list_(pa.int32()))],
                    names=["h", "id", "n", "place", "rest", "cells"],
                )

    return run


def _joined(rows: DataFrame, hubs: DataFrame, num: int, den: int, differ: str) -> DataFrame:
    """Distinct pairs (a, b) that pass the length, positional and suffix filters."""
    x, y = rows.alias("x"), hubs.alias("y")
    need = f"(({num} * (x.n + y.n) + {num + den - 1}) div {num + den})"
    on = f"""x.h = y.h and {differ}
        and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)
        and 1 + least(x.rest, y.rest) >= {need}
        and 1 + aggregate(zip_with(x.cells, y.cells, (p, q) -> least(p, q)), 0, (s, v) -> s + v) >= {need}"""
    return x.join(y, F.expr(on)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ta[i].as_py(), U64), np.frombuffer(tb[i].as_py(), U64)
                both = np.concatenate([x, y])
                both.sort()
                o = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * o >= num * (na[i] + nb[i] - o):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb")), "b")
    return with_b.mapInArrow(lean(_verify(num, den)), "a long, b long")


class JaccardJoin:
    """The join's parts, each a DataFrame.

    settled: key, n_shingles, class of every row; reps: each class and its least id;
    links: verified pairs (a, b) of ids of classes, enough of them to connect every
    component.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100) -> None:
        n = ex.block_count(docs.sparkSession)
        self.key = key
        dealt = ex.grouped(ex.blocks(docs, key, n, [text], text, True), n)
        spoken = dealt.groupBy("part").applyInArrow(lean(_announcer(text, size, n)), ex.BLOB_SCHEMA)
        told = spoken.groupBy("bucket").applyInArrow(lean(ex.answer_totals), ex.ANSWER_SCHEMA)
        settled = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lean(_settler(key, text, size, num, den)), f"`{key}` long, n_shingles long, n_unique long, class binary, toks binary")
        settled = stored(settled)
        full = settled.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
        reps = full.groupBy("class").agg(F.min(key).alias("rep"))
        # one row a class that may link: that of its least id
        alive = full.where(F.col("toks").isNotNull()).alias("d").join(reps.alias("r"), F.expr(f"d.class = r.class and d.`{key}` = r.rep"))
        number = F.conv(F.substring(F.hex("d.class"), 1, 15), 16, 10).cast("long")
        sets = alive.select(number.alias("id"), "rep", F.col("n_shingles").alias("n"), F.col("n_unique").alias("u"), "toks").dropDuplicates(["id"])
        sets = stored(sets)
        rows = stored(sets.mapInArrow(lean(_prefixes(num, den)), "h long, id long, n int, place int, rest int, cells array<int>"))
        hubs = rows.groupBy("h").agg(F.min(F.struct("place", "id", "n", "rest", "cells")).alias("hub"), F.count("*").alias("holders")).where("holders > 1")
        hubs = stored(hubs.select("h", "hub.id", "hub.n", "hub.place", "hub.rest", "hub.cells"))
        tried = stored(_joined(rows, hubs, num, den, "x.id != y.id"))
        first = stored(_links(tried, sets, num, den))
        label = components(first).toDF("id", "label")
        shared = rows.join(hubs.select("h"), "h", "left_semi").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        shared = stored(shared)
        rest = _joined(shared, shared, num, den, "x.id < y.id and x.label != y.label").join(tried, ["a", "b"], "left_anti")
        linked = stored(first.union(_links(rest, sets, num, den)))
        named = sets.select("id", "rep")
        linked = linked.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # an id with several sets links their classes
        several = full.groupBy(key).agg(F.min("class").alias("c"), F.max("class").alias("d")).where("c != d").select(key)
        joint = full.select(key, "class").join(several, key).join(reps, "class").select(F.col(key).alias("a"), F.col("rep").alias("b"))
        self.links = stored(linked.union(joint).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        self.settled, self.full, self.reps = settled, full, reps

    def documents(self) -> DataFrame:
        """key, n_shingles, component_id of every row."""
        key = self.key
        named = components(self.links).select(F.col("node").alias("rep"), "component")
        classes = self.reps.join(named, "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
        classes = stored(classes)  # both sides of the next join are plain exchanges, so a hot class can be split
        # a document id may stand on several rows: its component is the least of its rows'
        found = self.full.select(key, "class").join(classes, "class").groupBy(key).agg(F.min("component").alias("component"))
        return self.settled.join(found, key, "left").select(key, "n_shingles", F.coalesce("component", key).alias("component_id"))


def stored(df: DataFrame) -> DataFrame:
    return ex.stored(df, "jaccard")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those that are linked, directly or through others, to one with a lesser id.

    Rows without an id stay; so do all rows of the id that is kept.
    """
    named = JaccardJoin(docs, key, text, size, num, den).documents()
    losers = named.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(losers, key, "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()


SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM texts),
grams AS (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM places),
sets AS (SELECT DISTINCT doc_id, g FROM grams WHERE p <= greatest(n - 3, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= 85 * (s.n + t.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(c.y, t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) c ON c.x = t.doc_id
"""

QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
ORACLE_SQL = {"op10_ngram_jaccard_join": SQL}
