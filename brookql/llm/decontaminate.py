"""Benchmark decontamination with a positional inverted index (operator 9).

`build_index` cuts the documents into blocks of about `BLOCK_BYTES` of text and
stores, for every block, the postings of all its words: for each distinct word the
ascending word positions at which it occurs.  The index is document-partitioned:
blocks are independent rows of a Parquet table in the shared folder, so building
and searching need no shuffle, and a lost task rebuilds or searches one block again.

`search` answers phrase queries.  In a block, only phrases are looked at whose rarest
word (in the benchmark) it holds.  Such a phrase starts from the postings of its rarest
word in the block (a phrase with an absent word is dropped at once), and the
candidate starts are intersected, word after word from rare to frequent, with the
offset-adjusted lists of its other words.  With `slop` > 0 a word may stand up to
that many places from where the phrase has it (a proximity match).

Phrases come from the benchmark, in batches of at most about `BATCH_BYTES` of its text,
counted before anything is collected.  A benchmark of one batch is sent to the executors
and asked in one pass.  A larger one takes one pass over the stored index a batch, one
batch at a time: its phrases are sent, its hits (blocks, rows, places, items) are stored,
its broadcast is destroyed; then the hits of all batches are put together by block.

Defined results: A-Z are lower-cased, words are runs of letters, digits and
non-ASCII bytes.  Null texts have no words, and items without words match nothing.
An item of fewer words than a window is one phrase.  Repeated rows are judged one
by one; items with equal ids and texts count once.  An item without an id is
reported as an empty string.  Empty tables on either side give no hits.  Very long texts
are blocks of their own, held whole.  Only id and text are looked at, so other columns
may have any names; `clean` keeps them as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm import exchange as ex
from brookql.llm.text import ALNUM, covered, lean, row_sums, words_of

U64 = np.uint64
WINDOW = 13
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
INDEX_SCHEMA = "block string, ids binary, rows binary, terms binary, first binary, places binary"


def _postings(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, first, places): places[first[i]:first[i+1]] are the word positions of terms[i]."""
    order = np.argsort(w.hash, kind="stable")
    h = w.hash[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.append(first, len(h)), order


def _indexer(key: str, text: str):
    def run(batches):
        for batch in batches:
            ids = batch.column(key).cast(pa.int64())
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, w in words_of(batch.column(text), ALNUM, True, BLOCK_BYTES):
                terms, first, places = _postings(w)
                yield pa.RecordBatch.from_pydict({
                    "block": [uuid.uuid4().hex],
                    "ids": [ids[lo:hi].tobytes() + null[lo:hi].tobytes()],
                    "rows": [w.rows.astype("<i8").tobytes()],
                    "terms": [terms.tobytes()],
                    "first": [first.astype("<u4").tobytes()],
                    "places": [places.astype("<u4").tobytes()],
                })

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the positional index of docs and return it, a row a block."""
    return ex.stored(docs.select(key, text).mapInArrow(lean(_indexer(key, text)), INDEX_SCHEMA), "postings")


class Phrases:
    """Distinct phrases of some items: words[first[i]:first[i+1]] are terms of phrase i; owners pair phrases with items."""

    def __init__(self, items: pa.Table, key: str, text: str, window: int) -> None:
        seen: dict[bytes, int] = {}
        owners: set[tuple[int, int]] = set()
        self.names = sorted({"" if i is None else str(i) for i in items.column(key).to_pylist()})
        at = {n: k for k, n in enumerate(self.names)}
        ids = items.column(key).to_pylist()
        for lo, hi, w in words_of(items.column(text), ALNUM, True):
            for r in range(lo, hi):
                h = w.hash[w.rows[r - lo] : w.rows[r - lo + 1]]
                size = min(window, len(h))
                for a in range(len(h) - size + 1 if size else 0):
                    owners.add((seen.setdefault(h[a : a + size].tobytes(), len(seen)), at["" if ids[r] is None else str(ids[r])]))
        rows = [np.frombuffer(b, U64) for b in seen]
        self.size = np.array([len(x) for x in rows], np.int64)
        self.vocabulary, words = np.unique(np.concatenate(rows) if rows else np.zeros(0, U64), return_inverse=True)
        width = int(self.size.max()) if rows else 0
        self.words = np.zeros((len(rows), width), np.int64)
        self.words[np.arange(width) < self.size[:, None]] = words
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        self.owner = pairs[:, 1]
        # phrases by their rarest word: lead[led[t]:led[t+1]] are those of vocabulary word t
        used = np.arange(width) < self.size[:, None]
        often = np.bincount(self.words[used], minlength=len(self.vocabulary))
        rarest = self.words[np.arange(len(rows)), np.where(used, often[self.words], np.iinfo(np.int64).max).argmin(axis=1)] if len(rows) else np.zeros(0, np.int64)
        self.lead = np.argsort(rarest, kind="stable")
        self.led = np.searchsorted(rarest[self.lead], np.arange(len(self.vocabulary) + 1))
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))


def _find(block: dict, q: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of all matches in a block, by intersecting postings from the rarest word."""
    terms, first, places, rows = block["terms"], block["first"], block["places"], block["rows"]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(q.size):
        return none
    at = np.minimum(np.searchsorted(terms, q.vocabulary), len(terms) - 1)
    count = np.where(terms[at] == q.vocabulary, first[at + 1] - first[at], 0)
    held = np.flatnonzero(count)
    n = q.led[held + 1] - q.led[held]
    phrase = np.sort(q.lead[np.repeat(q.led[held] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    df = np.where(np.arange(q.words.shape[1]) < q.size[phrase][:, None], count[q.words[phrase]], np.iinfo(np.int64).max)
    whole = (df > 0).all(axis=1)
    phrase, df = phrase[whole], df[whole]
    if not len(phrase):
        return none
    turn = np.argsort(df, axis=1, kind="stable")
    rank_of = at[q.words[phrase]]
    # postings as one sorted list of (term, place)
    keys = (np.repeat(np.arange(len(terms)), np.diff(first)) << 32) | places
    lead = turn[:, 0]
    term = rank_of[np.arange(len(phrase)), lead]
    n = first[term + 1] - first[term]
    owner = np.repeat(np.arange(len(phrase)), n)
    start = places[np.repeat(first[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] - lead[owner]
    fits = (start >= 0) & (start + q.size[phrase[owner]] <= rows[-1])
    owner, start = owner[fits], start[fits]
    row = np.searchsorted(rows, start, side="right") - 1
    fits = start + q.size[phrase[owner]] <= rows[row + 1]
    owner, start = owner[fits], start[fits]
    for k in range(1, turn.shape[1]):
        if not len(owner):
            break
        place = turn[owner, k]
        more = place < q.size[phrase[owner]]
        want = (rank_of[owner, place] << 32) + start + place
        found = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
        ok = ~more | ((keys[found] >= want - slop) & (keys[found] <= want + slop))
        owner, start = owner[ok], start[ok]
    return phrase[owner], start


def _blocks(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: E731, B023
            rows = get("rows", "<i8")
            raw, n = batch.column("ids")[i].as_py(), len(rows) - 1
            block = {"block": batch.column("block")[i].as_py(), "ids": np.frombuffer(raw, "<i8", n), "null": np.frombuffer(raw, bool, n, 8 * n), "rows": rows}
            if "terms" in batch.schema.names:
                block |= {"terms": get("terms", U64), "first": get("first", "<u4").astype(np.int64), "places": get("places", "<u4").astype(np.int64)}
            if "hits" in batch.schema.names:
                block["hits"] = batch.column("hits")[i].as_py() or []
            yield block


def _found(block: dict, q: Phrases, slop: int):
    """(first words, end words, {row: item names}) of a batch's matches in a block."""
    phrase, start = _find(block, q, slop)
    row = np.searchsorted(block["rows"], start, side="right") - 1
    owned: dict[int, set[str]] = {}
    for r, p in zip(row.tolist(), phrase.tolist()):
        owned.setdefault(r, set()).update(q.names[o] for o in q.owner[q.owned[p] : q.owned[p + 1]])
    return start, start + q.size[phrase], owned


def _contaminated(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (hits > 0) & (20 * hits >= words)


def _digest(key: str, block: dict, start, end, owned) -> pa.RecordBatch:
    n = len(block["ids"])
    words, hits = np.diff(block["rows"]), row_sums(covered(int(block["rows"][-1]), start, end), block["rows"])
    items = [sorted(owned.get(r, ())) for r in range(n)]
    return pa.RecordBatch.from_pydict({
        key: pa.array(block["ids"], mask=block["null"]),
        "n_words": pa.array(words, pa.int64()),
        "n_hit": pa.array(hits, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
        "contaminated": pa.array(_contaminated(hits, words)),
    })


def phrase_batches(items: DataFrame, key: str, text: str, window: int, limit: int = BATCH_BYTES):
    """(number of batches, the batches' broadcasts in turn): the items' phrases, at most about `limit` bytes of item text in each.

    A batch is collected when it is asked for, and its broadcast destroyed when the next one is.
    """
    size = items.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    n = -(-size // limit) or 1
    named = items.select(key, text)

    def turns():
        for k in range(n):
            part = named if n == 1 else named.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == k)
            sent = items.sparkSession.sparkContext.broadcast(Phrases(part.toArrow(), key, text, window))
            yield sent
            if n > 1:
                sent.destroy()

    return n, turns()


HIT_SCHEMA = "block string, start binary, end binary, rows array<int>, names array<array<string>>"


def search(index: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, limit: int = BATCH_BYTES) -> DataFrame:
    """A row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    ddl = f"`{key}` long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    n, turns = phrase_batches(items, item_key, item_text, window, limit)

    def at_once(sent):
        def run(batches):
            for block in _blocks(batches):
                yield _digest(key, block, *_found(block, sent.value, slop))

        return run

    def hits(sent):
        def run(batches):
            for block in _blocks(batches):
                start, end, owned = _found(block, sent.value, slop)
                if len(start):
                    yield pa.RecordBatch.from_pylist([{"block": block["block"], "start": start.astype("<i8").tobytes(), "end": end.astype("<i8").tobytes(), "rows": list(owned), "names": [sorted(x) for x in owned.values()]}], pa.schema([("block", pa.string()), ("start", pa.binary()), ("end", pa.binary()), ("rows", pa.list_(pa.int32())), ("names", pa.list_(pa.list_(pa.string())))]))

        return run

    def together(batches):
        for block in _blocks(batches):
            owned: dict[int, set[str]] = {}
            for h in block["hits"]:
                for r, names in zip(h["rows"], h["names"]):
                    owned.setdefault(r, set()).update(names)
            ends = [np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(h[c], "<i8") for h in block["hits"])]) for c in ("start", "end")]
            yield _digest(key, block, *ends, owned)

    if n == 1:
        return index.mapInArrow(lean(at_once(next(turns))), ddl)
    found = [ex.stored(index.mapInArrow(lean(hits(sent)), HIT_SCHEMA), "hits") for sent in turns]
    listed = reduce(DataFrame.unionAll, found).groupBy("block").agg(F.collect_list(F.struct("start", "end", "rows", "names")).alias("hits"))
    return index.select("block", "ids", "rows").join(listed, "block", "left").mapInArrow(lean(together), ddl)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """docs without the rows in which any window of an item occurs, each row judged by its own text whatever its id.

    This is stricter than `contaminated`, which asks for a twentieth of the words: a
    long document that quotes one passage still leaks it.  One pass over docs a batch of
    phrases: a block's postings are built, asked and dropped.  The pass of a single batch
    filters the rows itself; several store the digests of the texts they hit, whose rows
    go in the end.
    """
    n, turns = phrase_batches(items, "item_id", "text", WINDOW, limit)

    def hit_rows(column, sent):
        for lo, hi, w in words_of(column, ALNUM, True, BLOCK_BYTES):
            terms, first, places = _postings(w)
            phrase, start = _find({"rows": w.rows, "terms": terms, "first": first, "places": places}, sent.value, 0)
            hit = np.zeros(hi - lo, bool)
            hit[np.searchsorted(w.rows, start, side="right") - 1] = True
            yield lo, hi, hit

    def kept(sent):
        def run(batches):
            for batch in batches:
                for lo, hi, hit in hit_rows(batch.column(text), sent):
                    yield batch.slice(lo, hi - lo).filter(pa.array(~hit))

        return run

    def leaks(sent):
        def run(batches):
            for batch in batches:
                for lo, _, hit in hit_rows(batch.column(text), sent):
                    texts = {batch.column(text)[lo + int(r)].as_py() for r in np.flatnonzero(hit)}
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["digest"])

        return run

    if n == 1:
        return docs.mapInArrow(lean(kept(next(turns))), docs.schema)
    found = [ex.stored(docs.select(text).mapInArrow(lean(leaks(sent)), "digest string"), "leaks") for sent in turns]
    leaked = reduce(DataFrame.unionAll, found).distinct()
    return docs.join(leaked, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == leaked["digest"], "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_CUT} AS ws FROM benchmark),
phrases AS (SELECT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS w FROM
  (SELECT item_id, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)),
texts AS (SELECT doc_id, {_CUT} AS ws FROM documents),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM texts),
windows AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM places),
found AS (SELECT d.doc_id, d.p, b.size, b.item_id FROM (SELECT doc_id, p, size, array_to_string(list_slice(l, 1, size), ' ') AS w
  FROM windows, (SELECT DISTINCT size FROM phrases) WHERE len(l) >= size) d JOIN phrases b ON d.size = b.size AND d.w = b.w),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN owned USING (doc_id)
"""

QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLE_SQL = {"op9_benchmark_decontamination": SQL}
