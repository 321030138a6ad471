"""Substring deduplication of documents by relative Lempel-Ziv parsing (operator 4).

Every document is parsed greedily against the documents with smaller ids.  These
references are indexed in blocks by their windows (runs of `window` words):

1. Every block announces the fingerprints of its distinct windows, by hash range
   (exchange.py); a range asks the earliest block of each window that others have too.
2. That block looks its own texts up and answers with the window's reference: the
   document and the word at which it stands first.  The range passes references on to
   the later blocks that have the window.
3. A document is factored from left to right.  A factor starts at the first word whose
   window has a reference and takes in the following words for as long as the next
   window's reference is the next word of the same reference document.  Where it is
   another document or place, or none, the factor ends, and the next one starts at the
   next window that has a reference: windows that straddle the boundary of two factors
   are looked up like all others, so no repeat is lost there.  A factor is at least
   `window` words long by construction, and every factor is a duplicate span.

Removed is what factors cover, which is exactly the set of words covered by windows that
start in a document with a smaller id.

Defined results: a null or empty text has no words and loses nothing; a text with
fewer words than a window loses nothing; documents with equal ids are not smaller
than one another, so neither loses words to the other; documents without an id
come last.  Repeated rows are treated one by one.  An empty table gives
an empty table.  Texts of any length are parsed whole; memory is bounded by one block's
texts or the longest text.  `remove_repeats` keeps other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brookql.llm import exchange as ex
from brookql.llm.text import SPACED, covered, distinct, lean, row_sums, words_of

WINDOW = 13
LAST = np.iinfo(np.int64).max


def _ids(table: pa.Table, key: str) -> np.ndarray:
    return table.column(key).combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _sorted(table: pa.Table, key: str) -> pa.Table:
    return table.take(pa.array(np.argsort(_ids(table, key), kind="stable")))


def _announcer(text: str, window: int, n: int):
    def run(table: pa.Table) -> pa.Table:
        found = [w.windows(window)[1] for _, _, w in words_of(table.column(text), SPACED, False)]
        hashes = distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return ex.announce(table.column("part")[0].as_py(), hashes, None, n)

    return run


def _places(key: str, text: str, window: int):
    """Answers which document and word each asked window of a block stands at first."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        buckets, blobs = [], []
        if docs.num_rows and asked.num_rows:
            docs = _sorted(docs, key)
            ids = _ids(docs, key)
            want = [ex.unpack(b.as_py())[0] for b in asked.column("blob")]
            h = np.concatenate(want)
            bucket = np.repeat(asked.column("bucket").to_numpy(), [len(x) for x in want])
            order = np.argsort(h)
            h, bucket = h[order], bucket[order]
            doc, place = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
            for lo, hi, w in words_of(docs.column(text), SPACED, False):
                at, found = w.windows(window)
                hit, where = ex.member(found, h)
                at, where = at[hit], where[hit]
                fresh = place[where] < 0
                where, first = np.unique(where[fresh], return_index=True)
                row = w.row_of[at[fresh][first]]
                doc[where], place[where] = ids[lo:hi][row], at[fresh][first] - w.rows[row]
            for b in np.unique(bucket):
                mine = bucket == b
                buckets.append(b)
                blobs.append(ex.pack_places(h[mine], doc[mine], place[mine]))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


class Factors:
    """Greedy factors of some rows: for each its row, words [first, end) from the row's start, and where it stands in its reference."""

    def __init__(self, w, at: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> None:
        """at: sorted first words of the windows with a reference; doc, place: those."""
        row = w.row_of[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        self.row, self.doc, self.place = row[first], doc[first], place[first]
        self.begin, self.stop = at[first], at[last] + window
        base = w.rows[self.row]
        self.first, self.end = self.begin - base, self.stop - base
        self.covered = covered(len(w), self.begin, self.stop)


def _parser(key: str, text: str, window: int, emit):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return emit.empty
        docs = _sorted(docs, key)
        ids = _ids(docs, key)
        far_h, far_doc, far_place = ex.unpack_places(told.column("blob"))
        # where each window stands first within this block: ids ascend, so a stable sort puts that first
        found, whose, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, w in words_of(docs.column(text), SPACED, False):
            at, h = w.windows(window)
            row = w.row_of[at]
            found.append(h)
            whose.append(ids[lo:hi][row])
            where.append((at - w.rows[row]).astype(np.uint32))
        h = np.concatenate(found)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        near_h, near_doc, near_place = h[first], np.concatenate(whose)[order[first]], np.concatenate(where)[order[first]].astype(np.int64)
        del found, whose, where, h, order, first
        out = []
        for lo, hi, w in words_of(docs.column(text), SPACED, False):
            at, h = w.windows(window)
            doc, place, hit = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            if len(at):
                _, i = ex.member(h, near_h)
                doc, place = near_doc[i], near_place[i]
                own = ids[lo:hi][w.row_of[at]]
                far, i = ex.member(h, far_h)
                doc[far], place[far] = far_doc[i[far]], far_place[i[far]]
                # documents without an id are spread over blocks, and none is before another
                hit = doc < own
            out.append(emit(docs, lo, hi, w, Factors(w, at[hit], doc[hit], place[hit], window)))
        return pa.concat_tables(out)

    return run


class Digest:
    """The document's id, counts, the hash of its kept words and the number of its factors."""

    schema = "{key} long, n_words long, n_removed long, kept_sha256 string, n_factors long"

    def __init__(self, key: str) -> None:
        self.key, self.ddl = key, self.schema.format(key=f"`{key}`")
        self.empty = pa.table({key: pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "n_factors": pa.array([], pa.int64())})

    def __call__(self, docs, lo, hi, w, f: Factors) -> pa.Table:
        return pa.table({
            self.key: docs.column(self.key).slice(lo, hi - lo).cast(pa.int64()),
            "n_words": pa.array(np.diff(w.rows), pa.int64()),
            "n_removed": pa.array(row_sums(f.covered, w.rows), pa.int64()),
            "kept_sha256": pa.array(w.joined_sha256(~f.covered), pa.string()),
            "n_factors": pa.array(np.bincount(f.row, minlength=hi - lo), pa.int64()),
        })


class Cleaned:
    """The document's row with its kept words as text; rows that lose nothing stay unchanged."""

    def __init__(self, key: str, text: str, ddl: str) -> None:
        self.key, self.text, self.ddl = key, text, ddl
        self.empty = None

    def __call__(self, docs, lo, hi, w, f: Factors) -> pa.Table:
        lost = row_sums(f.covered, w.rows)
        rows = docs.slice(lo, hi - lo)
        if lost.any():
            data, bounds = w.joined(~f.covered)
            view = data.tobytes()
            texts = rows.column(self.text).to_pylist()
            for r in np.flatnonzero(lost):
                texts[r] = view[bounds[r] : max(bounds[r], bounds[r + 1] - 1)].decode()
            rows = rows.set_column(rows.schema.get_field_index(self.text), self.text, pa.array(texts, pa.string()))
        return rows.drop_columns(["part"])


class Spans:
    """One row a factor: the duplicate span's document and words, and its reference's document and first word."""

    def __init__(self, key: str) -> None:
        self.key, self.names = key, [key, "first_word", "end_word", "reference", "reference_word"]
        self.ddl = ", ".join(f"`{c}` long" for c in self.names)
        self.empty = pa.table({c: pa.array([], pa.int64()) for c in self.names})

    def __call__(self, docs, lo, hi, w, f: Factors) -> pa.Table:
        ids = docs.column(self.key).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(f.row))
        return pa.table([ids, *[pa.array(x, pa.int64()) for x in (f.first, f.end, f.doc, f.place)]], names=self.names)


def parse(docs: DataFrame, emit, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Parse every document against all with smaller ids; `emit` makes the rows."""
    n = ex.block_count(docs.sparkSession)
    dealt = ex.grouped(ex.blocks(docs, key, n, columns or [text], text, True), n)
    spoken = dealt.groupBy("part").applyInArrow(lean(_announcer(text, window, n)), ex.BLOB_SCHEMA)
    asked = spoken.groupBy("bucket").applyInArrow(lean(ex.ask_first), "part int, bucket int, blob binary")
    found = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lean(_places(key, text, window)), "bucket int, blob binary")
    told = spoken.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(lean(ex.tell_places), ex.ANSWER_SCHEMA)
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lean(_parser(key, text, window, emit)), emit.ddl)


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The factors: (key, first_word, end_word, reference, reference_word)."""
    return parse(docs, Spans(key), key, text, window=window)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated words removed from the text; all other columns stay."""
    safe, back = ex.without(docs, "part")
    rest = [c for c in safe.columns if c != key]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in safe.select(key, *rest).schema)
    out = parse(safe, Cleaned(key, text, ddl), key, text, rest, window).select(*[f"`{c}`" for c in safe.columns])
    return back(out)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row a document: counts, kept_sha256 and the number of factors."""
    return parse(docs, Digest(key), key, text, window=window)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM texts),
windows AS (SELECT doc_id, p, w FROM (SELECT doc_id, p, string_agg(word, ' ') OVER seq AS w, count(*) OVER seq AS n FROM places
  WINDOW seq AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
firsts AS (SELECT w, doc_id AS reference, p AS q FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows) WHERE k = 1),
hits AS (SELECT doc_id, p, reference, q FROM windows JOIN firsts USING (w) WHERE reference < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM hits),
factors AS (SELECT doc_id, count(*) FILTER (WHERE fresh) AS n_factors FROM (SELECT doc_id, NOT coalesce(lag(p) OVER seq = p - 1 AND lag(reference) OVER seq = reference AND lag(q) OVER seq = q - 1, false) AS fresh
  FROM hits WINDOW seq AS (PARTITION BY doc_id ORDER BY p)) GROUP BY doc_id),
marked AS (SELECT l.doc_id, l.p, l.word, g.p IS NOT NULL AS hit FROM places l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE hit) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT hit) AS kept FROM marked GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_factors, 0) AS n_factors
FROM texts t LEFT JOIN sums USING (doc_id) LEFT JOIN factors USING (doc_id)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE_SQL = {"op4_substring_dedup": SQL}
