"""Hierarchical language identification (operator 8).

A text's language family is predicted first; within the family, one-versus-one linear
support vector machines separate the languages, and the winner of most duels is the
prediction.  Families are told apart by one-versus-one machines too.

Features are counts of hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, anything
but letters and non-ASCII bytes folded to one blank) of the whole text, square-rooted
and scaled to unit length.  Learning takes at most `PER_LANGUAGE` labelled texts of
each language, those of least hash, and at most `SAMPLE` in all (with many languages,
fewer of each), from rows that are not held out; of a held-out
row (crc32 of the id mod 4 is 2) neither text nor language is looked at.  Prediction
uses the text alone.

Defined results: a null text or one without a letter is `und` with score 0.  Without
any labelled text everything is `und`.  With one language that language is predicted,
with score 1.  A language without a given family is a family of its own.  Rows
without an id are not held out.  Ties go to the language that sorts first.  Repeated
rows are learned from and predicted one by one; an empty table gives an empty table.  A
very long text is counted whole, and takes some 60 times its bytes of memory while it
is.  Only id, text and language are looked at, so other columns may have any names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookql.llm.linear import hinge, sigmoid
from brookql.llm.text import LOWER, chunks, lean, row_sums, utf8

U64 = np.uint64
WIDTH = 1 << 11
PER_LANGUAGE = 800
SAMPLE = 32_000
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_FOLD = np.where(_LETTER[LOWER] | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit rows of square-rooted n-gram counts."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * WIDTH
    x = _FOLD[data].astype(np.uint32)
    out = np.zeros(n * WIDTH)
    gram = x.copy()
    for size in (1, 2, 3):
        if size > 1:
            gram = gram[:-1] * np.uint32(256) + x[size - 1 :]
        if not len(gram):
            break
        h = (gram * np.uint32(2654435761) + np.uint32(size * 977)) >> np.uint32(21)
        whole = row[: len(gram)] == row[size - 1 :]
        out += np.bincount((row[: len(gram)] + h)[whole], minlength=n * WIDTH)
    out = np.sqrt(out.reshape(n, WIDTH))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def lettered(column, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter: by their bytes if ASCII, by their characters otherwise."""
    ok = row_sums(_LETTER[LOWER[data]], offsets) > 0
    for r in np.flatnonzero(~ok & (np.diff(offsets) > 0)):
        ok[r] = any(c.isalpha() for c in column[int(r)].as_py() or "")
    return ok


class Duels:
    """One-versus-one machines between named classes."""

    def __init__(self, x: np.ndarray, names: np.ndarray) -> None:
        self.names = sorted(set(names.tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        self.w, self.b = np.zeros((WIDTH, len(self.pairs))), np.zeros(len(self.pairs))
        for k, (i, j) in enumerate(self.pairs):
            mine = np.isin(names, [self.names[i], self.names[j]])
            y = np.where(names[mine] == self.names[i], 1.0, -1.0)
            self.w[:, k], self.b[k] = hinge(x[mine], y)

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the winner, how sure: the least probability of its duels) a row."""
        n, k = len(x), len(self.names)
        if not self.pairs:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.w + self.b
        votes, least = np.zeros((n, k)), np.ones((n, k))
        for d, (i, j) in enumerate(self.pairs):
            p = sigmoid(4 * margin[:, d])
            votes[:, i] += margin[:, d] >= 0
            votes[:, j] += margin[:, d] < 0
            least[:, i] = np.minimum(least[:, i], p)
            least[:, j] = np.minimum(least[:, j], 1 - p)
        # most votes, then the surest
        best = np.argmax(votes + least / 2, axis=1)
        return best, least[np.arange(n), best]


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, str]) -> None:
        family = np.array([families.get(name, name) for name in langs], dtype=object)
        self.families = Duels(x, family)
        self.within = [Duels(x[family == f], langs[family == f]) for f in self.families.names]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), "und", dtype=object), np.zeros(len(x))
        if self.families.names:
            f, sure = self.families.winners(x)
            for k, duels in enumerate(self.within):
                mine = np.flatnonzero(f == k)
                won, p = duels.winners(x[mine])
                lang[mine] = np.array(duels.names, dtype=object)[won]
                score[mine] = sure[mine] * p
        return lang, np.clip(score, 0, 1)


def held_out(key):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, str] | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from at most per_language texts of each language, and SAMPLE in all."""
    known = docs.select(key, text, lang).where(F.col(lang).isNotNull() & ~held_out(key) & (F.length(text) > 0))
    order = Window.partitionBy(lang).orderBy(F.xxhash64(key, lang), key)
    # first a share of each language by hash, half as large again as wanted, so that no language is sorted whole
    sizes = known.groupBy(lang).agg(F.count("*").alias("n"))
    per_language = max(1, min(per_language, SAMPLE // max(1, sizes.count())))
    share = F.pmod(F.xxhash64(lang, key), F.lit(1 << 30)) / float(1 << 30)
    known = known.join(F.broadcast(sizes), lang).where(share * F.col("n") <= 1.5 * per_language + 50)
    ids = known.select(key, lang).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select(key).distinct()
    # at most per_language ids a language: bounded by the number of languages
    rows = known.select(key, text, lang).join(F.broadcast(ids), key).select(text, lang)

    def featured(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for lo, hi in chunks(offsets, rows=256):
                a, b = offsets[lo], offsets[hi]
                x = counts(data[a:b], offsets[lo : hi + 1] - a).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(lang).slice(lo, hi - lo)], names=["x", "lang"])

    got = rows.mapInArrow(lean(featured), "x binary, lang string").toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    x = np.frombuffer(b"".join(v.as_py() for v in got.column("x")), np.float32).reshape(-1, WIDTH) if len(langs) else np.zeros((0, WIDTH), np.float32)
    # rows arrive in any order: sort them by content, so that learning is repeatable
    order = np.lexsort([x[:, 33], x[:, 101], x.sum(axis=1), langs.astype(str)])
    return Model(x[order].astype(np.float64), langs[order], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of every document."""

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            data, offsets = utf8(column)
            for lo, hi in chunks(offsets, rows=256):
                a, b = offsets[lo], offsets[hi]
                mine, bounds = data[a:b], offsets[lo : hi + 1] - a
                lang, score = model.predict(counts(mine, bounds))
                ok = lettered(column.slice(lo, hi - lo), mine, bounds)
                lang[~ok], score[~ok] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    return docs.select(key, text, held_out(key).alias("held_out")).mapInArrow(lean(run), f"`{key}` long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
