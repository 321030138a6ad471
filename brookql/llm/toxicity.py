"""Toxicity by classifier chains (operator 5).

The categories are predicted one after the other; the linear model of each also gets
the probabilities of the categories before it.  In training those are out-of-fold: a
document's earlier probabilities come from models fitted without its fold, features
selected without it too, so later models see them as wrong as they will be on new
documents.  Equal texts share a fold.

A category is a column of the labels and the value that counts as yes; the last one is
what `toxic` reports.  The labels at hand have one toxicity column and one of quality,
so the chain is low quality, then toxicity.  A document whose label of a category is
null takes no part in that category's fitting.

Features are the words of a text and their beginnings of 4 to 7 bytes, present or
not.  A category's features are selected by likelihood ratio (G2) against a bar that
rises with the number of features tried; features that single out the category are kept,
as many as pass.

Fitting uses at most `SAMPLE` labelled documents of either value of the last category,
those of least hash, written to the shared folder once; features are counted on the
executors, and the driver gets those that pass the bar, which the sample bounds, and
the sample's matches with them.  Scoring reads every document's whole text.

Defined results: null and empty texts have no features and get the models' bias.
Labelled ids without a document are left out; several labels for one id count as yes if
any is.  Without labels, or with one label of the last category only, nothing is toxic
and all probabilities are the label's share.  Rows without an id are scored like others,
as are repeated rows, each by its own text.  Ties in selection go by feature hash.  Very
long texts are scored whole, one at a time (text.py).  Columns beyond id and text are
not looked at by `score`, and stay as they are in `keep_clean`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm.exchange import stored
from brookql.llm.linear import Sparse, logistic, sigmoid
from brookql.llm.text import ALNUM, LOWER, distinct, lean, word_hash, words_of

U64 = np.uint64
SAMPLE = 10_000
FOLDS = 5
STEMS = (4, 5, 6, 7)
#: (name, column of the labels, value that counts as yes), in the order of the chain
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(column):
    """(lo, hi, word row, hashes [kind, word]) of consecutive rows; kind 0 is the whole word."""
    for lo, hi, w in words_of(column, ALNUM, True):
        folded = LOWER[w.data]
        size = w.end - w.start
        kinds = [w.hash]
        for n in STEMS:
            # a beginning must leave something of the word; otherwise it is the word
            h = word_hash(folded, w.start, np.minimum(w.start + n, w.end)) ^ U64(0x5851F42D4C957F2D)
            kinds.append(np.where(size > n, h, w.hash))
        yield lo, hi, w.row_of, np.stack(kinds) if len(w) else np.zeros((1 + len(STEMS), 0), U64)


def _sample(labels: DataFrame, key: str, categories, limit: int) -> DataFrame:
    """(key, y0, y1, ...) of the chosen ids."""
    yes = [F.max((F.col(column) == value).cast("int")).alias(f"y{c}") for c, (_, column, value) in enumerate(categories)]
    main = f"y{len(categories) - 1}"
    one = labels.where(F.col(key).isNotNull()).groupBy(key).agg(*yes).where(F.col(main).isNotNull())
    order = F.xxhash64(F.col(key))
    return one.where(f"{main} = 1").orderBy(order, key).limit(limit).union(one.where(f"{main} = 0").orderBy(order, key).limit(limit))


def _counter(text: str, n: int):
    """(feature, fold, yes and no of each category) of the sample's rows, added up by batch."""

    def run(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            y = [batch.column(f"y{c}").fill_null(-1).to_numpy(zero_copy_only=False) for c in range(n)]
            for lo, hi, row, kinds in features(batch.column(text)):
                h, r = kinds.ravel(), np.tile(row, len(kinds))
                order = np.lexsort([r, h])
                h, r = h[order], r[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, r = h[first], r[first]
                order = np.lexsort([fold[lo:hi][r], h])
                h, r = h[order], r[order]
                if not len(h):
                    continue
                f = fold[lo:hi][r]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])]))
                sums = [np.add.reduceat((y[c][lo:hi][r] == v).astype(np.int64), start) for c in range(n) for v in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(f[start].astype(np.int32)), *map(pa.array, sums)], names=["h", "fold", *[f"{v}{c}" for c in range(n) for v in ("yes", "no")]])

    return run


def _g2(a, b, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio of presence (a of n1, b of n0) against independence."""

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    share = (a + b) / (n1 + n0)
    return 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))


class _Tests:
    """The tests of a feature: for each selection k (without fold k; FOLDS: of all) and category c whether it is tried, and its G2."""

    def __init__(self, sizes: dict[tuple[int, int, int], int], n: int) -> None:
        total = lambda c, v, k: sum(s for (f, cc, vv), s in sizes.items() if cc == c and vv == v and f != k)
        self.size = {(k, c): (total(c, 1, k), total(c, 0, k)) for k in range(FOLDS + 1) for c in range(n)}
        self.size = {kc: s for kc, s in self.size.items() if min(s)}

    def __call__(self, batch):
        """(k, c, tried, G2) of the batch's features."""
        for (k, c), (n1, n0) in self.size.items():
            a, b = (sum((batch.column(f"{v}{c}_{f}").to_numpy(zero_copy_only=False) for f in range(FOLDS) if f != k), np.zeros(batch.num_rows)) for v in ("yes", "no"))
            yield k, c, (a * n0 > 4 * b * n1) & (a >= 3), _g2(a, b, n1, n0)


def _selected(counted: DataFrame, sizes: dict[tuple[int, int, int], int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes, and for each of FOLDS + 1 selections (without fold k; of all) which it holds."""
    tests = _Tests(sizes, n)

    def count(batches):
        for batch in batches:
            rows = [(k, c, int(tried.sum())) for k, c, tried, _ in tests(batch)]
            yield pa.RecordBatch.from_pylist([dict(zip("kcn", r)) for r in rows], pa.schema([("k", pa.int32()), ("c", pa.int32()), ("n", pa.int64())]))

    tried = {(r.k, r.c): r.n for r in counted.mapInArrow(lean(count), "k int, c int, n long").groupBy("k", "c").agg(F.sum("n").alias("n")).collect()}
    names = [f"k{k}" for k in range(FOLDS + 1)]

    def passing(batches):
        for batch in batches:
            ok = np.zeros((FOLDS + 1, batch.num_rows), bool)
            for k, c, of, g2 in tests(batch):
                ok[k] |= of & (g2 > 2 * math.log(max(2, tried.get((k, c), 0))) - 4)
            yield pa.RecordBatch.from_arrays([batch.column("h"), *map(pa.array, ok)], names=["h", *names]).filter(pa.array(ok.any(axis=0)))

    got = counted.mapInArrow(lean(passing), "h long, " + ", ".join(f"{k} boolean" for k in names)).toPandas()
    h = got["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(h)
    return h[order], np.stack([got[k].to_numpy(bool)[order] for k in names])


class Model:
    """Vocabulary (sorted hashes) and the chain's models; plain arrays, sent to the executors as they are."""

    def __init__(self, vocabulary: np.ndarray, chain: list, share: float, names: list[str]) -> None:
        self.vocabulary, self.chain, self.share, self.names, self.width = vocabulary, chain, share, names, len(names)
        #: probability from which a text is toxic; fit() sets it
        self.threshold = 0.5

    def matches(self, column):
        """For each row, the sorted distinct vocabulary numbers it holds."""
        v = self.vocabulary
        for lo, hi, row, kinds in features(column):
            pairs = []
            for h in kinds:
                if len(v) and len(h):
                    at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    hit = v[at] == h
                    pairs.append(row[hit] * len(v) + at[hit])
            found = distinct(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            r, c = (found // len(v), found % len(v)) if len(v) else (found, found)
            bounds = np.searchsorted(r, np.arange(hi - lo + 1))
            yield lo, hi, Sparse(bounds, c, np.ones(len(c)), len(v))

    def probabilities(self, x: Sparse) -> np.ndarray:
        if not self.chain:
            return np.full((len(x), self.width), self.share)
        done = np.zeros((len(x), 0))
        for u, v, b in self.chain:
            done = np.column_stack([done, sigmoid(x.dot(u) + done @ v + b)])
        return done


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories=CATEGORIES, sample: int = SAMPLE) -> Model:
    """Fit the chain on at most `sample` labelled documents of either value of the last category."""
    n, names = len(categories), [c[0] for c in categories]
    ys = [f"y{c}" for c in range(n)]
    # at most 2 * sample rows of id and labels: broadcasting them is bounded
    train = docs.select(key, text).join(F.broadcast(_sample(labels, key, categories, sample)), key)
    train = stored(train.select(F.col(key).alias("id"), F.col(text).alias("text"), *ys, F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity")
    sizes = {(r["fold"], c, v): r[f"{v}_{c}"] for r in train.groupBy("fold").agg(*[F.count_if(F.col(f"y{c}") == v).alias(f"{v}_{c}") for c in range(n) for v in (0, 1)]).collect() for c in range(n) for v in (0, 1)}
    n1, n0 = (sum(s for (_, c, v), s in sizes.items() if c == n - 1 and v == w) for w in (1, 0))
    if not n1 or not n0:
        return Model(np.zeros(0, U64), [], float(n1 > 0 and n0 == 0) if n1 + n0 else 0.0, names)
    sums = [F.sum(F.when(F.col("fold") == k, F.col(f"{v}{c}")).otherwise(0)).alias(f"{v}{c}_{k}") for c in range(n) for v in ("yes", "no") for k in range(FOLDS)]
    ddl = "h long, fold int, " + ", ".join(f"{v}{c} long" for c in range(n) for v in ("yes", "no"))
    counted = stored(train.mapInArrow(lean(_counter("text", n)), ddl).groupBy("h").agg(*sums), "toxicity")
    h, chosen = _selected(counted, sizes, n)
    model = Model(h, [], n1 / (n1 + n0), names)

    def matched(batches):
        for batch in batches:
            for lo, hi, x in model.matches(batch.column("text")):
                rows = [x.column[x.bounds[r] : x.bounds[r + 1]].tolist() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("id", "fold", *ys)], pa.array(rows, pa.list_(pa.int32()))], names=["id", "fold", *ys, "found"])

    ddl = "id long, fold int, " + ", ".join(f"{y} int" for y in ys) + ", found array<int>"
    got = train.mapInArrow(lean(matched), ddl).toPandas().sort_values(["id", "fold"], kind="stable")
    x = Sparse.of([np.asarray(f, np.int64) for f in got["found"]], len(h))
    fold = got["fold"].to_numpy()
    done = np.zeros((len(fold), 0))
    for y in (got[c].to_numpy(float) for c in ys):
        known = ~np.isnan(y)
        held = np.zeros(len(y))
        for k in range(FOLDS):
            a, b = np.flatnonzero((fold != k) & known), np.flatnonzero(fold == k)
            if len(a) and len(b):
                u, v, c = logistic(x.take(a).only(chosen[k]), done[a], y[a])
                held[b] = sigmoid(x.take(b).only(chosen[k]).dot(u) + done[b] @ v + c)
        a = np.flatnonzero(known)
        model.chain.append(logistic(x.take(a).only(chosen[FOLDS]), done[a], y[a]) if len(a) else (np.zeros(len(h)), np.zeros(done.shape[1]), 0.0))
        done = np.column_stack([done, held])
    model.threshold = best_threshold(done[:, -1], y)
    return model


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut between two of the probabilities with the best F0.5; 0.5 where the labels are all alike.

    F0.5 weighs precision more than recall: clean texts are to stay.  It is one half at most.

    The probabilities are out-of-fold ones.  A text with a single toxic word scores far
    above clean ones and yet far below one half, as most toxic texts have several.
    """
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * y.sum())
    # a cut needs different probabilities on its sides
    f[:-1][p[:-1] == p[1:]] = -1
    if not len(p) or y.min() == y.max():
        return 0.5
    k = int(np.argmax(f))
    low = p[k + 1] if k + 1 < len(p) else 0.0
    return float(min(0.5, np.sqrt(p[k] * max(low, 1e-9))))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """key, p_<category> for each category, toxic: a row a document; by the model's own threshold without another."""
    cut = model.threshold if threshold is None else threshold

    def run(batches):
        for batch in batches:
            for lo, hi, x in model.matches(batch.column(text)):
                p = model.probabilities(x)
                columns = [batch.column(key).slice(lo, hi - lo).cast(pa.int64()), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= cut if model.chain else np.zeros(hi - lo, bool))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *[f"p_{c}" for c in model.names], "toxic"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` long, " + ", ".join(f"p_{c} double" for c in model.names) + ", toxic boolean")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs without toxic rows, in one pass over the texts; all columns stay as they are."""
    cut = model.threshold if threshold is None else threshold

    def run(batches):
        for batch in batches:
            for lo, hi, x in model.matches(batch.column(text)):
                ok = model.probabilities(x)[:, -1] < cut if model.chain else np.ones(hi - lo, bool)
                yield batch.slice(lo, hi - lo).filter(pa.array(ok))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op5_toxicity_chain": op5_toxicity_chain}
ORACLE_SQL: dict[str, str] = {}
