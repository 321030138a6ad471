"""Quality classification by co-training (operator 7).

Two views describe a document: its text content (shape and repetition of bytes, words
and lines, and hashed trigrams of bytes) and the metadata of the page that it came from
(host, registered domain and suffix, path and query, and the page's markup: its size and
the shares of text, paragraphs, links, lists, scripts and other tags), with the
document's source, language and recorded length.  A page belongs to the document whose
id its url's path names; of several the one with the least id counts; a document without
a page has its own flag.

Each view has a linear classifier.  Starting from labelled documents, in each round
either classifier labels all unlabelled documents that it is sure of, and hands them to
the *other* view's training set.  Both are then calibrated on labelled documents kept
out of training (Platt scaling), and their log-odds are added with weights fitted on
others of these; that score is computed for every document.

`views` reads every whole text once and stores a compact row a document: the text
features (trigram shares in one byte each), the metadata and the label.  The features,
not the texts, are joined to pages and labels by id, so text is never shuffled.

Fitting uses at most `SAMPLE` labelled documents of either label, those of least hash,
and every unlabelled document.  A round is one pass over the unlabelled rows on the
executors: each task adds up, for either view and label, the gradient of the loss over
the documents handed over and the curvature of a quadratic bound on it, and the sums of
all tasks, with those of the labelled rows, give one step of the view to the bound's
least point.  No document leaves the executors.  Labels are given anew in each round.

An unlabelled document has no label or no id; labelled ones beyond the sample are not
handed over.

Defined results: null and empty texts get the features of an empty text; a null
source, language or length is a value of its own.  Labels without a document are left
out; several labels for one id count as bad if any is.  Without labels, or with one
label only, the score is that label's share and every document is kept.  Repeated rows
count one by one, equal scores stay equal, an empty table gives an empty table.  A very
long text is looked at whole, and takes some 60 times its bytes of memory while it is.
Columns beyond those named are not looked at, so they may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookql.llm.exchange import stored
from brookql.llm.linear import Sparse, folds, logistic, sigmoid
from brookql.llm.text import SPACED, Words, chunks, lean, row_sums, utf8, word_hash
from brookql.llm.url_reputation import document_of, levels, parsed

U64 = np.uint64
SAMPLE = 4000
ROUNDS = 3
PARTS = 16
SURE = 0.95
THRESHOLD = 0.3
GRAMS = 512
META = 256
#: Rows looked at together.
ROWS = 2048


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _repeats(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct values a row, given the rows' bounds."""
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    order = np.lexsort([h, row])
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row_sums(new, rows)


_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 13, 32), range(128, 256), (33, 63), (36, 37, 38, 42, 35), (46, 44, 59, 58)), 1):
    _CLASS[list(_set)] = _k


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    w = Words(data, offsets, SPACED, True)
    words = np.diff(w.rows)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    kinds = np.bincount(row * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks + 1])) if len(data) else offsets
    lines_at = np.searchsorted(edges, offsets)
    lines = word_hash(data, edges[:-1], edges[1:]) if len(data) else np.zeros(0, U64)
    n_lines = np.diff(lines_at)
    same = np.zeros(len(w), bool)
    if len(w):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row_of[1:] == w.row_of[:-1])
    length = w.end - w.start
    longest = np.zeros(n)
    if len(w):
        np.maximum.at(longest, w.row_of, length)
    dense = np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(n_lines), _ratio(row_sums(length, w.rows), words), np.log1p(longest),
        _ratio(kinds, size[:, None]),
        _ratio(_repeats(w.hash, w.rows), words), _ratio(row_sums(same, w.rows), words), _ratio(_repeats(lines, lines_at), n_lines),
        size == 0, words < 5,
    ])
    grams = np.zeros((n, GRAMS))
    if len(data) > 2:
        x = data.astype(np.uint32)
        h = (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(23)
        whole = row[:-2] == row[2:]
        grams = np.bincount((row[:-2] * GRAMS + h)[whole], minlength=n * GRAMS).reshape(n, GRAMS).astype(float)
        grams = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    return np.column_stack([dense, grams]).astype(np.float32)


#: Text features of either kind: plain ones, kept as floats, and trigram shares, kept as bytes.
PLAIN = 5 + 9 + 3 + 2
TAGS = ("<p", "<a ", "<li", "<script", "<div", "<br", "<h", "<!--")
#: Numbers of a page, in the order of page_numbers.
NUMBERS = 7 + len(TAGS)


def pack(x: np.ndarray) -> list[bytes]:
    """text_features' rows in compact form."""
    plain, grams = x[:, :PLAIN].astype("<f4"), np.round(x[:, PLAIN:] * 255).astype(np.uint8)
    return [a.tobytes() + b.tobytes() for a, b in zip(plain, grams)]


def unpack(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(v.as_py() for v in column), np.uint8).reshape(-1, 4 * PLAIN + GRAMS)
    plain = np.ascontiguousarray(raw[:, : 4 * PLAIN]).view("<f4")
    return np.column_stack([plain, raw[:, 4 * PLAIN :].astype(np.float32) / 255])


def page_rows(pages: DataFrame) -> DataFrame:
    """(doc, names, numbers) of the documents' pages; DataFrame functions only."""
    known = parsed(pages.select("page_id", "url", "html"))
    domain, suffix = levels(F.col("host"))
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    size = F.octet_length(html)
    count = lambda tag: (size - F.octet_length(F.replace(html, F.lit(tag), F.lit("")))) / len(tag)
    share = lambda n: (100 * n / F.greatest(size, F.lit(1))).cast("float")
    text = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style).*?</(script|style)>", ""), "<[^>]*>", "")
    numbers = [F.log1p(size).cast("float"), F.log1p(F.octet_length(text)).cast("float"), share(F.octet_length(text)) / 100, (F.length(F.col("path")) / 20).cast("float"), F.size(F.split("path", "/")).cast("float"), url.contains("?").cast("float"), url.startswith("https").cast("float"), *[share(count(t)) for t in TAGS]]
    names = F.array(F.concat(F.lit("host="), "host"), F.concat(F.lit("domain="), domain), F.concat(F.lit("suffix="), suffix), F.concat(F.lit("part="), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))))
    rows = known.select(document_of(F.col("path")).alias("doc"), "page_id", names.alias("names"), F.array(*numbers).alias("numbers")).where("doc is not null")
    return rows.groupBy("doc").agg(F.min_by(F.struct("names", "numbers"), "page_id").alias("page")).select("doc", "page.names", "page.numbers")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % META


def meta_features(sources: list, langs: list, chars: list, names: list, numbers: list) -> np.ndarray:
    out = np.zeros((len(sources), META + 5 + NUMBERS), np.float32)
    for i, (s, g, c, named, page) in enumerate(zip(sources, langs, chars, names, numbers)):
        for name in (f"source={s}", f"lang={g}", *(named or ())):
            out[i, _slot(name)] = 1
        size = np.log1p(max(c or 0, 0)) / 10
        out[i, META : META + 5] = (c is None, size, size * size, size < 0.4, page is None)
        if page is not None:
            out[i, META + 5 :] = page
    return out


def views(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", source: str = "source", lang: str = "lang", chars: str = "n_chars") -> DataFrame:
    """A stored row a document: id, y (its label or null), t (text features), source, lang, chars, names, numbers."""

    def featured(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, rows=512):
                a, b = offsets[lo], offsets[hi]
                t = text_features(data[a:b], offsets[lo : hi + 1] - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("id", "source", "lang", "chars")), pa.array(pack(t), pa.binary())], names=["id", "source", "lang", "chars", "t"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(chars).cast("long").alias("chars"))
    rows = plain.mapInArrow(lean(featured), "id long, source string, lang string, chars long, t binary")
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(label).cast("int").alias("y"))
    rows = rows.join(one, "id", "left")
    if pages is None:
        rows = rows.withColumns({"names": F.lit(None).cast("array<string>"), "numbers": F.lit(None).cast("array<float>")})
    else:
        rows = rows.join(page_rows(pages).withColumnRenamed("doc", "id"), "id", "left")
    return stored(rows, "views")


def both(batch) -> list[np.ndarray]:
    """The two views' features of rows of views()."""
    return [unpack(batch.column("t")), meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "chars", "names", "numbers")))]


class View:
    """A standardised logistic model of one view, with Platt scaling."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        none = Sparse.of([np.zeros(0, np.int64)] * len(y), 1)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        _, self.w, self.b = logistic(none, self._unit(x), y, l2=1e-3, steps=300, weight=weight)
        self.a, self.c = 1.0, 0.0

    def _unit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return z / np.sqrt(z.shape[1])

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """[label, ...]: for rows of either label their number, the loss's gradient and the curvature of its bound, flat."""
        z = np.column_stack([self._unit(x), np.ones(len(x), np.float32)]).astype(float)
        m = z @ np.append(self.w, self.b)
        p = sigmoid(m)
        # the loss of a row lies below the parabola of this curvature that touches it at m
        bend = np.where(np.abs(m) < 1e-6, 0.25, (p - 0.5) / np.where(m == 0, 1, m))
        out = []
        for label in (0, 1):
            mine = y == label
            a, q, c = z[mine], p[mine], bend[mine]
            out.append(np.concatenate([[len(a)], a.T @ (q - label), ((a.T * c) @ a)[np.triu_indices(z.shape[1])]]))
        return np.stack(out)

    def step(self, sums: np.ndarray, l2: float = 1e-3) -> None:
        """One step, which never raises it, on the balanced loss of all rows that `sums` adds up."""
        d = len(self.w) + 1
        share = 0.5 / np.maximum(sums[:, 0], 1)
        flat = (share[:, None] * sums[:, 1:]).sum(axis=0)
        upper = np.zeros((d, d))
        upper[np.triu_indices(d)] = flat[d:]
        ridge = np.append(np.full(d - 1, l2), 1e-9)
        at = np.append(self.w, self.b)
        move = np.linalg.solve(upper + np.triu(upper, 1).T + np.diag(ridge), flat[:d] + np.append(l2 * self.w, 0))
        self.w, self.b = (at - move)[:-1], float((at - move)[-1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.a * (self._unit(x) @ self.w + self.b) + self.c

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        none = Sparse.of([np.zeros(0, np.int64)] * len(y), 1)
        _, v, c = logistic(none, self.margin(x)[:, None], y, l2=1e-6, steps=500)
        self.a, self.c = float(v[0]), c


class Model:
    def __init__(self, views: list[View], weights: np.ndarray, bias: float, share: float) -> None:
        self.views, self.weights, self.bias, self.share = views, weights, bias, share

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities by view, combined probability)"""
        if not self.views:
            p = np.full((len(xs[0]), 2), self.share)
            return p, p[:, 0]
        m = np.column_stack([v.margin(x) for v, x in zip(self.views, xs)])
        return sigmoid(m), sigmoid(m @ self.weights + self.bias)


def handed(views: list[View], xs: list[np.ndarray]) -> list[np.ndarray]:
    """For either view, sums of the rows that the other view is sure of."""
    out = []
    for v in (0, 1):
        p = sigmoid(views[1 - v].margin(xs[1 - v]))
        sure = (p >= SURE) | (1 - p >= SURE)
        out.append(views[v].sums(xs[v][sure], (p[sure] >= SURE).astype(float)))
    return out


def co_train(xs: list[np.ndarray], y: np.ndarray, ask, fold: np.ndarray, rounds: int = ROUNDS) -> Model:
    """ask(views) gives the sums of handed() over all unlabelled documents."""
    held, fused, trained = fold == 0, fold == 1, fold > 1
    if min(len(set(y[part])) for part in (held, fused, trained)) < 2:
        return Model([], np.zeros(2), 0.0, float(y.mean()) if len(y) else 1.0)
    views = [View(x[trained], y[trained]) for x in xs]
    for _ in range(rounds):
        for v in (0, 1):
            # confidence is only worth handing on once it is calibrated
            views[v].a, views[v].c = 1.0, 0.0
            views[v].calibrate(xs[v][trained], y[trained])
        for view, x, given in zip(views, xs, ask(views)):
            view.step(view.sums(x[trained], y[trained]) + given)
    # calibration and fusion each have rows of their own, of those kept out of training
    for v in (0, 1):
        views[v].a, views[v].c = 1.0, 0.0
        views[v].calibrate(xs[v][held], y[held])
    none = Sparse.of([np.zeros(0, np.int64)] * int(fused.sum()), 1)
    m = np.column_stack([view.margin(x[fused]) for view, x in zip(views, xs)])
    _, w, b = logistic(none, m, y[fused], l2=1e-4, steps=1000)
    return Model(views, w, b, float(y.mean()))


def fit(table: DataFrame, sample: int = SAMPLE) -> Model:
    """Co-train on rows of views()."""
    order = F.xxhash64("id"), "id"
    chosen = [table.where(f"y = {v}").orderBy(*order).limit(sample) for v in (1, 0)]
    got = chosen[0].union(chosen[1]).toArrow()
    ids, y = got.column("id").to_numpy(), got.column("y").to_numpy()
    xs = both(got) if len(y) else [np.zeros((0, 1), np.float32)] * 2
    turn = np.lexsort([xs[0][:, 0], ids]) if len(y) else np.zeros(0, np.int64)
    ids, y, xs = ids[turn], y[turn], [x[turn] for x in xs]
    return co_train(xs, y.astype(float), lambda views: _asked(table, views), folds(ids, 6))


def _asked(table: DataFrame, views: list[View]) -> list[np.ndarray]:
    """The sums of handed() over all unlabelled rows, a flat array cut into PARTS and added up on the executors."""
    sent = table.sparkSession.sparkContext.broadcast(views)
    ddl = "part int, sums binary"

    def add(batches):
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                flat = np.concatenate([g.ravel() for g in handed(sent.value, both(batch.slice(lo, ROWS)))])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in np.array_split(total, PARTS)], pa.binary())], names=["part", "sums"])

    def fold(batches):
        total = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums")):
                got = np.frombuffer(raw.as_py())
                total[part] = total[part] + got if part in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["part", "sums"])

    got = table.where("y is null").mapInArrow(lean(add), ddl).repartition(PARTS, "part").mapInArrow(lean(fold), ddl).collect()
    shapes = [(2, 1 + d + d * (d + 1) // 2) for d in (len(v.w) + 1 for v in views)]
    flat = np.concatenate([np.frombuffer(r.sums) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(sum(a * b for a, b in shapes))
    cut = shapes[0][0] * shapes[0][1]
    return [flat[:cut].reshape(shapes[0]), flat[cut:].reshape(shapes[1])]


def score(table: DataFrame, model: Model, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, p_text, p_meta, quality, keep) of every row of views()."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                p, q = model.scores(both(part))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p[:, 0].astype(float)), pa.array(p[:, 1].astype(float)), pa.array(q.astype(float)), pa.array(q >= threshold if model.views else np.ones(part.num_rows, bool))], names=[key, "p_text", "p_meta", "quality", "keep"])

    return table.mapInArrow(lean(run), f"`{key}` long, p_text double, p_meta double, quality double, keep boolean")


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = views(read("documents"), read("labels"), read("pages"))
    return score(table, fit(table))


QUERIES = {"op7_quality_cotraining": op7_quality_cotraining}
ORACLE_SQL: dict[str, str] = {}
