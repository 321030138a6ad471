"""The classifiers: held-out accuracy, invariances and awkward rows; and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from brookql.llm import language_id, quality, toxicity

FOLDER = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, y int, n long, place int, found string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None), (2, ""), (3, "12 34"), (None, "the thing"), (5, "the thing"), (5, "the thing"), (6, "x" * 300_000), (7, "ñ"), (8, "—…")]
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "z") for i, t in rows], SCHEMA)


def test_language(spark, docs, awkward):
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.limit(500).collect())
    # neither language nor id nor source matters to a prediction
    changed = docs.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source").limit(200)
    same = language_id.predict(changed, model).join(got.select("doc_id", got.lang_pred.alias("l")), "doc_id")
    assert same.where("lang_pred <> l").count() == 0
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(awkward, model).collect()]
    assert {i for i, p, s in rows if p == "und" and s == 0} == {1, 2, 3, 8}
    assert all(0 <= s <= 1 for _, _, s in rows) and len(rows) == awkward.count()
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(awkward, none).collect()} == {"und"}


def test_toxicity(spark, docs, labels, awkward):
    # fitted on even ids, judged on odd ones
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    rows = got.select("toxic", "truth").collect()
    toxic, clean = [r.toxic for r in rows if r.truth == 1], [r.toxic for r in rows if r.truth == 0]
    # some labels are noise, so recall stays below 1
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.005 * len(clean)
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.keep_clean(awkward, blank).count() == awkward.count()
    assert toxicity.score(docs.limit(0), blank).count() == 0


def test_chain_feeds_earlier_probabilities(docs, labels):
    model = toxicity.fit(docs, labels)
    assert [len(v) for _, v, _ in model.chain] == [0, 1]
    # a chain of three in another order
    chain = (("toxic", "toxic", 1), ("good", "quality", 1), ("again", "toxic", 1))
    model = toxicity.fit(docs, labels, categories=chain)
    assert [len(v) for _, v, _ in model.chain] == [0, 1, 2] and model.chain[2][1][0] > 1
    got = toxicity.score(docs.limit(5), model)
    assert got.columns == ["doc_id", "p_toxic", "p_good", "p_again", "toxic"]


def test_features_of_a_fold_are_selected_without_it(spark):
    # a word that only the texts of one fold hold is no feature for the models without that fold
    rows = [(i, f"common w{i % 7}" + (" poison" if i % 2 else ""), i % 2, None) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == bool(y) for i, _, y, _ in rows)
    sizes = {(f, 0, v): 50 for f in range(toxicity.FOLDS) for v in (0, 1)}
    names = ["h", *[f"{v}0_{k}" for v in ("yes", "no") for k in range(toxicity.FOLDS)]]
    counted = spark.createDataFrame([(1, 40, 0, 0, 0, 0, 0, 0, 0, 0, 0), (2, 9, 9, 9, 9, 9, 0, 0, 0, 0, 0)], names)
    h, chosen = toxicity._selected(counted, sizes, 1)
    assert h.tolist() == [1, 2] and chosen[:, 0].tolist() == [False, True, True, True, True, True] and chosen[:, 1].all()


def test_one_label_only(spark, docs):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.limit(20), model).collect()
    assert {(r.p_toxic, r.toxic) for r in rows} == {(1.0, False)}


def test_quality(spark, docs, labels, awkward):
    # fitted on even ids, judged on odd ones
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    table = quality.views(docs, labels.where("doc_id % 2 = 0"), pages)
    assert table.count() == docs.count() and table.where("numbers is not null").count() > 2000
    model = quality.fit(table)
    scored = quality.score(table, model).withColumnRenamed("quality", "p")
    got = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").select("p", "p_text", "p_meta", "keep", "quality").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)
    print("held out: kept good", sum(good) / len(good), "bad", sum(bad) / len(bad), "areas", area([r.p_text for r in got], got), area([r.p_meta for r in got], got), "weights", model.weights)
    rough = quality.views(awkward, labels.limit(0), pages)
    assert quality.score(rough, model).count() == awkward.count()
    blank = quality.fit(rough)
    assert quality.score(rough, blank).where("keep").count() == awkward.count()
    none = quality.views(docs.limit(0), labels, pages)
    assert quality.score(none, quality.fit(none)).count() == 0


def area(scores, rows):
    """Area under the curve of good documents against bad ones."""
    order = np.argsort(np.argsort(scores))
    y = np.array([r.quality for r in rows])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_page_metadata_is_a_view(spark):
    # texts say nothing here; hosts and markup do
    rng = np.random.default_rng(4)
    rows = [(i, f"text {rng.integers(100)} of {rng.integers(100)}", int(rng.integers(2))) for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 800], "doc_id long, quality int")
    page = lambda i, q: (i, f"http://{'good' if q else 'spam'}{i % 3}.example.com/en/{i}", "<p>words</p>" * 3 if q else "<a href='x'>buy</a>" * 9)
    pages = [page(i, q) for i, _, q in rows]

    def right(pages):
        table = quality.views(docs, labels, spark.createDataFrame(pages, "page_id long, url string, html string"))
        got = {r.doc_id: r.quality >= 0.5 for r in quality.score(table, quality.fit(table)).collect()}
        return sum(got[i] == bool(q) for i, _, q in rows if i >= 800) / 400

    assert right(pages) > 0.97
    # the same pages under other documents' ids
    turn = rng.permutation(len(rows))
    assert right([page(i, rows[k][2]) for i, k in enumerate(turn)]) < 0.65


def test_quality_asks_every_unlabelled_document(spark, docs, labels, monkeypatch):
    seen, asked = [], quality._asked

    def count(table, views):
        out = asked(table, views)
        # the sums over all tasks are those of one table of all unlabelled rows
        free = table.where("y is null").toArrow()
        want = quality.handed(views, quality.both(free))
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-3) for a, b in zip(out, want))
        seen.append((free.num_rows, out[1][:, 0].sum()))
        return out

    monkeypatch.setattr(quality, "_asked", count)
    some = labels.where("doc_id % 40 = 0")
    quality.fit(quality.views(docs, some))
    # more than the 4,000 of a former pool and the 400 a round of a former cap
    assert len(seen) == quality.ROUNDS and all(n > 4000 and given > 400 for n, given in seen)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks", "source_mixing"]
    ids = {r.doc_id for r in docs.collect()}
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == docs.columns and {r.doc_id for r in after.collect()} <= ids
        before = after
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) == {*docs.columns, "copy"} and {r.doc_id for r in out.collect()} <= {r.doc_id for r in before.collect()}


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward):
    rows = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SMALL)
            assert set(table.columns) <= set(out.columns)
            out.count()
