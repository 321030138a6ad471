"""Every pipeline stage against brute force on its own input, and the classifiers' scores in plain loops."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_exact import brute_components, brute_leaks, order, pairs

import corpus_pipeline
from brookql.llm import exchange, language_id, mixing, quality, toxicity
from brookql.llm.text import SPACED, word_hash

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before and after each stage, as run() writes them."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = exchange.stored(stage(spark, docs, SMALL), name)
        out[name] = docs, after
        docs = after
    return out


def rows(df):
    return collections.Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_toxicity_stage_drops_what_the_chain_rejects(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(before, model).where("toxic").collect()}
    assert rows(after) == collections.Counter({r: n for r, n in rows(before).items() if r[0] not in bad})


def test_near_duplicates_stage(steps):
    before, after = steps["near_duplicates"]
    name = brute_components(pairs(before), 5, 80, 100)
    assert rows(after) == collections.Counter({r: n for r, n in rows(before).items() if name[r[0]] == r[0]})


def test_repeated_passages_stage(steps):
    before, after = steps["repeated_passages"]
    first, want = {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in pairs(before)}
    for i in sorted(split, key=order):
        for j in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][j : j + 13]), i)
    for i, t in pairs(before):
        gone = set()
        for j in range(len(split[i]) - 12):
            if first[tuple(split[i][j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want[i] = " ".join(w for k, w in enumerate(split[i]) if k not in gone) if gone else t
    assert {i: t for i, t in pairs(after)} == want
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)


def test_benchmark_leaks_stage(spark, steps):
    before, after = steps["benchmark_leaks"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {r[0] for r in brute_leaks(pairs(before), items) if r[2]}
    assert rows(after) == collections.Counter({r: n for r, n in rows(before).items() if r[0] not in leaks})
    # a planted passage is dropped, in a text of any length
    planted = spark.createDataFrame([(10**6 + k, "word " * k + items[0][1], "en", "src1", 9) for k in (0, 100, 20_000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[3][1](spark, planted, SMALL).count() == 0


def test_source_mixing_stage(steps):
    before, after = steps["source_mixing"]
    con = duckdb.connect()
    con.register("stage", before.toArrow())
    want = con.execute(mixing.mixing_sql("stage", "doc_id", mixing.WEIGHTS)).fetchall()
    assert collections.Counter((r.doc_id, r.copy) for r in after.collect()) == collections.Counter(want)


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def one_hash(text: bytes) -> int:
    return int(word_hash(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0])


def test_toxicity_scores_in_plain_loops(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels)
    number = {int(h): k for k, h in enumerate(model.vocabulary)}
    texts = dict(pairs(docs))
    for r in toxicity.score(docs, model).limit(60).collect():
        found = set()
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", (texts[r.doc_id] or "").encode().lower()):
            found.add(number.get(one_hash(word)))
            for n in toxicity.STEMS:
                if len(word) > n:
                    found.add(number.get(one_hash(word[:n]) ^ 0x5851F42D4C957F2D))
        done = []
        for u, v, b in model.chain:
            done.append(sigmoid(sum(u[k] for k in found if k is not None) + sum(x * y for x, y in zip(done, v)) + b))
        assert (r.p_low_quality, r.p_toxic) == (pytest.approx(done[0], rel=1e-6), pytest.approx(done[1], rel=1e-6))
        assert r.toxic == (done[1] >= model.threshold)


def test_language_votes_in_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(docs)
    texts = dict(pairs(docs))

    def vote(duels, x):
        wins, least = [0] * len(duels.names), [1.0] * len(duels.names)
        for d, (i, j) in enumerate(duels.pairs):
            margin = sum(a * b for a, b in zip(x, duels.w[:, d])) + duels.b[d]
            wins[i if margin >= 0 else j] += 1
            p = sigmoid(4 * margin)
            least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
        best = max(range(len(wins)), key=lambda k: (wins[k] + least[k] / 2, -k))
        return best, least[best] if duels.pairs else 1.0

    for r in language_id.predict(docs, model).limit(25).collect():
        raw = (texts[r.doc_id] or "").encode()
        folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
        x = [0.0] * language_id.WIDTH
        for size in (1, 2, 3):
            for at in range(len(folded) - size + 1):
                gram = 0
                for b in folded[at : at + size]:
                    gram = gram * 256 + b
                x[((gram * 2654435761 + size * 977) % 2**32) >> 21] += 1
        x = [math.sqrt(c) for c in x]
        norm = math.sqrt(sum(c * c for c in x)) or 1.0
        x = [c / norm for c in x]
        if r.lang_pred == "und":
            assert not re.search(r"[^\W\d_]", texts[r.doc_id] or "")
            continue
        f, sure = vote(model.families, x)
        won, p = vote(model.within[f], x)
        assert r.lang_pred == model.within[f].names[won] and r.score == pytest.approx(sure * p, rel=1e-6)


def test_quality_scores_in_plain_loops(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    table = quality.views(docs, labels, pages)
    model = quality.fit(table)
    if not model.views:
        pytest.skip("too few labels")
    by_id, of_page = {r.doc_id: r for r in docs.collect()}, {r.doc: r for r in quality.page_rows(pages).collect()}
    for r in quality.score(table, model).limit(30).collect():
        d, page = by_id[r.doc_id], of_page.get(r.doc_id)
        raw = np.frombuffer((d.text or "").encode(), np.uint8)
        views = [quality.text_features(raw, np.array([0, len(raw)]))[0], quality.meta_features([d.source], [d.lang], [d.n_chars], [page and page.names], [page and page.numbers])[0]]
        views[0][quality.PLAIN :] = np.round(views[0][quality.PLAIN :] * 255) / 255
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw.tobytes().lower())
        assert views[0][:2] == pytest.approx([math.log1p(len(raw)), math.log1p(len(words))], rel=1e-5)
        margins = []
        for view, x in zip(model.views, views):
            z = [max(-5.0, min(5.0, (float(a) - m) / s)) / math.sqrt(len(x)) for a, m, s in zip(x, view.mean, view.scale)]
            margins.append(view.a * (sum(a * w for a, w in zip(z, view.w)) + view.b) + view.c)
        want = sigmoid(sum(m * w for m, w in zip(margins, model.weights)) + model.bias)
        assert r.p_text == pytest.approx(sigmoid(margins[0]), rel=1e-3, abs=1e-4) and r.quality == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_blocks_hold_like_bytes_and_few_blobs(spark):
    # the last tenth of the ids has most of the text
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', if(id < 3600, 5, 400)) as text")
    dealt = exchange.blocks(docs, "doc_id", 16, ["text"])
    size = [r.b for r in dealt.groupBy("part").sum().selectExpr("1 as b").collect()]
    weight = [r.b for r in dealt.selectExpr("part", "octet_length(text) + 64 as b").groupBy("part").sum("b").toDF("part", "b").collect()]
    assert 8 <= len(size) <= 16 and max(weight) < 4 * sum(weight) / 16
    for parts in (4, 16, 64):
        h = np.sort(np.random.default_rng(parts).integers(0, 2**63, 1000).astype(np.uint64))
        told = exchange.announce(0, h, None, parts)
        assert told.num_rows <= parts and np.array_equal(np.concatenate([exchange.unpack(b.as_py())[0] for b in told.column("blob")]), h)


def test_words_of_a_column_that_starts_late():
    from brookql.llm.text import words_of

    column = pa.array(["skipped", "é one", None, "two"]).slice(1)
    ((lo, hi, w),) = words_of(column, SPACED, False)
    assert (lo, hi) == (0, 3) and np.diff(w.rows).tolist() == [2, 0, 1] and int(w.hash[2]) == one_hash(b"two")
