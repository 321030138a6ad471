"""The exact operators against brute force, on the smallest tables and on awkward rows."""

import collections
import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from brookql.llm import audio, decontaminate, exchange, jaccard_join, mixing, substring_dedup, suffix_dedup, url_reputation
from brookql.llm.text import SPACED, words_of

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, copy string, n long, bucket string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, near copies, clashing columns."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(80)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (None, " ".join(base)), (7, " ".join(base)), (7, " ".join(base)), (8, " ".join(base[:40] + ["edit"] + base[41:]))]
    rows += [(9 + i, " ".join(base)) for i in range(5)]
    rows += [(30, "x " * 3000 + " ".join(base)), (31, "é" * 400), (32, "É ü " + " ".join(base[10:40]) + "\x00\x1f ü"), (33, "one two"), (34, "ONE  two\n")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) + (" " + " ".join(base[20:50]) if i % 3 == 0 else "")) for i in range(40)]
    rows += [(200 + i, " ".join(rng.choice(base[k : k + 1] * 30 + words[:1]) for k in range(80))) for i in range(12)]
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), k, "c", k, "b") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(i):
    return (i is None, i or 0)


def brute_windows(rows):
    first = {}
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in sorted(split, key=lambda x: order(x[0])):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if order(first[tuple(w[j : j + 13])]) < order(i):
                gone[j : j + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def brute_bytes(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (order(x[0]), x[1] or "")):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for j in range(len(x) - 99):
            if x[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            else:
                seen.add(x[j : j + 100])
        runs = sum(bool(gone[a]) and (a == 0 or not gone[a - 1]) for a in range(len(x)))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def sets(rows, size):
    out = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append((i, frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()))
    return out


def brute_components(rows, size, num, den):
    found = [(i, s) for i, s in sets(rows, size) if i is not None]
    parent = {i: i for i, _ in found}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(found):
        for j, t in found[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in parent}


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(df).collect())
    assert got == brute_windows(pairs(df))


def test_substring_cleaning_keeps_columns(awkward):
    out = substring_dedup.remove_repeats(awkward)
    assert out.columns == awkward.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[12].text == "" and rows[34].text == "ONE  two\n"
    spans = substring_dedup.duplicate_spans(awkward).where("doc_id = 12").collect()
    assert [tuple(s) for s in spans] == [(12, 0, 80, 7, 0)]


def test_factors_end_where_their_reference_does(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, a), (2, ["x"] + b), (3, a[5:25] + b[:20]), (4, ["y", *a[25:], *a[:20], "z"]), (5, a[3:20] + ["n"] * 5 + b[2:30])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    words = dict(rows)
    got = sorted(tuple(r) for r in substring_dedup.duplicate_spans(docs).collect())
    assert got == [(3, 0, 20, 1, 5), (3, 20, 40, 2, 1), (4, 1, 16, 1, 25), (4, 16, 36, 1, 0), (5, 0, 17, 1, 3), (5, 22, 50, 2, 3)]
    assert all(words[i][f:e] == words[r][q : q + e - f] for i, f, e, r, q in got)


def test_rows_without_ids_are_spread(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    text = lambda: " ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + rng.choice([passage, passage[5:25], ["x"] * 3]) + [f"v{rng.randrange(10**6)}" for _ in range(9)])
    rows = [(None, text()) for _ in range(120)] + [(i, text()) for i in range(60)] + [(None, " ".join(f"q{i}" for i in range(20)))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = exchange.blocks(docs, "doc_id", 8, ["text"], spread=True)
    assert dealt.where("doc_id is null").select("part").distinct().count() > 2
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(docs).collect())
    assert got == brute_windows(rows)
    assert all(r.component_id is None for r in jaccard_join.JaccardJoin(docs).documents().where("doc_id is null").collect())


def test_blobs_carry_places_and_large_counts():
    h = np.array([5, 9, 2**63], np.uint64)
    assert exchange.unpack(exchange.pack(h, np.array([1, 300, 70_000])))[1].tolist() == [1, 300, 70_000]
    blob = pa.array([exchange.pack_places(h, np.array([7, 3, 7]), np.array([0, 9, 4]))])
    assert [x.tolist() for x in exchange.unpack_places(blob)] == [h.tolist(), [7, 3, 7], [0, 9, 4]]


def test_regular_words_do_not_collide():
    # sums of powers modulo 2**64 give these two the same hash, whatever the base
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 65, 2048):
        pair = [word[:n], word[:n].translate(str.maketrans("ab", "ba"))]
        (_, _, w), = words_of(pa.array(pair), SPACED, False)
        assert len(set(w.hash.tolist())) == 2


def test_zero_bytes_and_common_anchors(spark):
    rng = random.Random(3)
    filler = lambda: "".join(rng.choice("abcdefgh") for _ in range(90))
    core = "".join(rng.choice("xyz") for _ in range(110))
    rows = [(i, filler() + core[: 60 + i % 50] + filler() + core) for i in range(60)] + [(100 + i, core[:70] + "\0" * i + core[:99] + "\0" * 130) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in suffix_dedup.digest(docs).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("table,hot", [("small", 2000), ("awkward", 2000), ("awkward", 2)])
def test_suffix_dedup(request, table, hot):
    df = request.getfixturevalue(table)
    got = collections.Counter(tuple(r) for r in suffix_dedup.digest(df, hot=hot).collect())
    assert got == brute_bytes(pairs(df))


def test_loser_tree_never_disorders():
    rng = random.Random(1)
    width = 40
    runs, whole = [], []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randrange(0, 30)))
        whole += strings
        mat = np.array([list(s) for s in strings], np.uint8).reshape(-1, width)
        size = np.full(len(strings), width)
        zero = np.zeros(len(strings), np.int64)
        fields = suffix_dedup.decode_run(suffix_dedup.encode_run(mat, size, np.zeros(0, np.uint8), zero, zero, zero))
        runs.append(suffix_dedup.Run(fields[0], fields[1], fields[5]))
    out, last = [], None
    for r, _, shared in suffix_dedup.merge(runs):
        head = runs[r].head
        if last is not None:
            assert shared == next((k for k in range(width) if head[k] != last[k]), width)
        out.append(head)
        last = head
    assert out == sorted(whole)


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_jaccard_join(request, table):
    df = request.getfixturevalue(table)
    rows = pairs(df)
    got = jaccard_join.JaccardJoin(df).documents().collect()
    want = brute_components(rows, 4, 85, 100)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(s)) for i, s in sets(rows, 4))
    assert all(r.component_id == want.get(r.doc_id) for r in got)


def test_keep_one(awkward):
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = brute_components(pairs(awkward), 5, 80, 100)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, _ in pairs(awkward) if i is None or want[i] == i)


def test_an_id_on_different_texts_links_them(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(7, a), (7, b), (8, a[:59] + ["z"]), (3, b), (7, ["lone"]), (9, [f"c{i}" for i in range(9)]), (11, b[1:]), (12, ["lone"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.JaccardJoin(docs).documents().collect()}
    assert got == {7: 3, 8: 3, 3: 3, 9: 9, 11: 3, 12: 3} == {**brute_components_of_rows(pairs(docs))}
    kept = jaccard_join.keep_one(docs, size=4, num=85)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]


def brute_components_of_rows(rows):
    """Components where an id's rows are one document."""
    found = [(i, s) for i, s in sets(rows, 4)]
    name = {i: i for i, _ in found}
    for _ in found:
        for i, s in found:
            for j, t in found:
                if i == j or 100 * len(s & t) >= 85 * len(s | t):
                    name[i] = name[j] = min(name[i], name[j])
    return name


def brute_leaks(rows, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    out = []
    for i, t in rows:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    hit[j : j + k] = [True] * k
                    found |= own
        h = sum(hit)
        out.append((i, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return collections.Counter(out)


@pytest.mark.parametrize("table", ["small", "awkward"])
def test_decontamination(spark, request, table):
    df = request.getfixturevalue(table)
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "one two"), (901, None), (902, ""), (903, "é"), (None, "ü")], "item_id long, text string"))
    words = {r.item_id: r.text for r in items.collect() if r.item_id is not None}
    got = decontaminate.search(decontaminate.build_index(df), items.where("item_id is not null"))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_leaks(pairs(df), words.items())
    # several batches of phrases give the same
    again = decontaminate.search(decontaminate.build_index(df), items.where("item_id is not null"), limit=500)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, got.collect()))


def test_phrase_batches_are_bounded_and_taken_in_turn(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60))
    items = spark.createDataFrame([(i, text()) for i in range(200)], "item_id long, text string")
    size = sum(len(r.text) for r in items.collect())
    n, turns = decontaminate.phrase_batches(items, "item_id", "text", 13, limit=size // 6)
    assert n >= 6
    seen = 0
    for sent in turns:
        assert len(sent.value.names) < 80
        seen += len(sent.value.names)
    assert seen == 200


def test_clean_judges_rows_not_ids(spark):
    leak = " ".join(f"q{i}" for i in range(20))
    rows = [(None, leak), (None, "a clean text"), (None, None), (5, leak), (5, "another clean text"), (6, "w " * 30), (7, "x " * 500 + leak)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, leak), (2, "other words")], "item_id long, text string")
    assert sorted(r.n for r in decontaminate.clean(docs, items).collect()) == [1, 2, 4, 5]
    assert sorted(r.n for r in decontaminate.clean(docs, items, limit=30).collect()) == [1, 2, 4, 5]
    judged = decontaminate.search(decontaminate.build_index(docs.drop("doc_id").withColumnRenamed("n", "doc_id").selectExpr("cast(doc_id as long) doc_id", "text")), items)
    assert sorted(r.doc_id for r in judged.where("not contaminated").collect()) == [1, 2, 4, 5, 6]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha"), (4, "alpha x y z beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in decontaminate.search(decontaminate.build_index(docs), items, slop=slop).where("n_items > 0").collect()}
    assert hit(0) == {1} and hit(1) == {1, 2}


def test_audio(awkward):
    rows = {(r.doc_id, r.n_bytes): r for r in audio.digest(audio.features(audio.store(awkward))).collect()}
    for i, t in pairs(awkward):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.media_sha256 == hashlib.sha256(audio.encode_wav(payload)).hexdigest() and r.media_bytes == len(payload) + 44
    assert rows[7, rows_size(awkward, 7)].feature == rows[9, rows_size(awkward, 9)].feature
    # media and features as they come back from Parquet
    one = exchange.stored(audio.features(exchange.stored(audio.store(awkward.where("doc_id in (30, 31)")), "media")), "features").toArrow().sort_by("doc_id")
    assert audio.decode_wav(one.column("media")[0].as_py())[0].rstrip(b"\0") == awkward.where("doc_id = 30").collect()[0].text.encode()
    tensors = audio.tensors(one.column("tensor"))
    assert tensors.type.shape == [audio.BINS, audio.BANDS] and tensors.to_numpy_ndarray().shape == (2, audio.BINS, audio.BANDS)
    assert all(s["start"].as_py() < s["end"].as_py() for s in one.column("spans")[0].values)


def test_audio_features_against_brute_force(awkward):
    """Every step in plain loops: resampling as a convolution, a Fourier sum, mel triangles, a state machine."""
    rows = {r.doc_id: r for r in audio.features(audio.store(awkward.where("doc_id in (1, 4, 31)"))).collect()}
    taps = [float(h) for h in audio.filter_branches(1, 2, audio.TAPS)[0]]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    marks = np.linspace(0, mel(audio.RATE / 4), audio.BANDS + 2)
    hz = [700 * (10 ** (m / 2595) - 1) for m in marks]
    for r in rows.values():
        x = [(b - 128) / 128 for b in bytes(r.media)[44:]]
        n = (len(x) + audio.TAPS - 1 + 1) // 2
        y = [sum(taps[k] * x[2 * o - k] for k in range(audio.TAPS) if 0 <= 2 * o - k < len(x)) for o in range(n)]
        frames = max(1, -(-(n - audio.FRAME) // audio.HOP) + 1)
        y += [0.0] * (frames * audio.HOP + audio.FRAME)
        logs, energy = [], []
        for f in range(frames):
            part = [y[f * audio.HOP + t] * (0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME)) for t in range(audio.FRAME)]
            t = np.arange(audio.FRAME)
            power = [abs(np.sum(np.array(part) * np.exp(-2j * np.pi * k * t / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
            bank = []
            for b in range(audio.BANDS):
                total = 0.0
                for k, p in enumerate(power):
                    freq = k * audio.RATE / 2 / audio.FRAME
                    total += p * max(0.0, min((freq - hz[b]) / (hz[b + 1] - hz[b]), (hz[b + 2] - freq) / (hz[b + 2] - hz[b + 1])))
                bank.append(np.log(total + 1e-6))
            logs.append(bank)
            energy.append(np.log(sum(p * p for p in part) + 1e-6))
        want = np.zeros((audio.BINS, audio.BANDS))
        for bin_ in range(audio.BINS):
            mine = [logs[f] for f in range(frames) if f * audio.BINS // frames == bin_]
            if mine:
                want[bin_] = np.mean(mine, axis=0)
        assert np.allclose(audio.read_tensor(bytes(r.tensor)), want, atol=1e-4)
        low, high = np.quantile(energy, [0.35, 0.65])
        spans, on = [], False
        for f in range(frames + 1):
            now = f < frames and (energy[f] >= high or (on and energy[f] >= low))
            if now and not on:
                spans.append([f, None])
            if on and not now:
                spans[-1][1] = f
            on = now
        assert np.allclose([(s.start, s.end) for s in r.spans], np.array(spans) * audio.HOP * 2 / audio.RATE)


def test_audio_rejects_other_files():
    with pytest.raises(ValueError):
        audio.decode_wav(b"RIFFxxxx")


@pytest.mark.parametrize("size", [64, 448, 512, 576, 704, 768, 1024, 4096])
def test_audio_features_reach_the_last_bytes(size):
    rng = random.Random(size)
    text = bytes(rng.randrange(97, 123) for _ in range(size))
    marks = lambda x: np.round(audio.clip_features(x)[0].astype(float) * 64).tolist()
    assert marks(text) != marks(text[:-16] + b"A " * 8)
    n = -(-(size + audio.TAPS - 1) * audio.UP // audio.DOWN)
    assert (audio.n_frames(size) - 1) * audio.HOP + audio.FRAME >= n > (audio.n_frames(size) - 2) * audio.HOP + audio.FRAME or audio.n_frames(size) == 1


def rows_size(df, i):
    return len(df.where(f"doc_id = {i}").collect()[0].text.encode())


def test_resampling_in_blocks_and_ratios():
    x = (np.arange(5000) * 37 % 251).astype(np.uint8)
    whole = audio.resample(x, 0, 2500)
    assert np.allclose(whole, np.concatenate([audio.resample(x, a, 250) for a in range(0, 2500, 250)]))
    up = audio.filter_branches(3, 2, 24)
    y = audio.resample(np.full(400, 192, np.uint8), 100, 300, 3, 2, up)
    assert np.allclose(y, 0.5, atol=0.01)


def test_mixing(spark, awkward, small):
    out = mixing.mix(awkward, {"s1": 3.0, None: 0.0})
    assert "copy_in" in out.columns and out.where("source is null").count() == 0
    same = lambda df: sorted(map(str, df.collect()))
    assert same(out) == same(mixing.mix(awkward.repartition(7), {"s1": 3.0, None: 0.0}))
    n = 20_000
    many = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 2 = 0, 'b', 'c')) as source")
    counts = {r.source: r["count"] for r in mixing.mix(many, {"a": 1, "b": 2, "c": 1}, total=40_000).groupBy("source").count().collect()}
    assert abs(counts["b"] - 20_000) < 600 and abs(counts["a"] - 10_000) < 500
    plan = mixing.mix(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rate", [0.3, 2000.0, 1e6])
def test_tables_of_small_and_large_rates(spark, rate):
    row = mixing.poisson_tables(spark.createDataFrame([("a", rate)], "source string, rate double")).collect()[0]
    assert abs(row.cdf[-1] - 1) < 1e-7 and len(row.cdf) < 50 + 25 * max(rate, 4) ** 0.5
    assert abs(row.lo + sum(x < 0.5 for x in row.cdf) - rate) <= 1 + 0.01 * rate**0.5


def test_tiny_source_at_a_huge_rate_and_clashing_names(spark):
    docs = spark.range(30_001).selectExpr("id as doc_id", "if(id = 0, 'tiny', 'big') as source", "1 as copy", "2 as copy_in")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "copy_in_in", "copy_in", "copy"]
    tiny = out.where("source = 'tiny'").count()
    assert abs(tiny - 15_000) < 1_000


def test_url_edges(spark):
    urls = [None, "", "nohost", "http://A.Example.NET/en/x?q", "http://example.com/de/1#a", "ftp://x.org/fr/2", "http://net", "http://net/", "http://b.org:80/en/3", "x://y://z/en"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in range(3)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.com/de/", "block") and got[5].rule == "org/fr/"
    assert (got[6].rule, got[7].rule) == (None, "net/") and got[8].host == "b.org:80" and (got[9].host, got[9].path) == ("y:", "//z/en")
    assert url_reputation.judge(pages.limit(0), labels.limit(0)).count() == 0


def test_rules_by_table_as_by_expression(spark):
    rules = (*url_reputation.RULES, ("en.net/a", "allow"), ("net/aa.bb", "block"), ("x.net/aaa", "allow"), ("x.net/aaa", "block"), ("com/", "allow"), ("lone/", "block"))
    urls = [None, "", "x", "http://a.example.net/en/x", "http://x.net/aaa", "http://en.net/aa.bb", "http://net/aa.bb/c", "http://net", "http://b.com/", "http://com/?x", "http://lone/", "http://alone/", "http://a..net/", "http://x.net:80/aaa"]
    pages = url_reputation.parsed(spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string"))
    rows = lambda df: sorted(map(str, df.select("page_id", "host", "path", "rule", "ruling").collect()))
    assert rows(url_reputation.ruled(pages, rules)) == rows(url_reputation.ruled(pages, rules, limit=0))


def test_prior_levels(spark):
    hosts = {"a.b.example.com:80": ("example.com", "com"), "www.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "local": ("local", "local")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.levels(df.host)
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


@pytest.mark.parametrize("name", ["op1_source_mixing", "op2_suffix_array_dedup", "op4_substring_dedup", "op6_url_reputation", "op9_benchmark_decontamination", "op10_ngram_jaccard_join"])
def test_sql(spark, name):
    from brookql.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE_SQL[name]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(pd.notna(df[sorted(df.columns)]), None).values.tolist()), key=str)
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (substring_dedup.digest(none), substring_dedup.remove_repeats(none), suffix_dedup.digest(none), jaccard_join.JaccardJoin(none).documents(), jaccard_join.keep_one(none), decontaminate.search(decontaminate.build_index(none), items), audio.digest(audio.features(audio.store(none))), mixing.mix(none)):
        assert df.count() == 0
    assert decontaminate.clean(awkward, items).count() == awkward.count()
