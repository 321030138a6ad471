"""Every registered query against its DuckDB SQL, on the smallest tables."""

import base64
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from brookql import queries
from brookql.session import Engine

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.7g}"
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_filters_reach_the_scan(spark, capsys):
    queries.QUERIES["filter_project"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(value,20.0)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_compression_reads_every_id(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2_000_000_000, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.g, r.z, r.s) for r in queries.QUERIES["fn_compression"](spark, str(tmp_path)).collect()} == {(1, "a", "a", "a"), (2_000_000_000, "b", "b", "b")}


def test_no_statement_reads_a_part_of_its_table():
    for name, (text, sql) in queries.Q.items():
        for t in (text, sql or ""):
            assert not re.search(r"\b(event_id|doc_id|vec_id) < \d|[^_]substr\(text", t), name


def test_hashes_of_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.QUERIES["fn_hashes_of_texts"](spark, FOLDER).collect():
        raw = texts[r.doc_id].encode()
        assert (r.a, r.b, int(r.c, 16)) == (hashlib.sha384(raw).hexdigest(), hashlib.sha512(raw).hexdigest(), zlib.crc32(raw))
        assert zlib.decompress(base64.b64decode(r.z)) == raw


def test_lookups_keep_rows_that_look_alike(spark):
    e = Engine(spark)
    e.register("s", spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 0)], "id long, v long"), timestamp="id", order=("id",))
    e.register("t", spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, name string"), ("k",), True)
    rows = lambda text: sorted((r.id, r.name or "") for r in e.sql(text).collect())
    assert rows("SELECT s.id, t.name FROM s INNER JOIN t ON t.k < s.v") == [(1, "a")] * 3
    assert rows("SELECT s.id, t.name FROM s LEFT JOIN t ON t.k < s.v") == [(1, "a")] * 3 + [(2, "")]
    assert rows("SELECT s.id, t.name FROM s INNER JOIN t") == [(1, "a")] * 3 + [(2, "a")]


def test_lookups_by_an_order_pair_no_rows(spark):
    inf, nan = float("inf"), float("nan")
    seen = [0.0, -0.0, 1.0, 1.0, 2.5, -3.0, inf, -inf, nan, None]
    offered = [2.0, nan, 1.0, -0.0, inf, None, 2.5, -inf, -3.0, 7.0]
    above = lambda x: (x != x, 0.0 if x != x else x)  # noqa: E731  NaN is above all numbers
    holds = {"<": lambda a, b: above(a) < above(b), "<=": lambda a, b: above(a) <= above(b), ">": lambda a, b: above(a) > above(b), ">=": lambda a, b: above(a) >= above(b)}
    whole = lambda vs: [None if v is None or v != v else max(-(1 << 63), min((1 << 63) - 1, int(v))) if abs(v) < inf else -(1 << 63) if v < 0 else (1 << 63) - 1 for v in vs]
    for cast, kind in ((list, "double"), (whole, "long")):
        ys, xs = cast(seen), cast(offered)
        e = Engine(spark)
        e.register("s", spark.createDataFrame(list(enumerate(ys)), f"id long, v {kind}"), ("id",))
        # the table's order is neither that of its rows nor of its values
        e.register("t", spark.createDataFrame([(9 - k, x, k % 4 > 0) for k, x in enumerate(xs)], f"k long, x {kind}, ok boolean"), ("k",), True)
        table = [(k, x) for k, x, ok in sorted((9 - k, x, k % 4 > 0) for k, x in enumerate(xs)) if ok and x is not None]
        for op, f in holds.items():
            first = [(i, -1 if i == 2 or y is None else next((k for k, x in table if f(y, x)), -1)) for i, y in enumerate(ys)]
            mirrored = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
            kept, on = ("LEFT", f"s.v {op} t.x AND t.ok AND s.id != 2") if kind == "double" else ("INNER", f"s.id != 2 AND t.ok AND t.x {mirrored} s.v")
            df = e.sql(f"SELECT s.id, t.k FROM s {kept} JOIN t ON {on}")
            plan = df._jdf.queryExecution().toString()
            assert sorted((r.id, -1 if r.k is None else r.k) for r in df.collect()) == [x for x in first if kept == "LEFT" or x[1] >= 0]
            assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sliding_windows_against_a_walk(spark, capsys):
    for seed in range(4):
        rng = random.Random(seed)
        size, big = rng.choice([1, 5, 40]), (1 << 63) - 1
        events = [(i, rng.choice([None, *range(-60, 60)]), rng.choice([None, big, -big, 1, 7]), rng.choice([None, 0.5, -2.25, 8.0]), rng.choice("abc"), rng.random() < 0.5) for i in range(rng.choice([1, 60, 200]))]
        want = {}
        for i, t, *_, on in events:
            inside = [r for r in events if t is not None and r[1] is not None and t - size <= r[1] and (r[1], r[0]) <= (t, i)]
            if on and t is not None:
                n, x = [r[2] for r in inside if r[2] is not None], [r[3] for r in inside if r[3] is not None]
                total = sum(n) if n and -(1 << 63) <= sum(n) <= big else None
                want[i] = (t, len(inside), len(n), total, min(x, default=None), max(r[4] for r in inside), sum(x) if x else None, sum(x) / len(x) if x else None)
        e = Engine(spark)
        e.register("s", spark.createDataFrame(events, "id long, ts long, n long, x double, k string, go boolean"), ("id",), timestamp="ts")
        df = e.sql(f"SELECT max(id) AS last, window_end() AS we, count(*) AS c, count(n) AS cn, sum(n) AS s, min(x) AS lo, max(k) AS hi, sum(x) AS sx, avg(x) AS ax FROM s GROUP BY SLIDINGWINDOW(ms, {size}) OVER (WHEN go)")
        got = sorted((tuple(r)[1:] for r in df.collect()), key=str)
        assert got == sorted(want.values(), key=str)
        df.explain()
        # a frame with two ends is read anew for each row
        assert "RangeFrame" not in (plan := capsys.readouterr().out) and "unboundedpreceding" in plan


def test_sessions_against_a_walk(spark):
    for seed in range(6):
        rng = random.Random(seed)
        longest, gap, t, times = rng.choice([1, 7, 50]), rng.choice([0, 1, 4]), 0, []
        for _ in range(rng.choice([1, 40, 300])):
            t += rng.randrange(0, 4)
            times.append(t)
        want, start, before = {}, None, None
        for t in times:
            if start is None or t - before > gap or t - start >= longest:
                start = t
            want[start] = (want.get(start, (0,))[0] + 1, t + gap)
            before = t
        e = Engine(spark)
        e.register("s", spark.createDataFrame(list(enumerate(times)), "id long, ts long"), ("id",), timestamp="ts")
        got = e.sql(f"SELECT window_start() AS ws, window_end() AS we, count(*) AS c FROM s GROUP BY SESSIONWINDOW(ms, {longest}, {gap})").collect()
        assert {r.ws: (r.c, r.we) for r in got} == want
