import json

import pytest

from brookql.functions.values import CompileError
from brookql.rules import Rule, graph_sql
from brookql.session import Engine
from brookql.sources.template import render
from brookql.sources.writers import line_protocol, payloads


def test_schema_coercion_and_defaults(spark, tmp_path):
    e = Engine(spark)
    frame = spark.createDataFrame([("7", "x", 1, 3), ("8", "2", None, 4)], "ID string, v string, f int, extra int")
    e.register("raw", frame)
    e.define("CREATE STREAM t (id BIGINT, v BIGINT DEFAULT 5, f BOOLEAN)", frame)
    assert sorted(tuple(r) for r in e.sql("SELECT id, v, f, extra FROM t").collect()) == [(7, 5, True, 3), (8, 2, None, 4)]
    strict = e.plan("SELECT id FROM t", strict_schema=True)
    assert [r.id for r in strict.rows.collect()] == [8] and "v" in strict.errors[0].collect()[0].error


def test_table_keeps_last_row_of_a_key(spark):
    e = Engine(spark)
    e.define('CREATE TABLE t (k BIGINT, v TEXT) WITH (KEY="k")', spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "k long, v string, n int"), order=("n",))
    e.register("s", spark.createDataFrame([(1,), (2,), (3,)], "k long"))
    assert sorted(map(tuple, e.sql("SELECT s.k, t.v FROM s INNER JOIN t ON s.k = t.k").collect())) == [(1, "b"), (2, "c")]


def test_formats(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1;a\n2;b\n")
    e = Engine(spark)
    e.define(f'CREATE STREAM d (n BIGINT, s TEXT) WITH (TYPE="mqtt", LANDING="{tmp_path}/d.txt", FORMAT="DELIMITED", DELIMITER=";")')
    assert sorted(map(tuple, e.sql("SELECT n + 1 AS n, s FROM d").collect())) == [(2, "a"), (3, "b")]
    with pytest.raises(CompileError):
        e.define('CREATE STREAM x () WITH (TYPE="mqtt", DATASOURCE="t")')
    e.define("""CREATE STREAM sim (a BIGINT) WITH (TYPE="simulator", DATA='[{"a": 1}, {"a": 2}]')""")
    assert sorted(r.a for r in e.sql("SELECT a FROM sim").collect()) == [1, 2]


def test_templates():
    row = {"a": 1, "b": "x", "l": [{"n": 1}, {"n": 2}]}
    assert render('{{.a}}-{{upper .b}}-{{.b | printf "%s!"}}', row) == "1-X-x!"
    assert render("{{if gt .a 0}}yes{{else}}no{{end}}", row) == "yes"
    assert render("{{range .l}}<{{.n}}>{{end}}{{json .l}}", row) == '<1><2>[{"n":1},{"n":2}]'
    assert render('{{default "z" .missing}}{{add (mul .a 3) 4}}', row) == "z7"


def test_payloads_and_lines(spark):
    df = spark.createDataFrame([(1, None, "x y")], "b long, a double, t string")
    assert [r.value for r in payloads(df, {}).collect()] == ['{"b":1,"t":"x y"}']
    assert [r.value for r in payloads(df, {"sendNilField": True, "excludeFields": ["t"]}).collect()] == ['{"a":null,"b":1}']
    assert [r.value for r in payloads(df, {"dataTemplate": "v={{.b}}"}).collect()] == ["v=1"]
    assert [r.value for r in line_protocol(df, "m", ["t"]).collect()] == ["m,t=x\\ y b=1i"]


def test_graph_rule(spark, tmp_path):
    graph = {
        "nodes": {"in": {"type": "source", "nodeType": "memory", "props": {"sourceName": "s"}}, "f": {"type": "operator", "nodeType": "filter", "props": {"expr": "v > 1"}}, "p": {"type": "operator", "nodeType": "pick", "props": {"fields": ["v"]}}, "w": {"type": "operator", "nodeType": "window", "props": {"type": "countwindow", "size": 2}}, "out": {"type": "sink", "nodeType": "file", "props": {"path": str(tmp_path / "out")}}},
        "topo": {"sources": ["in"], "edges": {"in": ["f"], "f": ["p"], "p": ["out"]}},
    }
    text, actions = graph_sql(graph)
    assert text == "SELECT v FROM s WHERE (v > 1) GROUP BY COUNTWINDOW(2)" and list(actions[0]) == ["file"]
    del graph["nodes"]["w"]
    e = Engine(spark)
    e.register("s", spark.createDataFrame([(1,), (2,), (3,)], "v long"))
    Rule("r", graph=graph).run(e)
    assert sorted(json.loads(r.value)["v"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [2, 3]
    graph["topo"]["edges"]["p"] = ["f"]
    with pytest.raises(CompileError):
        graph_sql(graph)


def test_user_functions_and_keyed_state(spark):
    from pyspark.sql import functions as F

    e = Engine(spark, keyed_state={"limit": "5"})
    e.register("s", spark.createDataFrame([(4,), (6,)], "v long"))
    e.function("twice", F.udf(lambda x: x * 2, "long"))
    e.function("m.thrice", F.udf(lambda x: x * 3, "long"))
    got = e.sql("SELECT twice(v) AS a, wasm_run('m', 'thrice', v) AS b FROM s WHERE v > get_keyed_state('limit', 'bigint', 0)").collect()
    assert [tuple(r) for r in got] == [(12, 18)]


def test_protobuf(spark, tmp_path):
    import base64
    import struct

    from brookql.sources.protobuf import Schema

    text = 'syntax = "proto3";\n// a reading\nmessage Reading { message Tag { string k = 1; } int64 id = 1; double v = 2; repeated sint32 d = 3 [packed=true]; Tag tag = 4; bool ok = 5; }'
    tag = b"\x0a\x01x"
    raw = b"\x08\x96\x01" + b"\x11" + struct.pack("<d", 2.5) + b"\x1a\x03\x01\x02\x03" + b"\x22" + bytes([len(tag)]) + tag
    assert Schema(text).decode("Reading", raw) == {"id": 150, "v": 2.5, "d": [-1, 1, -2], "tag": {"k": "x"}, "ok": False}
    (tmp_path / "r.proto").write_text(text)
    (tmp_path / "in.txt").write_text(base64.b64encode(raw).decode() + "\n!!\n" + base64.b64encode(raw[:5]).decode() + "\n")
    e = Engine(spark)
    e.define(f'CREATE STREAM p () WITH (TYPE="mqtt", LANDING="{tmp_path}/in.txt", FORMAT="PROTOBUF", SCHEMA="{tmp_path}/r.proto", MESSAGE="Reading")')
    assert [tuple(r) for r in e.sql("SELECT id, v, d[0] AS d, tag.k AS k FROM p").collect()] == [(150, 2.5, -1, "x")]


def test_error_policies(spark, tmp_path):
    e = Engine(spark)
    e.register("s", spark.createDataFrame([(0,), (2,)], "v long"))
    text = "SELECT 4 / v AS x FROM s"
    with pytest.raises(RuntimeError, match="divided by zero"):
        Rule("r", text, options={"onError": "halt"}).run(e)
    plan = Rule("r", text, actions=[{"nop": {}}], options={"onError": "dlq", "dlqPath": str(tmp_path / "dlq")}).run(e)
    assert [r.x for r in plan.rows.collect()] == [2.0]
    assert json.loads(spark.read.text(str(tmp_path / "dlq")).collect()[0].value)["row"] == '{"v":0}'


def test_otlp_metrics_logs_and_traces(spark, tmp_path):
    attrs = [{"key": "host", "value": {"stringValue": "a"}}, {"key": "n", "value": {"intValue": "3"}}]
    point = {"timeUnixNano": "17", "attributes": attrs}
    export = [
        {"resourceMetrics": [{"resource": {"attributes": attrs}, "scopeMetrics": [{"metrics": [{"name": "m", "unit": "s", "gauge": {"dataPoints": [point | {"asDouble": 1.5}]}}, {"name": "h", "histogram": {"dataPoints": [point | {"count": "4", "sum": 9.0, "min": 1, "max": 5}]}}, {"sum": {"dataPoints": [point | {"asInt": "7"}]}}]}]}]},
        {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"stringValue": "hi"}, "timeUnixNano": "5"}]}]}]},
        {"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "op", "traceId": "t", "startTimeUnixNano": "10", "endTimeUnixNano": "25", "status": {"code": 1}}]}]}]},
    ]
    (tmp_path / "o.txt").write_text("\n".join(json.dumps(e) for e in export))
    e = Engine(spark)
    e.define(f'CREATE STREAM o () WITH (TYPE="otlp", LANDING="{tmp_path}/o.txt")')
    rows = e.sql("SELECT signal, name, type, value, count, severity_text, body, duration_ns, timestamp_unix_nano AS t FROM o").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("metric", "m", "gauge", 1.5, None, None, None, None, 17), ("metric", "h", "histogram", 9.0, 4, None, None, None, 17), ("metric", "unknown", "sum", 7.0, None, None, None, None, 17), ("log", None, None, None, None, "INFO", "hi", None, 5), ("span", "op", None, None, None, None, None, 15, 10)], key=str
    )
    assert {r.host for r in e.sql("SELECT attributes['host'] AS host FROM o WHERE signal = 'metric'").collect()} == {"a"}


def test_files_by_definition(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    spark.createDataFrame([(1, "p")], "id long, v string").write.parquet(f"{tmp_path}/a.parquet")
    e = Engine(spark)
    e.define(f'CREATE STREAM c (id BIGINT, v TEXT) WITH (TYPE="file", DATASOURCE="{tmp_path}/a.csv", FILETYPE="csv", HASHEADER="true")')
    e.define(f'CREATE STREAM l () WITH (TYPE="file", DATASOURCE="{tmp_path}/a.txt", FILETYPE="lines")')
    e.define(f'CREATE STREAM p (id BIGINT, v TEXT) WITH (TYPE="file", DATASOURCE="{tmp_path}/a.parquet", FILETYPE="parquet")')
    assert sorted(map(tuple, e.sql("SELECT * FROM c").collect())) == [(1, "x"), (2, "y")]
    assert sorted(r.self for r in e.sql("SELECT self FROM l").collect()) == ["one", "two"]
    assert [tuple(r) for r in e.sql("SELECT id, v FROM p").collect()] == [(1, "p")]


def test_simulator_streams(spark, tmp_path):
    from brookql.plans.parser import parse_definition
    from brookql.sources.readers import open_source

    d = parse_definition("""CREATE STREAM sim (a BIGINT, b TEXT) WITH (TYPE="simulator", INTERVAL="100", DATA='[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')""")
    query = open_source(spark, d, stream=True).writeStream.format("memory").queryName("sims").option("checkpointLocation", str(tmp_path)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(200):
            if spark.table("sims").count() >= 20:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    rows = [tuple(r) for r in spark.table("sims").collect()]
    assert set(rows) == {("1", "x"), ("2", "y")} or set(rows) == {(1, "x"), (2, "y")}


def test_rolling_files_and_retries(spark, tmp_path):
    import http.server
    import threading

    from brookql.sources.writers import write

    df = spark.range(10).coalesce(1).withColumnRenamed("id", "a")
    write(None, df, "file", {"path": f"{tmp_path}/r", "rollingCount": 3, "rollingInterval": 3_600_000})
    files = list((tmp_path / "r").glob("*/part-*"))
    assert len(files) == 4 and sum(len(f.read_text().splitlines()) for f in files) == 10
    write(None, df, "file", {"path": f"{tmp_path}/one"})
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    got, fail = [], [2]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if fail[0]:
                fail[0] -= 1
                self.send_response(503)
            else:
                got.append(json.loads(body))
                self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        write(None, df.limit(3), "rest", {"url": f"http://127.0.0.1:{server.server_port}/", "retryInterval": 5})
    finally:
        server.shutdown()
    assert sorted(r["a"] for r in got) == [0, 1, 2]


def test_database_rows_beyond_the_index(spark, monkeypatch):
    from brookql.plans.parser import parse_definition
    from brookql.sources import readers

    asked = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **o):
            asked.update(o)
            return self

        def load(self):
            return "rows"

    class Session:
        read = Reader()

    d = parse_definition("""CREATE STREAM q (id BIGINT) WITH (TYPE="sql", URL="jdbc:x", TABLE="t", INDEX_FIELD="id", INDEX_VALUE="41", INDEX_TYPE="bigint", PARTITION_FIELD="id", LOWER_BOUND="0", UPPER_BOUND="100", PARTITIONS="4")""")
    assert readers.open_source(Session(), d) == "rows"
    assert asked["dbtable"] == "(SELECT * FROM t WHERE id > 41) AS polled" and (asked["partitionColumn"], asked["numPartitions"]) == ("id", "4")


def test_streams_without_times_are_cut_by_their_order(spark):
    from brookql.operators.ordering import Ordered

    e = Engine(spark)
    e.register("s", spark.range(1000).selectExpr("id", "id % 7 as v"), ("id",))
    assert Ordered(e.catalog["s"].frame()[0]).df.select("__block").distinct().count() > 1
    assert sorted(map(tuple, e.sql("SELECT id, acc_sum(v) OVER () AS s, lag(id) OVER () AS l FROM s").collect()))[:4] == [(0, 0, None), (1, 1, 0), (2, 3, 1), (3, 6, 2)]
    assert e.sql("SELECT count(*) AS c, min(id) AS i FROM s GROUP BY COUNTWINDOW(300)").where("c = 300").count() == 3
