"""Sinks by action name, and the options that shape their rows.

Shaping (fields, excludeFields, sendNilField, dataTemplate, sendSingle) is done in the
plan; delivery is a distributed write, or a call a partition for endpoints.
"""

from __future__ import annotations

import json
import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookql.functions.values import CompileError
from brookql.sources.brokers import SINKS
from brookql.sources.template import render

LOG = logging.getLogger("brookql.sink")
ENDPOINTS = ("mqtt", "websocket", "redis", "rabbitmq", "zmq", "edgex", "influx", "influx2", "tdengine", "iotdb", "modbus", "opcua", "otlp", "image")
#: Delivery functions of endpoint sinks, f(iterator of payload texts, props); see register_endpoint.
_DELIVER: dict = dict(SINKS)


def register_endpoint(kind: str, deliver) -> None:
    """Set how a kind of endpoint delivers a partition's payloads."""
    _DELIVER[kind] = deliver


def shaped(df: DataFrame, props: dict) -> DataFrame:
    """The rows' public columns, those listed or not excluded, in name order."""
    field = props.get("dataField")
    if field and field in df.columns:
        df = df.select(f"`{field}`.*") if df.schema[field].dataType.typeName() == "struct" else df.select(field)
    columns = [c for c in df.columns if not c.startswith("__")]
    if props.get("fields"):
        columns = [c for c in props["fields"] if c in columns]
    columns = [c for c in columns if c not in props.get("excludeFields", ())]
    return df.select(*[F.col(f"`{c}`") for c in sorted(columns)])


def payloads(df: DataFrame, props: dict) -> DataFrame:
    """One text a row, column `value`: a template's, or JSON without nulls unless sendNilField."""
    rows = shaped(df, props)
    template = props.get("dataTemplate")
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": str(not (props.get("sendNilField") or template)).lower()})
    if not template:
        out = rows.select(body.alias("value"))
    else:
        single = props.get("sendSingle", True)

        def run(batches):
            for pdf in batches:
                yield pdf.assign(value=[render(template, json.loads(v) if single else [json.loads(v)]) for v in pdf["value"]])

        out = rows.select(body.alias("value")).mapInPandas(run, "value string")
    return out


def line_protocol(df: DataFrame, measurement: str, tags: list[str], time: str | None = None) -> DataFrame:
    """Rows as line protocol: measurement,tag=v field=v time; nulls are left out, whole numbers marked with i."""
    esc = lambda c: F.regexp_replace(c.cast("string"), r"([,= ])", r"\\$1")
    tag = F.concat_ws(",", *[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}="), esc(F.col(t)))) for t in sorted(tags)])
    parts = []
    for f in sorted(df.schema, key=lambda f: f.name):
        if f.name in tags or f.name == time:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        value = F.concat(c.cast("string"), F.lit("i")) if kind in ("long", "integer", "short", "byte") else c.cast("string") if kind in ("double", "float", "boolean") else F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{f.name}="), value)))
    head = F.when(tag != "", F.concat(F.lit(measurement + ","), tag)).otherwise(F.lit(measurement))
    body = F.concat_ws(",", *parts)
    line = F.concat_ws(" ", head, body, *([F.col(time).cast("string")] if time else []))
    return df.where(body != "").select(line.alias("value"))


def write(engine, df: DataFrame, kind: str, props: dict | None = None) -> None:
    """Carry out one action on a batch of rows."""
    props = props or {}
    mode = "append" if props.get("append") else props.get("mode", "overwrite")
    if kind == "nop":
        df.write.format("noop").mode("overwrite").save()
    elif kind == "log":
        # a log is for people: it shows at most logRows rows
        for row in payloads(df, props).take(int(props.get("logRows", 100))):
            LOG.info("%s", row["value"])
    elif kind == "memory":
        shaped(df, props).createOrReplaceTempView(props["topic"].replace("/", "_"))
    elif kind == "file":
        how = str(props.get("fileType", "json")).lower()
        props, df = _rolled(props, df)
        if how == "parquet":
            shaped(df, props).write.mode(mode).parquet(props["path"])
        elif how in ("csv", "delimited"):
            shaped(df, props).write.mode(mode).options(header=str(props.get("hasHeader", False)).lower(), sep=props.get("delimiter", ",")).csv(props["path"])
        else:
            payloads(df, props).write.mode(mode).text(props["path"])
    elif kind == "sql":
        shaped(df, props).write.format("jdbc").options(url=props["url"], dbtable=props["table"], batchsize=str(props.get("batchSize", 1000))).mode("append").save()
    elif kind == "kafka":
        payloads(df, props).write.format("kafka").options(**{"kafka.bootstrap.servers": props["brokers"], "topic": props["topic"]}).save()
    elif kind in ("rest", "http"):
        payloads(df, props).foreachPartition(_poster(props))
    elif kind in ENDPOINTS:
        deliver = _DELIVER.get(kind)
        if deliver is None:
            raise CompileError(f"no delivery is registered for {kind} sinks")
        if kind.startswith("influx"):
            rows = line_protocol(shaped(df, props), props.get("measurement", "measurement"), list(props.get("tags", ())), props.get("tsFieldName"))
        else:
            rows = payloads(df, props)
        rows.foreachPartition(lambda part: deliver((r["value"] for r in part), props))
    else:
        raise CompileError(f"unknown action {kind}")


def _rolled(props: dict, df: DataFrame) -> tuple[dict, DataFrame]:
    """File options and rows for rolling: a file holds at most rollingCount rows; a folder takes what is written within rollingInterval milliseconds."""
    if n := int(props.get("rollingCount", 0)):
        df.sparkSession.conf.set("spark.sql.files.maxRecordsPerFile", n)
    else:
        df.sparkSession.conf.unset("spark.sql.files.maxRecordsPerFile")
    if ms := int(props.get("rollingInterval", 0)):
        begun = int(time.time() * 1000) // ms * ms
        props = props | {"path": f"{props['path'].rstrip('/')}/{begun}"}
    return props, df


def _poster(props: dict):
    tries, wait = 1 + int(props.get("retryCount", 3)), float(props.get("retryInterval", 100)) / 1000

    def post(rows) -> None:
        import urllib.error
        import urllib.request

        size, batch = int(props.get("batchSize", 1)), []

        def send() -> None:
            body = batch[0] if size <= 1 else "[" + ",".join(batch) + "]"
            request = urllib.request.Request(props["url"], body.encode(), {"Content-Type": "application/json"} | props.get("headers", {}), method=props.get("method", "POST").upper())
            for k in range(tries):
                try:
                    urllib.request.urlopen(request, timeout=float(props.get("timeout", 5000)) / 1000).close()
                    return
                except OSError as e:
                    # a refusal is final; a busy or failing server is asked again, each time later
                    if k == tries - 1 or isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429:
                        raise
                    time.sleep(wait * 2**k)

        for r in rows:
            batch.append(r["value"])
            if len(batch) >= max(1, size):
                send()
                batch.clear()
        if batch:
            send()

    return post
