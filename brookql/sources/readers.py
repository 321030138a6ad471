"""Sources by TYPE, and payload formats.

File, memory, simulator, SQL and landing-directory sources are read by Spark itself.
`kafka` uses Spark's own connector where its jar is present. Opened as streams, MQTT,
Redis, WebSocket, ZeroMQ and HTTP sources are landed by a bridge of this library
(bridge.py), in the folder LANDED or one in spark.checkpoint.dir; read in batch, they are
what has landed so far. Other brokers' messages are read from the directory that a bridge
of their own writes as text (`LANDING`).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import CompileError
from brookql.plans import ast as A
from brookql.sources import bridge
from brookql.sources.brokers import LIVE
from brookql.sources.protobuf import from_protobuf

BROKERS = ("mqtt", "edgex", "rabbitmq", "amqp", "redissub", "zmq", "zeromq", "websocket", "httppush", "httppull", "modbus", "opcua", "otlp")


def payload_schema(d: A.Definition) -> T.StructType | None:
    """The declared columns as a reader schema, everything that is coerced later as text."""
    from brookql.plans.catalog import spark_type

    if not d.columns:
        return None
    return T.StructType([T.StructField(c.name, t if isinstance(t := spark_type(c.type), T.ArrayType | T.StructType) else T.StringType()) for c in d.columns])


def _each(rows: DataFrame, array: str, rest: list[str]) -> DataFrame:
    """A row for each struct in the array, and its place after the payload's own where that has one."""
    if "__seq" not in rest:
        return rows.select(F.explode(array).alias("__r"), *rest)
    others = [c for c in rest if c != "__seq"]
    return rows.select(F.posexplode(array).alias("__at", "__r"), *rest).select("__r", *others, F.struct("__seq", "__at").alias("__seq"))


def decode(raw: DataFrame, d: A.Definition, column: str = "value") -> DataFrame:
    """Payload texts in `column` to rows, by the definition's FORMAT."""
    how = d.options.get("FORMAT", "JSON").upper()
    rest = [c for c in raw.columns if c != column]
    if how == "JSON":
        schema = payload_schema(d)
        if schema is None:
            return raw.select(F.try_parse_json(F.col(column).cast("string")).alias("self"), *rest)
        # a payload is an object or an array of objects
        text = F.col(column).cast("string")
        rows = raw.withColumn("__p", F.from_json(F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), T.ArrayType(schema)))
        return _each(rows, "__p", rest).where("__r is not null").select("__r.*", *rest)
    if how == "DELIMITED":
        sep = d.options.get("DELIMITER", ",")
        parts = F.split(F.col(column).cast("string"), "\\Q" + sep + "\\E")
        names = [c.name for c in d.columns] or [f"col{i}" for i in range(int(d.options.get("WIDTH", 1)))]
        return raw.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], *rest)
    if how == "BINARY":
        text = F.col(column).cast("string")
        return raw.select(F.when(F.is_valid_utf8(text), text).otherwise(F.base64(F.col(column).cast("binary"))).alias("self"), *rest)
    if how == "EDGEX":
        reading = "struct<resourceName:string,valueType:string,value:string,origin:bigint>"
        rows = raw.withColumn("__e", F.from_json(F.col(column).cast("string"), f"struct<event:struct<deviceName:string,profileName:string,origin:bigint,readings:array<{reading}>>>"))
        rows = rows.select(F.col("__e.event.deviceName").alias("deviceName"), F.col("__e.event.readings").alias("__p"), *rest)
        return _each(rows, "__p", ["deviceName", *rest]).select("deviceName", "__r.*", *rest)
    if how == "PROTOBUF":
        # the payload is base64 where it comes as text; SCHEMA names a definition file's path, MESSAGE the message
        text = "\n".join(r.value for r in raw.sparkSession.read.text(d.options["SCHEMA"], wholetext=True).collect())
        payload = F.col(column) if raw.schema[column].dataType.typeName() == "binary" else F.try_to_binary(F.col(column), F.lit("base64"))
        return raw.select(from_protobuf(payload, text, d.options["MESSAGE"]).alias("__p"), *rest).where("__p is not null").select("__p.*", *rest)
    raise CompileError(f"format {how} is not supported here")


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_POINTS = f"struct<dataPoints:array<struct<asDouble:double,asInt:string,count:string,sum:double,min:double,max:double,timeUnixNano:string,startTimeUnixNano:string,attributes:{_ATTRIBUTES}>>>"
#: Of an OTLP JSON export: what its resources, scopes and records are called, and what a record holds.
OTLP = {
    "metric": ("resourceMetrics", "scopeMetrics", "metrics", f"struct<name:string,unit:string,gauge:{_POINTS},sum:{_POINTS},histogram:{_POINTS}>"),
    "log": ("resourceLogs", "scopeLogs", "logRecords", f"struct<severityText:string,severityNumber:bigint,body:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>,traceId:string,spanId:string,timeUnixNano:string,observedTimeUnixNano:string,attributes:{_ATTRIBUTES}>"),
    "span": ("resourceSpans", "scopeSpans", "spans", f"struct<name:string,traceId:string,spanId:string,parentSpanId:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRIBUTES}>"),
}


def _any_value(v):
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def _attributes(a):
    return F.map_from_entries(F.transform(F.coalesce(a, F.array().cast(_ATTRIBUTES)), lambda x: F.struct(x["key"], _any_value(x["value"]))))


def otlp(raw: DataFrame, column: str = "value") -> DataFrame:
    """OTLP JSON exports of metrics, logs and traces as flat rows; `signal` says which, other signals' columns are null."""
    parts = []
    for signal, (resources, scopes, records, record) in OTLP.items():
        schema = f"struct<{resources}:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,{scopes}:array<struct<{records}:array<{record}>>>>>>"
        r = raw.select(F.from_json(F.col(column).cast("string"), schema).alias("x")).select(F.explode(f"x.{resources}").alias("r"))
        r = r.select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.{scopes}").alias("s")).select("resource", F.explode(f"s.{records}").alias("d"))
        common = [F.lit(signal).alias("signal"), "resource"]
        if signal == "metric":
            kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"d.{k}.dataPoints").alias("points")) for k in ("gauge", "sum", "histogram")])
            r = r.withColumn("k", F.explode(kinds)).withColumn("p", F.explode("k.points"))
            histogram = F.col("k.type") == "histogram"
            value = F.when(histogram, F.coalesce("p.sum", F.lit(0.0))).otherwise(F.coalesce("p.asDouble", F.col("p.asInt").cast("double")))
            count = F.when(histogram, F.coalesce(F.col("p.count").cast("long"), F.lit(0)))
            parts.append(r.select(*common, F.coalesce("d.name", F.lit("unknown")).alias("name"), "k.type", F.coalesce("d.unit", F.lit("")).alias("unit"), value.alias("value"), count.alias("count"), "p.min", "p.max", F.coalesce("p.timeUnixNano", "p.startTimeUnixNano").cast("long").alias("timestamp_unix_nano"), _attributes(F.col("p.attributes")).alias("attributes")))
        elif signal == "log":
            parts.append(r.select(*common, F.coalesce("d.severityText", F.lit("INFO")).alias("severity_text"), F.coalesce("d.severityNumber", F.lit(9)).alias("severity_number"), _any_value(F.col("d.body")).alias("body"), F.coalesce("d.traceId", F.lit("")).alias("trace_id"), F.coalesce("d.spanId", F.lit("")).alias("span_id"), F.coalesce("d.timeUnixNano", "d.observedTimeUnixNano").cast("long").alias("timestamp_unix_nano"), _attributes(F.col("d.attributes")).alias("attributes")))
        else:
            start, end = F.col("d.startTimeUnixNano").cast("long"), F.col("d.endTimeUnixNano").cast("long")
            parts.append(r.select(*common, F.coalesce("d.name", F.lit("unknown")).alias("name"), F.coalesce("d.traceId", F.lit("")).alias("trace_id"), F.coalesce("d.spanId", F.lit("")).alias("span_id"), F.coalesce("d.parentSpanId", F.lit("")).alias("parent_span_id"), F.greatest(end - start, F.lit(0)).alias("duration_ns"), F.coalesce("d.status.code", "d.status.message").alias("status_code"), start.alias("timestamp_unix_nano"), _attributes(F.col("d.attributes")).alias("attributes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _sql(spark: SparkSession, d: A.Definition) -> DataFrame:
    """A database table: rows beyond INDEX_VALUE of INDEX_FIELD, asked of the database, read in parts if PARTITION_FIELD's bounds are given."""
    o = d.options
    table = o.get("TABLE", d.options.get("DATASOURCE", ""))
    if "INDEX_FIELD" in o and "INDEX_VALUE" in o:
        value = o["INDEX_VALUE"]
        literal = value if o.get("INDEX_TYPE", "").lower() in ("bigint", "int", "float", "double") else "'" + value.replace("'", "''") + "'"
        table = f"(SELECT * FROM {table} WHERE {o['INDEX_FIELD']} > {literal}) AS polled"
    options = {"url": o["URL"], "dbtable": table, "fetchsize": o.get("FETCH_SIZE", "10000")}
    if "PARTITION_FIELD" in o:
        options |= {"partitionColumn": o["PARTITION_FIELD"], "lowerBound": o["LOWER_BOUND"], "upperBound": o["UPPER_BOUND"], "numPartitions": o.get("PARTITIONS", "8")}
    if "DRIVER" in o:
        options["driver"] = o["DRIVER"]
    return spark.read.format("jdbc").options(**options).load()


def _simulated(spark: SparkSession, d: A.Definition, rows: list, stream: bool) -> DataFrame:
    """The rows of DATA once; as a stream, one after the other for ever, a row every INTERVAL (1,000) milliseconds."""
    texts = [json.dumps(r) for r in rows]
    if not stream:
        return decode(spark.createDataFrame([(t,) for t in texts], "value string"), d) if d.columns else spark.read.json(spark.createDataFrame([(t,) for t in texts], "value string").rdd.map(lambda r: r.value))
    if not d.columns:
        raise CompileError("a simulator that streams declares its columns")
    interval = max(1, int(d.options.get("INTERVAL", "1000")))
    ticks = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=max(1, 1000 // interval), advanceMillisPerBatch=max(interval, 1000)).load()
    turn = F.get(F.array(*[F.lit(t) for t in texts]), F.pmod("value", F.lit(len(texts))).cast("int"))
    return decode(ticks.select(turn.alias("value")), d)


def _landed(spark: SparkSession, d: A.Definition, kind: str, stream: bool) -> DataFrame:
    """A broker's messages in the folder of its bridge, which a stream starts."""
    folder = d.options.get("LANDED")
    if folder is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise CompileError(f"a {kind} source needs LANDED, LANDING or spark.checkpoint.dir")
        folder = f"{shared.rstrip('/')}/landed/{d.name}"
    if stream:
        bridge.bridge(spark, kind, d.options, folder)
    elif not bridge.exists(spark, folder):
        raise CompileError(f"nothing has landed in {folder}")
    raw = (spark.readStream if stream else spark.read).schema(bridge.SCHEMA).parquet(folder)
    return decode(raw.select("value", F.col("place").alias("__seq")), d)


def open_source(spark: SparkSession, d: A.Definition, stream: bool = False) -> DataFrame:
    """The definition's source as a DataFrame, or as a streaming one."""
    kind = d.options.get("TYPE", "mqtt").lower()
    path = d.options.get("DATASOURCE", "")
    reader = spark.readStream if stream else spark.read
    if kind == "otlp" and "LANDING" in d.options:
        return otlp(reader.text(d.options["LANDING"], wholetext=d.options.get("WHOLE", "false").lower() == "true"))
    if kind in BROKERS and "LANDING" in d.options:
        return decode(reader.text(d.options["LANDING"]), d)
    if kind in LIVE:
        return _landed(spark, d, kind, stream)
    if kind == "file":
        how = d.options.get("FILETYPE", d.options.get("FORMAT", "json")).lower()
        if how == "parquet":
            if stream:
                reader = reader.schema(spark.read.parquet(path).schema)
            return reader.parquet(path)
        if how in ("csv", "delimited"):
            schema = payload_schema(d)
            options = {"header": d.options.get("HASHEADER", "false"), "sep": d.options.get("DELIMITER", ",")}
            return (reader.schema(schema) if schema else reader).options(**options).csv(path)
        if how == "lines":
            return reader.text(path).withColumnRenamed("value", "self")
        # JSON lines: declared columns are read as written, so that numbers keep their kind
        return decode(reader.text(path), d)
    if kind == "memory":
        return reader.table(path) if stream else spark.table(path)
    if kind in ("simulator", "random"):
        return _simulated(spark, d, json.loads(d.options.get("DATA", "[]")), stream)
    if kind == "sql":
        return _sql(spark, d)
    if kind == "kafka":
        options = {"kafka.bootstrap.servers": d.options.get("BROKERS", "localhost:9092"), "subscribe": path, "startingOffsets": "earliest"}
        return decode(reader.format("kafka").options(**options).load().select("value"), d)
    if kind == "video":
        return spark.read.format("binaryFile").load(path)
    raise CompileError(f"a {kind} source needs its LANDING directory here")
