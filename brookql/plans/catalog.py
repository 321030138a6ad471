"""Streams, tables and types: definitions to DataFrames in the engine's data model.

Times are epoch milliseconds, as in the dialect; every source carries `__ts` (its event
time) and `__seq` (a tie-break, so that all order-dependent results are defined).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import CompileError, Val, as_double, as_long, as_millis, as_string
from brookql.plans import ast as A
from brookql.plans.expressions import quoted
from brookql.plans.parser import parse_definition

#: DDL type names.
TYPES = {
    **dict.fromkeys(("bigint", "int", "integer", "smallint", "tinyint"), "bigint"),
    **dict.fromkeys(("float", "double", "real", "decimal", "numeric"), "double"),
    **dict.fromkeys(("string", "text", "varchar", "char"), "string"),
    **dict.fromkeys(("boolean", "bool"), "boolean"),
    **dict.fromkeys(("datetime", "timestamp", "date", "time"), "datetime"),
    **dict.fromkeys(("bytea", "binary", "blob"), "bytea"),
    **dict.fromkeys(("json", "object", "map"), "json"),
}
TIME_NAMES = ("timestamp", "ts", "event_time", "time")


def spark_type(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(spark_type(name[6:-1]))
    if name.startswith("struct<"):
        fields, depth, part = [], 0, ""
        for ch in name[7:-1] + ",":
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                if part:
                    n, _, t = part.partition(":")
                    fields.append(T.StructField(n, spark_type(t)))
                part = ""
            else:
                part += ch
        return T.StructType(fields)
    if name == "array":
        return T.ArrayType(T.StringType())
    if name == "struct":
        return T.VariantType()
    kind = TYPES.get(name)
    if kind is None:
        raise CompileError(f"unknown type {name!r}")
    return {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "datetime": T.LongType(), "bytea": T.StringType(), "json": T.VariantType()}[kind]


def coerced(v: Val, name: str):
    """v as a column of a DDL type; what cannot be read as one becomes null."""
    kind = TYPES.get(name)
    if kind == "bigint":
        return as_long(v) if not v.is_number or v.is_int else F.when(v.c < 0, F.ceil(v.c)).otherwise(F.floor(v.c)).cast("long")
    if kind == "double":
        return as_double(v)
    if kind in ("string", "bytea"):
        return as_string(v)
    if kind == "boolean":
        if v.is_bool:
            return v.c
        if v.is_number:
            n = as_double(v)
            return F.when(n == 1, True).when(n == 0, False)
        s = F.lower(as_string(v))
        return F.when(s.isin("true", "1", "t"), True).when(s.isin("false", "0", "f"), False)
    if kind == "datetime":
        return as_millis(v)
    if name.startswith("array<") and v.is_array:
        inner = name[6:-1]
        return F.transform(v.c, lambda x: coerced(Val(x, v.t.elementType), inner))
    return v.c


@dataclass
class Source:
    """A stream or table: a DataFrame and its definition."""

    name: str
    df: DataFrame
    columns: list[A.ColumnDef] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    table: bool = False
    order: tuple[str, ...] = ()

    def coerce(self, strict: bool = False) -> tuple[DataFrame, list]:
        """The DataFrame with declared columns coerced, and error columns if strict."""
        df, errors = self.df, []
        if not self.columns:
            return df, errors
        have = {c.lower(): c for c in df.columns}
        out = []
        for d in self.columns:
            src = have.pop(d.name.lower(), None)
            if src is None:
                c = F.lit(None).cast(spark_type(d.type))
            else:
                v = Val(quoted(src), df.schema[src].dataType)
                c = coerced(v, d.type)
                if strict:
                    errors.append(F.when(v.c.isNotNull() & c.isNull(), F.lit(f"column {d.name} does not fit {d.type}")))
            if d.default is not None:
                c = F.coalesce(c, F.lit(d.default).cast(spark_type(d.type)))
            if strict and d.required:
                errors.append(F.when(c.isNull(), F.lit(f"column {d.name} is required")))
            out.append(c.alias(d.name))
        # undeclared columns stay
        out += [quoted(c) for c in have.values()]
        if errors:
            # judged on the values as they came
            out.append(F.coalesce(*errors).alias("__bad"))
        return df.select(*out), [F.col("__bad")] if errors else []

    def frame(self, strict: bool = False) -> tuple[DataFrame, list]:
        """Coerced rows with times in milliseconds, __ts and __seq, and the rows' error columns."""
        df, errors = self.coerce(strict)
        if self.table and (key := self.options.get("KEY") or self.options.get("PRIMARY_KEY")):
            latest = Window.partitionBy(*[k.strip() for k in key.split(",")]).orderBy(F.desc("__seq"))
            df = df.withColumn("__seq", self._seq(df)).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
        elif self.table and (keep := self.options.get("RETAIN_SIZE")):
            df = df.withColumn("__seq", self._seq(df)).orderBy(F.desc("__seq")).limit(int(keep))
        # every other column in one step: each step is another analysis of the plan
        schema, more = df.schema, {}
        if "__seq" not in schema.names:
            more["__seq"] = self._seq(df)
        times = (T.TimestampType, T.TimestampNTZType, T.DateType)
        for f in schema:
            if isinstance(f.dataType, times):
                more[f.name] = F.unix_millis(quoted(f.name).cast("timestamp"))
        stamp = self.options.get("TIMESTAMP") or next((c for c in TIME_NAMES if c in schema.names), None)
        more["__ts"] = F.lit(0).cast("long") if stamp is None else more[stamp] if stamp in more else as_millis(Val(quoted(stamp), schema[stamp].dataType))
        return df.withColumns(more), errors

    def _seq(self, df: DataFrame):
        if not self.order:
            # a stream's rows of equal time have no order unless one is given
            return F.lit(0).cast("long") if df.isStreaming else F.monotonically_increasing_id()
        if len(self.order) == 1 and isinstance(df.schema[self.order[0]].dataType, T.IntegralType):
            return quoted(self.order[0]).cast("long")
        return F.struct(*[quoted(c) for c in self.order])


class Catalog:
    """The named streams and tables of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.sources: dict[str, Source] = {}

    def define(self, ddl: str, df: DataFrame | None = None, order: tuple[str, ...] = (), stream: bool = False) -> Source:
        """CREATE STREAM or CREATE TABLE; without df the definition's own source is opened, with stream as a streaming one."""
        d = parse_definition(ddl)
        if d.name in self.sources:
            raise CompileError(f"{d.name} exists already")
        for c in d.columns:
            spark_type(c.type)
        if df is None:
            from brookql.sources.readers import open_source

            df = open_source(self.spark, d, stream)
        self.sources[d.name] = Source(d.name, df, d.columns, d.options, d.table, order)
        return self.sources[d.name]

    def register(self, name: str, df: DataFrame, order: tuple[str, ...] = (), table: bool = False, **options: str) -> Source:
        """Name a DataFrame as a stream or table."""
        self.sources[name] = Source(name, df, [], {k.upper(): v for k, v in options.items()}, table, order)
        return self.sources[name]

    def drop(self, name: str) -> None:
        if self.sources.pop(name, None) is None:
            raise CompileError(f"unknown source {name}")

    def names(self, table: bool | None = None) -> list[str]:
        return sorted(n for n, s in self.sources.items() if table is None or s.table == table)

    def describe(self, name: str) -> T.StructType:
        return self[name].coerce()[0].schema

    def __getitem__(self, name: str) -> Source:
        if name not in self.sources:
            raise CompileError(f"unknown source {name}")
        return self.sources[name]
