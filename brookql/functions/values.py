"""Compiled values and the function registry.

A compiled expression is a Column with its Spark type.  The dialect is dynamically
typed with row errors; here types are known when a query is compiled, and an
expression that can fail adds an error column (a message or null) to the compilation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class CompileError(ValueError):
    """A query that the dialect rejects."""


@dataclass
class Val:
    """A column, its type, and whether it can be null (raw: its form where null means false)."""

    c: Column
    t: T.DataType
    nullable: bool = True
    raw: Column | None = None
    #: the value of a literal
    lit: object = None

    @property
    def is_null(self) -> bool:
        return isinstance(self.t, T.NullType)

    @property
    def is_int(self) -> bool:
        return isinstance(self.t, INTS)

    @property
    def is_number(self) -> bool:
        return isinstance(self.t, NUMBERS)

    @property
    def is_string(self) -> bool:
        return isinstance(self.t, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.t, T.BooleanType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.t, T.ArrayType)

    @property
    def is_object(self) -> bool:
        return isinstance(self.t, T.MapType | T.StructType)

    @property
    def is_variant(self) -> bool:
        return isinstance(self.t, T.VariantType)


LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
VARIANT = T.VariantType()


def long(c: Column, nullable: bool = True) -> Val:
    return Val(c, LONG, nullable)


def double(c: Column) -> Val:
    return Val(c, DOUBLE)


def string(c: Column) -> Val:
    return Val(c, STRING)


def boolean(c: Column, nullable: bool = True, raw: Column | None = None) -> Val:
    return Val(c, BOOL, nullable, raw)


def null() -> Val:
    return Val(F.lit(None), NULL)


# -- coercions ------------------------------------------------------------------


def as_double(v: Val) -> Column:
    if isinstance(v.t, T.DoubleType):
        return v.c
    if v.is_number:
        return v.c.cast("double")
    if v.is_string:
        return v.c.try_cast("double")
    if v.is_bool:
        return v.c.cast("int").cast("double")
    if v.is_variant:
        return v.c.try_cast("double")
    return F.lit(None).cast("double")


def as_long(v: Val) -> Column:
    if isinstance(v.t, T.LongType):
        return v.c
    if v.is_int:
        return v.c.cast("long")
    if v.is_number:
        return v.c.try_cast("long")
    if v.is_string:
        return F.coalesce(v.c.try_cast("long"), v.c.try_cast("double").try_cast("long"))
    if v.is_bool:
        return v.c.cast("int").cast("long")
    if v.is_variant:
        return v.c.try_cast("long")
    return F.lit(None).cast("long")


def as_string(v: Val) -> Column:
    if v.is_string:
        return v.c
    if v.is_null:
        return F.lit(None).cast("string")
    if isinstance(v.t, T.BinaryType):
        return F.base64(v.c)
    if v.is_variant:
        return F.coalesce(v.c.try_cast("string"), F.to_json(v.c))
    if v.is_array or v.is_object:
        return F.to_json(v.c)
    return v.c.cast("string")


def as_bool(v: Val) -> Column:
    if v.is_bool:
        return v.c
    if v.is_variant:
        return v.c.try_cast("boolean")
    return F.lit(None).cast("boolean")


def as_millis(v: Val) -> Column:
    """Epoch milliseconds from a number or from a date text."""
    if v.is_string:
        return F.unix_millis(F.coalesce(v.c.try_cast("timestamp"), F.try_to_timestamp(v.c, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(v.c, F.lit("yyyy/MM/dd"))))
    if isinstance(v.t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_millis(v.c.cast("timestamp"))
    return as_long(v)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def clamp_index(i: Column, size: Column) -> Column:
    """A 0-based index; negative ones count from the end."""
    return F.when(i < 0, i + size).otherwise(i).cast("int")


# -- registry -------------------------------------------------------------------

Compile = Callable[..., Val]


@dataclass
class Function:
    name: str
    low: int
    high: int | None
    compile: Compile | None
    category: str


FUNCTIONS: dict[str, Function] = {}


def function(names: str, low: int, high: int | None = -1, category: str = ""):
    """Register a compile function f(ctx, *args) under all names; high None: any number of arguments."""

    def register(f: Compile) -> Compile:
        for name in names.split():
            FUNCTIONS[name] = Function(name, low, low if high == -1 else high, f, category or f.__module__.rpartition(".")[2])
        return f

    return register


def declare(names: str, low: int, high: int | None, category: str) -> None:
    """Register names that the planner itself compiles (aggregates, analytic and row functions)."""
    for name in names.split():
        FUNCTIONS[name] = Function(name, low, high, None, category)
