"""Conversion (12), system (10), vector (4) and plugin (1) functions."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import CompileError, Val, as_bool, as_double, as_long, as_millis, as_string, boolean, double, function, long, null, string


@function("cast", 2)
def cast(ctx, x: Val, kind: Val) -> Val:
    name = str(ctx.literal(kind)).lower()
    if name in ("bigint", "int"):
        out = as_long(x)
        ctx.error(F.when(x.c.isNotNull() & out.isNull(), F.lit("cast: not a whole number")))
        return long(out)
    if name in ("float", "double"):
        out = as_double(x)
        ctx.error(F.when(x.c.isNotNull() & out.isNull(), F.lit("cast: not a number")))
        return double(out)
    if name == "string":
        return string(as_string(x))
    if name in ("boolean", "bool"):
        if x.is_bool:
            return x
        if x.is_number:
            return boolean(as_double(x) != 0)
        s = F.lower(as_string(x))
        return boolean(F.when(s.isin("true", "1", "t"), True).when(s.isin("false", "0", "f"), False))
    if name in ("datetime", "timestamp"):
        return string(F.date_format(F.timestamp_millis(as_millis(x)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    if name == "bytea":
        return string(F.base64(F.encode(as_string(x), "utf-8")))
    return null()


@function("delay", 2)
def delay(ctx, ms: Val, x: Val) -> Val:
    """The second argument; nothing sleeps on an executor."""
    return x


@function("coalesce nvl", 1, None)
def coalesce(ctx, *args: Val) -> Val:
    kinds = {a.t for a in args if not a.is_null}
    if len(kinds) <= 1:
        return ctx.val(F.coalesce(*[a.c for a in args]))
    if all(a.is_number or a.is_null for a in args):
        return double(F.coalesce(*[as_double(a) for a in args if not a.is_null]))
    return string(F.coalesce(*[as_string(a) for a in args]))


@function("isnan", 1)
def isnan(ctx, x: Val) -> Val:
    return boolean(F.coalesce(F.isnan(x.c), F.lit(False)), False) if isinstance(x.t, T.DoubleType | T.FloatType) else boolean(F.lit(False), False)


@function("isnumeric", 1)
def isnumeric(ctx, x: Val) -> Val:
    return boolean(as_double(x).isNotNull() if x.is_number or x.is_string else F.lit(False), False)


@function("isnull", 1)
def isnull(ctx, x: Val) -> Val:
    return boolean(x.c.isNull(), False)


@function("tstamp", 0)
def tstamp(ctx) -> Val:
    return long(F.unix_millis(F.current_timestamp()))


@function("uuid newuuid", 0)
def uuid(ctx) -> Val:
    return string(F.uuid())


# -- system ---------------------------------------------------------------------


@function("event_time", 0, category="system")
def event_time(ctx) -> Val:
    return ctx.event_time()


@function("meta mqtt", 0, 1, category="system")
def meta(ctx, key: Val | None = None) -> Val:
    """A field of the record's metadata column, without regard to case; `*` or nothing gives all of it."""
    return ctx.metadata(None if key is None else str(ctx.literal(key)))


@function("rule_id", 0, category="system")
def rule_id(ctx) -> Val:
    return string(F.lit(ctx.options.get("rule_id", "")))


@function("rule_start", 0, category="system")
def rule_start(ctx) -> Val:
    return long(F.lit(int(ctx.options.get("rule_start", time.time() * 1000))).cast("long"))


@function("window_start", 0, category="system")
def window_start(ctx) -> Val:
    return ctx.window_bound("start")


@function("window_end", 0, category="system")
def window_end(ctx) -> Val:
    return ctx.window_bound("end")


@function("get_keyed_state", 3, category="system")
def get_keyed_state(ctx, key: Val, kind: Val, default: Val) -> Val:
    """The value of a key in the session's key-value store, as a bigint, float, string or boolean."""
    store = {str(k): str(v) for k, v in ctx.options.get("keyed_state", {}).items()}
    found = F.lit(None).cast("string")
    if store:
        found = F.try_element_at(F.create_map(*[F.lit(x) for kv in store.items() for x in kv]), as_string(key))
    name = str(ctx.literal(kind)).lower()
    if name in ("bigint", "int"):
        return long(F.coalesce(found.try_cast("long"), as_long(default)))
    if name in ("float", "double"):
        return double(F.coalesce(found.try_cast("double"), as_double(default)))
    if name in ("bool", "boolean"):
        return boolean(F.coalesce(found.try_cast("boolean"), as_bool(default)))
    return string(F.coalesce(found, as_string(default)))


# -- vectors --------------------------------------------------------------------


def vector(v: Val):
    """An array of doubles; texts are read as JSON."""
    if v.is_string:
        return F.from_json(v.c, "array<double>")
    if v.is_array and not isinstance(v.t.elementType, T.DoubleType):
        return F.transform(v.c, lambda x: as_double(Val(x, v.t.elementType)))
    if v.is_array:
        return v.c
    return F.lit(None).cast("array<double>")


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _fit(a, b):
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def dot(a, b):
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a, b):
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(_fit(a, b), F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))))


@function("cosine_similarity", 2, category="vector")
def cosine_similarity(ctx, a: Val, b: Val) -> Val:
    return double(cosine(vector(a), vector(b)))


@function("vector_l2 euclidean_distance", 2, category="vector")
def vector_l2(ctx, a: Val, b: Val) -> Val:
    x, y = vector(a), vector(b)
    return double(F.when(_fit(x, y), F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))))


@function("vector_dot vector_dot_product", 2, category="vector")
def vector_dot(ctx, a: Val, b: Val) -> Val:
    x, y = vector(a), vector(b)
    return double(F.when(_fit(x, y), dot(x, y)))


@function("vector_match", 2, 3, category="vector")
def vector_match(ctx, query: Val, candidates: Val, k: Val | None = None) -> Val:
    """The k (5) candidates most like the query: their 0-based index and cosine similarity, best first."""
    if not candidates.is_array:
        return null()
    kind = candidates.t.elementType
    q, n = vector(query), F.lit(5) if k is None else as_long(k).cast("int")
    if isinstance(kind, T.StructType):
        name = next((c for c in ("embedding", "vector") if c in kind.names), None)
        if name is None:
            return null()
        get = lambda x: vector(Val(x[name], kind[name].dataType))
    else:
        get = lambda x: vector(Val(x, kind))
    scored = F.transform(candidates.c, lambda x, i: F.struct((-cosine(q, get(x))).alias("away"), i.cast("long").alias("index")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["away"].isNotNull())), F.lit(1), n)
    return ctx.val(F.transform(best, lambda s: F.struct(s["index"], (-s["away"]).alias("similarity"))))


@function("wasm_run wasm", 2, None, "plugin")
def wasm_run(ctx, module: Val, name: Val, *args: Val) -> Val:
    """Call a function of a plugin module; here a Python function registered as module.name."""
    key = f"{ctx.literal(module)}.{ctx.literal(name)}"
    if key not in ctx.udfs:
        raise CompileError(f"no plugin function {key}")
    return ctx.val(ctx.udfs[key](*[a.c for a in args]))
