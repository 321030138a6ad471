"""Array and object functions (46)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import CompileError, Val, as_double, as_long, as_string, boolean, double, function, long, null, string


def _item(ctx, a: Val, v: Val):
    """v in the type of a's elements, so that 1 finds 1.0."""
    if v.t == a.t.elementType:
        return v.c
    if isinstance(a.t.elementType, T.NumericType):
        return as_double(v).try_cast(a.t.elementType)
    if isinstance(a.t.elementType, T.StringType):
        return F.lit(None).cast("string") if not v.is_string else v.c
    return v.c.cast(a.t.elementType)


@function("array_contains", 2)
def array_contains(ctx, a: Val, v: Val) -> Val:
    if not a.is_array:
        return boolean(F.lit(False), False)
    return boolean(F.coalesce(F.array_contains(a.c, _item(ctx, a, v)), F.lit(False)), False)


@function("array_join", 1, 3)
def array_join(ctx, a: Val, sep: Val | None = None, missing: Val | None = None) -> Val:
    if not a.is_array:
        return string(F.lit(None).cast("string"))
    mark = F.lit(",") if sep is None else as_string(sep)
    items = F.transform(a.c, lambda x: as_string(Val(x, a.t.elementType)))
    items = F.filter(items, lambda x: x.isNotNull()) if missing is None else F.transform(items, lambda x: F.coalesce(x, as_string(missing)))
    joined = F.aggregate(items, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, mark, x)))
    return string(F.when(F.size(a.c) > 0, joined))


def _keys(v: Val):
    if isinstance(v.t, T.StructType):
        return F.lit(v.t.names) if v.t.names else F.array().cast("array<string>")
    return F.map_keys(v.c)


def _as_map(ctx, v: Val) -> Val:
    """A struct as a map of its fields; the fields' common type is text unless they agree."""
    if isinstance(v.t, T.StructType):
        kinds = {f.dataType for f in v.t.fields}
        value = (lambda f: v.c[f.name]) if len(kinds) == 1 else (lambda f: as_string(Val(v.c[f.name], f.dataType)))
        pairs = [x for f in v.t.fields for x in (F.lit(f.name), value(f))]
        return ctx.val(F.when(v.c.isNotNull(), F.create_map(*pairs)))
    return v


@function("keys", 1)
def keys(ctx, v: Val) -> Val:
    return ctx.val(F.when(v.c.isNotNull(), _keys(v))) if v.is_object else null()


@function("values", 1)
def values(ctx, v: Val) -> Val:
    return ctx.val(F.map_values(_as_map(ctx, v).c)) if v.is_object else null()


@function("object", 2)
def make_object(ctx, k: Val, v: Val) -> Val:
    if not (k.is_array and v.is_array):
        return null()
    names = F.transform(k.c, lambda x: as_string(Val(x, k.t.elementType)))
    return ctx.val(F.when(F.size(k.c) == F.size(v.c), F.map_from_arrays(names, v.c)))


@function("zip", 1)
def zipped(ctx, a: Val) -> Val:
    if not (a.is_array and isinstance(a.t.elementType, T.ArrayType)):
        return null()
    inner = a.t.elementType.elementType
    return ctx.val(F.map_from_entries(F.transform(a.c, lambda p: F.struct(as_string(Val(F.get(p, F.lit(0)), inner)), F.get(p, F.lit(1))))))


@function("items", 1)
def items(ctx, v: Val) -> Val:
    if not v.is_object:
        return null()
    m = _as_map(ctx, v)
    kind = m.t.valueType
    if isinstance(kind, T.StringType):
        return ctx.val(F.transform(F.map_entries(m.c), lambda e: F.array(e["key"], e["value"])))
    as_variant = lambda x: F.try_parse_json(F.to_json(F.struct(x.alias("v"))))
    pair = lambda e: F.array(as_variant(e["key"]), as_variant(e["value"]))
    return ctx.val(F.transform(F.map_entries(m.c), lambda e: F.transform(pair(e), lambda x: F.variant_get(x, "$.v", "variant"))))


def _pairs(ctx, args, keep_null: bool) -> Val:
    if len(args) % 2:
        return null()
    if not args:
        return ctx.val(F.create_map().cast("map<string,string>"))
    values = args[1::2]
    kinds = {v.t for v in values if not v.is_null}
    if len(kinds) > 1 and all(v.is_number or v.is_null for v in values):
        cast = lambda v: as_double(v)
    elif len(kinds) > 1:
        # values of different types keep their names and types in a struct
        if len({ctx.literal(k) for k in args[::2]}) == len(values) and all(ctx.literal(k) is not None for k in args[::2]):
            return ctx.val(F.struct(*[v.c.alias(str(ctx.literal(k))) for k, v in zip(args[::2], values)]))
        cast = as_string
    else:
        cast = lambda v: v.c
    out = F.create_map(*[c for k, v in zip(args[::2], values) for c in (as_string(k), cast(v))])
    return ctx.val(out if keep_null else F.map_filter(out, lambda _, v: v.isNotNull()))


@function("object_construct", 0, None)
def object_construct(ctx, *args: Val) -> Val:
    return _pairs(ctx, args, False)


@function("json_map", 0, None, "json")
def json_map(ctx, *args: Val) -> Val:
    return _pairs(ctx, args, True)


@function("object_concat", 2, None)
def object_concat(ctx, *args: Val) -> Val:
    if not all(a.is_object for a in args):
        return null()
    maps = [_as_map(ctx, a) for a in args]
    if len({m.t.valueType for m in maps}) > 1:
        maps = [_texts(ctx, m) for m in maps]
    out = maps[0].c
    for m in maps[1:]:
        out = _overlaid(out, m.c)
    return ctx.val(out)


def _texts(ctx, m: Val) -> Val:
    return ctx.val(F.transform_values(m.c, lambda _, v: as_string(Val(v, m.t.valueType))))


def _overlaid(old, new):
    """Later keys win, whatever the session's policy for repeated keys is."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _chosen(args):
    out = []
    for a in args:
        out.append(_as_texts(a) if a.is_array else F.array(as_string(a)))
    return F.concat(*out)


def _as_texts(a: Val):
    return F.transform(a.c, lambda x: as_string(Val(x, a.t.elementType)))


@function("erase object_erase", 2, None)
def erase(ctx, v: Val, *args: Val) -> Val:
    if not v.is_object:
        return null()
    return ctx.val(F.map_filter(_as_map(ctx, v).c, lambda k, _: ~F.array_contains(_chosen(args), k)))


@function("object_pick", 2, None)
def object_pick(ctx, v: Val, *args: Val) -> Val:
    if not v.is_object:
        return null()
    return ctx.val(F.map_filter(_as_map(ctx, v).c, lambda k, _: F.array_contains(_chosen(args), k)))


@function("obj_to_kvpair_array object_to_kvpair_array", 1)
def to_kvpairs(ctx, v: Val) -> Val:
    return ctx.val(F.map_entries(_as_map(ctx, v).c)) if v.is_object else null()


@function("kvpair_array_to_obj", 1)
def from_kvpairs(ctx, a: Val) -> Val:
    if not (a.is_array and isinstance(a.t.elementType, T.StructType)):
        return null()
    names = {n.lower()[0]: n for n in reversed(a.t.elementType.names) if n.lower() in ("key", "k", "value", "v")}
    if set(names) != {"k", "v"}:
        return null()
    return ctx.val(F.map_from_entries(F.transform(a.c, lambda e: F.struct(e[names["k"]].cast("string"), e[names["v"]]))))


@function("to_json tojson", 1)
def to_json(ctx, v: Val) -> Val:
    if v.is_array or v.is_object or v.is_variant:
        return string(F.to_json(v.c, {"ignoreNullFields": "false"}))
    if v.is_string:
        quoted = F.to_json(F.struct(v.c.alias("v")))
        return string(F.when(v.c.isNotNull(), F.substr(quoted, F.lit(6), F.char_length(quoted) - 6)))
    return string(as_string(v))


@function("parse_json parsejson json_parse", 1)
def parse_json(ctx, v: Val) -> Val:
    return ctx.val(F.try_parse_json(v.c)) if v.is_string else v


@function("array_create", 0, None)
def array_create(ctx, *args: Val) -> Val:
    if not args:
        return ctx.val(F.array().cast("array<string>"))
    kinds = {a.t for a in args if not a.is_null}
    if len(kinds) > 1:
        if all(a.is_number or a.is_null for a in args):
            return ctx.val(F.array(*[as_double(a) for a in args]))
        return ctx.val(F.array(*[F.variant_get(F.try_parse_json(F.to_json(F.struct(a.c.alias("v")))), "$.v", "variant") for a in args]))
    return ctx.val(F.array(*[a.c for a in args]))


@function("array_position", 2)
def array_position(ctx, a: Val, v: Val) -> Val:
    if not a.is_array:
        return long(F.lit(-1).cast("long"), False)
    return long(F.coalesce(F.array_position(a.c, _item(ctx, a, v)) - 1, F.lit(-1)).cast("long"), False)


@function("array_last_position", 2)
def array_last_position(ctx, a: Val, v: Val) -> Val:
    if not a.is_array:
        return long(F.lit(-1).cast("long"), False)
    back = F.array_position(F.reverse(a.c), _item(ctx, a, v))
    return long(F.coalesce(F.when(back > 0, F.size(a.c) - back), F.lit(-1)).cast("long"), False)


@function("array_positions", 2)
def array_positions(ctx, a: Val, v: Val) -> Val:
    if not a.is_array:
        return ctx.val(F.array().cast("array<bigint>"))
    item = _item(ctx, a, v)
    found = F.filter(F.transform(a.c, lambda x, i: F.when(x == item, i.cast("long"))), lambda i: i.isNotNull())
    return ctx.val(F.coalesce(found, F.array().cast("array<bigint>")))


@function("array_length", 1)
def array_length(ctx, a: Val) -> Val:
    return long(F.when(a.c.isNotNull(), F.size(a.c)).cast("long")) if a.is_array else long(F.lit(None).cast("long"))


@function("cardinality array_cardinality", 1)
def cardinality(ctx, a: Val) -> Val:
    if a.is_array or isinstance(a.t, T.MapType):
        return long(F.when(a.c.isNotNull(), F.size(a.c)).otherwise(0).cast("long"), False)
    return long(F.lit(0).cast("long"), False)


def sliced(ctx, a: Val, low, high) -> Val:
    """Elements [low, high), 0-based and clamped."""
    size = F.size(a.c)
    lo = F.least(F.greatest(low, F.lit(0)), size).cast("int")
    hi = F.least(F.greatest(high, F.lit(0)), size).cast("int")
    return ctx.val(F.slice(a.c, lo + 1, F.greatest(hi - lo, F.lit(0))))


@function("array_slice", 3)
def array_slice(ctx, a: Val, low: Val, high: Val) -> Val:
    return sliced(ctx, a, as_long(low) - 1, as_long(high)) if a.is_array else null()


@function("array_concat", 2)
def array_concat(ctx, a: Val, b: Val) -> Val:
    return ctx.val(F.concat(a.c, b.c)) if a.is_array and b.is_array else null()


def _distinct(a):
    """Distinct elements in first-seen order; nulls never equal one another, so all of them stay."""
    return F.when(F.exists(a, lambda x: x.isNull()), F.filter(a, lambda x, i: x.isNull() | (F.array_position(a, x) == i + 1))).otherwise(F.array_distinct(a))


@function("deduplicate array_distinct", 1)
def deduplicate(ctx, a: Val) -> Val:
    return ctx.val(_distinct(a.c)) if a.is_array else null()


@function("element_at", 2)
def element_at(ctx, a: Val, i: Val) -> Val:
    return ctx.element(a, i)


@function("array_contains_any", 2)
def array_contains_any(ctx, a: Val, b: Val) -> Val:
    if not (a.is_array and b.is_array):
        return boolean(F.lit(False), False)
    return boolean(F.coalesce(F.exists(b.c, lambda x: F.coalesce(F.array_contains(a.c, x), F.lit(False))), F.lit(False)), False)


@function("array_remove", 2)
def array_remove(ctx, a: Val, v: Val) -> Val:
    if not a.is_array:
        return null()
    item = _item(ctx, a, v)
    return ctx.val(F.filter(a.c, lambda x: ~F.coalesce(x == item, F.lit(False))))


@function("array_intersect", 2)
def array_intersect(ctx, a: Val, b: Val) -> Val:
    return ctx.val(F.array_intersect(a.c, b.c)) if a.is_array and b.is_array else null()


@function("array_union", 2)
def array_union(ctx, a: Val, b: Val) -> Val:
    return ctx.val(_distinct(F.concat(a.c, b.c))) if a.is_array and b.is_array else null()


@function("array_except", 2)
def array_except(ctx, a: Val, b: Val) -> Val:
    if not (a.is_array and b.is_array):
        return null()
    return ctx.val(F.filter(a.c, lambda x: ~F.coalesce(F.array_contains(b.c, x), F.lit(False))))


def _numbers(a: Val):
    kind = a.t.elementType
    if isinstance(kind, T.NumericType):
        return a.c
    if isinstance(kind, T.VariantType):
        return F.transform(a.c, lambda x: F.when(F.schema_of_variant(x).isin("BIGINT", "DOUBLE") | F.schema_of_variant(x).startswith("DECIMAL"), x.try_cast("double")))
    return F.array().cast("array<double>")


@function("array_max", 1)
def array_max(ctx, a: Val) -> Val:
    return ctx.val(F.array_max(_numbers(a))) if a.is_array else null()


@function("array_min", 1)
def array_min(ctx, a: Val) -> Val:
    return ctx.val(F.array_min(_numbers(a))) if a.is_array else null()


@function("array_avg", 1)
def array_avg(ctx, a: Val) -> Val:
    if not a.is_array:
        return null()
    got = F.filter(F.transform(_numbers(a), lambda x: x.cast("double")), lambda x: x.isNotNull())
    return double(F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(got)))


@function("array_flatten", 1)
def array_flatten(ctx, a: Val) -> Val:
    if not a.is_array:
        return null()
    return ctx.val(F.flatten(F.filter(a.c, lambda x: x.isNotNull()))) if isinstance(a.t.elementType, T.ArrayType) else a


@function("array_sort", 1)
def array_sort(ctx, a: Val) -> Val:
    if not a.is_array:
        return null()
    if isinstance(a.t.elementType, T.VariantType):
        return ctx.val(F.array_sort(F.transform(a.c, lambda x: as_string(Val(x, a.t.elementType)))))
    return ctx.val(F.array_sort(a.c))


@function("repeat", 2)
def repeat(ctx, v: Val, n: Val) -> Val:
    return ctx.val(F.when(as_long(n) >= 0, F.array_repeat(v.c, as_long(n).cast("int"))))


@function("sequence", 2, 3)
def sequence(ctx, a: Val, b: Val, step: Val | None = None) -> Val:
    lo, hi = as_long(a), as_long(b)
    if step is None:
        return ctx.val(F.sequence(lo, hi))
    by = as_long(step)
    ok = ((by > 0) & (hi >= lo)) | ((by < 0) & (hi <= lo))
    return ctx.val(F.when(ok, F.sequence(lo, F.when(ok, hi).otherwise(lo), F.when(ok, by).otherwise(1))))


@function("array_shuffle", 1)
def array_shuffle(ctx, a: Val) -> Val:
    return ctx.val(F.shuffle(a.c)) if a.is_array else null()


@function("array_map", 2)
def array_map(ctx, a: Val, b: Val) -> Val:
    """Apply the named one-argument function to every element; the name may come first or second."""
    (name, v) = (ctx.literal(a), b) if not a.is_array else (ctx.literal(b), a)
    if not v.is_array or not isinstance(name, str):
        raise CompileError("array_map takes an array and a function name")
    return ctx.val(F.transform(v.c, lambda x: ctx.apply(name.lower(), [Val(x, v.t.elementType)]).c))

