"""The aggregates of grouped windows, as Spark aggregate Columns.

Order matters for some: `ord` is the struct of event time and tie-break by which a
group's first and last rows are found.  Numeric aggregates skip what is no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import DOUBLE, LONG, CompileError, Val, as_double, as_long
from brookql.plans import ast as A


def _sorted(c: Column, ord_: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(ord_.alias("o"), c.alias("v")))), lambda e: e["v"])


def compile_call(ctx, call: A.Call, ord_: Column) -> Val:
    name = call.name
    if name == "row_number":
        return Val(F.first(F.lit(1).cast("long")), LONG, False)
    star = bool(call.args) and isinstance(call.args[0], A.Star)
    if name == "count":
        return Val(F.count(F.lit(1)) if star else F.count(ctx.compile(call.args[0]).c), LONG, False)
    x = ctx.compile(call.args[0])
    rest = [ctx.compile(a) for a in call.args[1:]]
    if name == "sum":
        if x.is_int:
            # a sum beyond 64 bits is given up to doubles only if it fits nowhere: types are fixed when compiling
            return Val(F.try_sum(as_long(x)), LONG)
        return Val(F.sum(as_double(x)), DOUBLE)
    if name == "avg":
        return Val(F.avg(as_double(x)), DOUBLE)
    if name in ("min", "max"):
        return Val((F.min if name == "min" else F.max)(x.c), x.t)
    if name in ("stddev", "stddevs", "var", "vars"):
        f = {"stddev": F.stddev_pop, "stddevs": F.stddev_samp, "var": F.var_pop, "vars": F.var_samp}[name]
        return Val(f(as_double(x)), DOUBLE)
    if name == "median":
        return Val(F.median(as_double(x)), DOUBLE)
    if name in ("percentile", "percentile_cont", "percentile_disc"):
        p = rest[0].lit
        if not isinstance(p, int | float) or not 0 <= p <= 1:
            raise CompileError(f"{name} needs a literal share between 0 and 1")
        if name == "percentile_disc":
            values = F.array_sort(F.collect_list(as_double(x)))
            at = F.greatest(F.ceil(F.lit(float(p)) * F.size(values)).cast("int") - 1, F.lit(0))
            return Val(F.get(values, at), DOUBLE)
        return Val(F.percentile(as_double(x), float(p)), DOUBLE)
    if name == "collect":
        return ctx.aggregate_val(_sorted(x.c, ord_) if star else F.filter(_sorted(x.c, ord_), lambda v: v.isNotNull()))
    if name == "last_value":
        skip = bool(rest) and rest[0].lit is True
        return Val(F.max_by(x.c, F.when(x.c.isNotNull(), ord_) if skip else ord_), x.t)
    if name == "latest":
        out = F.max_by(x.c, F.when(x.c.isNotNull(), ord_))
        return Val(F.coalesce(out, rest[0].c.cast(x.t)) if rest else out, x.t)
    if name == "lead":
        offset = rest[0].lit if rest else 1
        default = rest[1].c.cast(x.t) if len(rest) > 1 and not rest[1].is_null else F.lit(None).cast(x.t)
        skip = not (len(rest) > 2 and rest[2].lit is False)
        if not isinstance(offset, int):
            raise CompileError("the offset of lead must be a literal")
        boxes = F.transform(F.array_sort(F.collect_list(F.struct(ord_.alias("o"), x.c.alias("v")))), lambda e: F.struct(e["v"].alias("v")))
        if skip:
            boxes = F.filter(boxes, lambda b: b["v"].isNotNull())
        found = F.get(boxes, F.lit(offset)) if offset >= 0 else F.lit(None)
        return Val(F.when(found.isNull(), default).otherwise(found["v"]) if offset >= 0 else default, x.t)
    if name == "merge_agg":
        if isinstance(x.t, T.StructType):
            # later rows win; a field that a row lacks (null) leaves the value before it
            return ctx.aggregate_val(F.struct(*[F.max_by(x.c[f], F.when(x.c[f].isNotNull(), ord_)).alias(f) for f in x.t.names]))
        if isinstance(x.t, T.MapType):
            merge = lambda s, m: F.map_concat(F.map_filter(s, lambda k, _: ~F.map_contains_key(m, k)), m)
            return ctx.aggregate_val(F.aggregate(F.filter(_sorted(x.c, ord_), lambda m: m.isNotNull()), F.create_map().cast(x.t), merge))
        raise CompileError("merge_agg takes an object")
    raise CompileError(f"unknown aggregate {name}")


def single_row(ctx, call: A.Call) -> Val:
    """An aggregate without a window: the group is the row itself."""
    if call.name == "count":
        if isinstance(call.args[0], A.Star):
            return Val(F.lit(1).cast("long"), LONG, False)
        return Val(F.when(ctx.compile(call.args[0]).c.isNotNull(), 1).otherwise(0).cast("long"), LONG, False)
    x = ctx.compile(call.args[0])
    if call.name == "avg":
        return Val(as_double(x), DOUBLE)
    if call.name == "sum":
        return x if x.is_int else Val(as_double(x), DOUBLE)
    if call.name in ("min", "max", "last_value", "latest"):
        return x
    raise CompileError(f"{call.name} needs a window")
