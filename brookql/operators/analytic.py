"""Per-row functions with running state: f(args) OVER (PARTITION BY e WHEN condition).

State is kept in event order (__ts, __seq) within a partition, so each function is a
window function whose frame ends at the current row.  WHEN false leaves the state as it
is and returns its present value; the change functions ignore WHEN.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import BOOL, DOUBLE, LONG, CompileError, Val, as_bool, as_double, as_long, as_string, boolean
from brookql.operators.ordering import Ordered
from brookql.plans import ast as A

PATTERNS = ("sequence_match", "sequence_count")
UNBOUNDED = Window.unboundedPreceding


def partition(keys: list[Val]):
    """A grouping key that tells values of different types apart."""
    return [k.c for k in keys] or [F.lit(0)]


def compile_call(ctx, call: A.Call, order: tuple[str, ...] = ("__ts", "__seq"), over: list[Val] | None = None) -> Val:
    """The value of an analytic call as a window column; patterns are planned apart."""
    keys = [ctx.compile(p) for p in call.partition or ()] if over is None else over
    w = Window.partitionBy(*partition(keys)).orderBy(*order)
    upto, before = w.rowsBetween(UNBOUNDED, 0), w.rowsBetween(UNBOUNDED, -1)
    when = None if call.when is None else F.coalesce(ctx.predicate(call.when), F.lit(False))
    gate = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    name = call.name
    if name in ("row_number", "last_hit_count"):
        n = F.count(gate(F.lit(1))).over(upto if name == "row_number" else before)
        return Val(n, LONG, False)
    if name == "last_hit_time":
        return Val(F.coalesce(F.lag("__ts").over(w), F.lit(0)), LONG, False)
    args = [ctx.compile(a) if not isinstance(a, A.Star) else Val(F.lit(1), LONG) for a in call.args]
    if name in ("had_changed", "changed_col"):
        cols = args[1:] if len(args) > 1 and isinstance(args[0].lit, bool) else args
        tests = [change(v.c, before) for v in cols]
        if name == "had_changed":
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return boolean(out, False)
        return Val(F.coalesce(*[F.when(t, v.c) for t, v in zip(tests, cols)]), cols[0].t)
    x = args[0]
    if name == "lag":
        return _lag(ctx, x, args, partition(keys), order, when)
    if name == "acc_count":
        return Val(F.count(gate(x.c)).over(upto), LONG, False)
    if name == "acc_sum":
        if x.is_int:
            return Val(F.sum(gate(as_long(x))).over(upto), LONG)
        return Val(F.sum(gate(as_double(x))).over(upto), DOUBLE)
    if name == "acc_avg":
        return Val(F.avg(gate(as_double(x))).over(upto), DOUBLE)
    if name in ("acc_min", "acc_max"):
        return Val((F.min if name == "acc_min" else F.max)(gate(x.c)).over(upto), x.t)
    if name in ("acc_min_by", "acc_max_by"):
        y = args[1]
        ok = x.c.isNotNull() & y.c.isNotNull()
        # the extreme so far; among the rows that have it, the newest row's value
        best = (F.max if name == "acc_max_by" else F.min)(gate(F.when(ok, y.c))).over(upto)
        # a row holds the record when its value equals the extreme up to itself; the last such row is the answer
        holds = gate(F.when(ok & (y.c == best), F.struct(x.c.alias("v"))))
        name = ctx.stage(holds)
        return Val(F.last(name, ignorenulls=True).over(upto)["v"], x.t)
    if name == "acc_collect":
        return ctx.val(F.collect_list(gate(x.c)).over(upto))
    if name in ("acc_distinct_collect", "distinct_acc"):
        return ctx.val(F.array_distinct(F.collect_list(gate(x.c)).over(upto)))
    if name == "acc_map_agg":
        pairs = F.collect_list(gate(F.when(x.c.isNotNull(), F.struct(as_string(x).alias("key"), args[1].c.alias("value"))))).over(upto)
        names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        latest = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)
        return ctx.val(F.transform(names, latest))
    raise CompileError(f"{name} is no analytic function")


def whole_stream(o: Ordered, ctx, call: A.Call, name: str):
    """Notes the columns of a call without PARTITION BY, kept by blocks of the stream.

    Returns what gives the call's value once they are there, or None where the call
    needs all rows in one order.
    """
    when = None if call.when is None else F.coalesce(ctx.predicate(call.when), F.lit(False))
    gate = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    args = [ctx.compile(a) if not isinstance(a, A.Star) else Val(F.lit(1), LONG) for a in call.args]
    if call.name in ("row_number", "last_hit_count", "acc_count"):
        counted = F.lit(1) if not args else args[0].c
        one = F.coalesce(gate(counted.isNotNull().cast("long")), F.lit(0))
        o.running_sum(one, name)
        return lambda: Val(F.col(name) - one if call.name == "last_hit_count" else F.col(name), LONG, False)
    if call.name in ("acc_min", "acc_max"):
        o.running(F.min if call.name == "acc_min" else F.max, gate(args[0].c), name)
        return lambda: Val(F.col(name), args[0].t)
    if call.name == "acc_sum":
        x = as_long(args[0]) if args[0].is_int else as_double(args[0])
        o.running_sum(gate(x), name).running_sum(F.coalesce(gate(x.isNotNull().cast("long")), F.lit(0)), f"{name}n")
        return lambda: Val(F.when(F.col(f"{name}n") > 0, F.col(name)), LONG if args[0].is_int else DOUBLE)
    if call.name == "lag" and when is None and len(args) < 3 and (len(args) == 1 or args[1].lit == 1):
        o.previous(args[0].c, name)
        return lambda: Val(F.col(name), args[0].t)
    if call.name in ("had_changed", "changed_col"):
        cols = args[1:] if len(args) > 1 and isinstance(args[0].lit, bool) else args
        for i, v in enumerate(cols):
            o.last_before(v.c, f"{name}p{i}")
        tests = [v.c.isNotNull() & ~v.c.eqNullSafe(F.col(f"{name}p{i}")) for i, v in enumerate(cols)]
        if call.name == "changed_col":
            return lambda: Val(F.coalesce(*[F.when(t, v.c) for t, v in zip(tests, cols)]), cols[0].t)
        return lambda: boolean(reduce(lambda x, y: x | y, tests), False)
    return None


def change(c: Column, before) -> Column:
    """Whether c is a value other than the last one before it."""
    return c.isNotNull() & ~c.eqNullSafe(F.last(c, ignorenulls=True).over(before))


def _lag(ctx, x: Val, args: list[Val], keys: list[Column], order, when) -> Val:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(UNBOUNDED, -1)
    n = args[1].lit if len(args) > 1 else 1
    if not isinstance(n, int):
        raise CompileError("the offset of lag must be a literal")
    if n <= 0:
        return x
    default = None if len(args) < 3 or args[2].is_null else (as_double(args[2]) if isinstance(x.t, T.DoubleType) else args[2].c.cast(x.t))
    skip = len(args) > 3 and args[3].lit is True
    push = when if when is not None else None
    if skip:
        push = x.c.isNotNull() if push is None else push & x.c.isNotNull()
    box = F.struct(x.c.alias("v"))
    if push is None:
        found = F.lag(box, n).over(w)
    elif n == 1:
        found = F.last(F.when(push, box), ignorenulls=True).over(before)
    else:
        # of each row that is kept, the one kept n - 1 rows earlier; of any row, that of the last one kept before it
        push = F.coalesce(push, F.lit(False))
        back = F.lag(box, n - 1).over(Window.partitionBy(*keys, push).orderBy(*order))
        found = F.last(ctx.stage(F.when(push, F.struct(back.alias("b")))), ignorenulls=True).over(before)["b"]
    return Val(F.when(found.isNull(), default).otherwise(found["v"]) if default is not None else found["v"], x.t)


def changed_columns(ctx, call: A.Call) -> list[tuple[str, Val]]:
    """(name, value) of each column of changed_cols(prefix, ignore_null, column, ...): its value if it changed."""
    prefix, ignore = ctx.compile(call.args[0]).lit, ctx.compile(call.args[1]).lit
    if not isinstance(prefix, str) or not isinstance(ignore, bool):
        raise CompileError("changed_cols takes a prefix and a flag first")
    w = Window.partitionBy(*partition([ctx.compile(p) for p in call.partition or ()])).orderBy("__ts", "__seq")
    before = w.rowsBetween(UNBOUNDED, -1)
    columns: list[tuple[str, Val]] = []
    for a in call.args[2:]:
        columns += [(n, ctx.compile(A.Ident(n))) for n, _ in ctx.scope.public()] if isinstance(a, A.Star) else [(output_name(a), ctx.compile(a))]
    out = []
    for name, v in columns:
        if ignore:
            changed = change(v.c, before)
        else:
            prev = F.lag(F.struct(v.c.alias("v"))).over(w)
            changed = F.when(prev.isNull(), v.c.isNotNull()).otherwise(~v.c.eqNullSafe(prev["v"]))
        out.append((prefix + name, Val(F.when(changed, v.c), v.t)))
    return out


def output_name(e: A.Node) -> str:
    if isinstance(e, A.Ident):
        return (e.name, *e.path)[-1]
    return e.name if isinstance(e, A.Call | A.Field) else ""


def advance(state: tuple[int, int | None, int], row, on: bool, ts: int | None, span: int) -> tuple[tuple[int, int | None, int], bool]:
    """((stage, start, sequences done), whether one is done now) after a row; row: which conditions it meets.

    A step is one event; the first condition restarts a sequence; a sequence that is
    longer than the span since its first step is given up.  A row without a time is
    within any span.
    """
    stage, start, done = state
    if not on:
        return state, False
    if stage and span > 0 and ts is not None and start is not None and ts - start > span:
        stage = 0
    if row[stage]:
        start = ts if stage == 0 else start
        stage += 1
    elif row[0]:
        stage, start = 1, ts
    if stage >= len(row):
        return (0, start, done + 1), True
    return (stage, start, done), False


def with_pattern(df: DataFrame, ctx, call: A.Call, name: str) -> tuple[DataFrame, Val]:
    """Adds the value of sequence_match or sequence_count: an automaton over each partition's ordered rows.

    Rows are dealt by partition key, sorted, and stream through the automaton, which
    keeps one state; every row comes out as it went in, with its value.
    """
    span = ctx.compile(call.args[0]).lit
    if not isinstance(span, int):
        raise CompileError("the span of a pattern must be a literal")
    conditions = [F.coalesce(as_bool(ctx.compile(a)), F.lit(False)) for a in call.args[1:]]
    when = F.lit(True) if call.when is None else F.coalesce(ctx.predicate(call.when), F.lit(False))
    keys = partition([ctx.compile(p) for p in call.partition or ()])
    flags = [f"__c{i}" for i in range(len(conditions))]
    count = call.name == "sequence_count"
    rows = df.withColumns({"__key": F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), "__on": when, **dict(zip(flags, conditions))})
    rows = rows.repartition("__key").sortWithinPartitions("__key", "__ts", "__seq")
    kind, kept = (pa.int64(), T.LongType()) if count else (pa.bool_(), T.BooleanType()), df.columns

    def run(batches):
        key, state = None, (0, None, 0)
        for batch in batches:
            result = []
            tests = zip(*[batch.column(f).to_pylist() for f in flags])
            for k, ts, on, row in zip(batch.column("__key").to_pylist(), batch.column("__ts").to_pylist(), batch.column("__on").to_pylist(), tests):
                if k != key:
                    key, state = k, (0, None, 0)
                state, hit = advance(state, row, on, ts, span)
                result.append(state[2] if count else hit)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(result, kind[0])], names=[*kept, name])

    out = rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind[1])]))
    return out, Val(F.col(name), LONG if count else BOOL, False)
