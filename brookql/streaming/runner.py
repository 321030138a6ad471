"""Statements as Structured Streaming queries.

* Without a window or state: the batch plan over the streaming source; lookups join
  static tables.
* Tumbling and hopping windows: event-time windows with a watermark of `late_tolerance`
  milliseconds, in append mode.
* State functions: one keyed operator that keeps each partition's state across
  micro-batches.  Rows of a micro-batch arrive in any order, so each key's rows are
  sorted by event time and tie-break before they are folded.
* UNION ALL of such statements; UNION also drops repeated rows, for as long as the
  stream runs.
* Other windows, joins of streams, and ORDER BY or LIMIT of a window: by micro-batches
  with carried rows (microbatch.py), which only start() can run.

Rows whose expressions fail are left out; start() writes them to the folder `errors`.
"""

from __future__ import annotations

import pickle
from dataclasses import replace
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from brookql.functions import ANALYTIC
from brookql.functions.values import BOOL, DOUBLE, LONG, CompileError, Val, as_bool, as_double
from brookql.operators import windows
from brookql.operators.analytic import advance
from brookql.plans import ast as A
from brookql.plans.parser import parse_select
from brookql.plans.planner import Planner, check
from brookql.session import Engine
from brookql.streaming.microbatch import MicroBatches

FOLDED = ("acc_sum", "acc_count", "acc_avg", "acc_min", "acc_max", "acc_max_by", "acc_min_by", "acc_collect", "acc_distinct_collect", "distinct_acc", "lag", "had_changed", "changed_col", "row_number", "sequence_match", "sequence_count")


class StreamPlanner(Planner):
    def __init__(self, engine: Engine, late_tolerance: int, **options) -> None:
        super().__init__(engine.catalog, engine.options | options, engine.udfs)
        self.late = late_tolerance

    def stream(self, sql: str) -> DataFrame:
        sel = parse_select(sql)
        out = self._one(sel)
        while sel.union is not None:
            out = out.unionByName(self._one(sel.union), allowMissingColumns=True)
            if not sel.union_all:
                out = out.dropDuplicates()
            sel = sel.union
        return out

    def _one(self, sel: A.Select) -> DataFrame:
        sel = replace(sel, union=None)
        check(sel, self.catalog, self.udfs)
        if carried(self.catalog, sel) or sel.order or sel.limit is not None:
            raise CompileError("this statement runs by micro-batches (start) or in batch mode")
        return self._select(sel) if sel.window is None else self._windowed(sel)

    def _windowed(self, sel: A.Select) -> DataFrame:
        df, sources, _ = self._sources(replace(sel, window=None))
        ctx = self._exprs(df, sources)
        if sel.where is not None:
            df = df.where(ctx.predicate(sel.where))
        if sel.window.filter is not None:
            df = df.where(ctx.predicate(sel.window.filter))
        size, *hop = windows.lengths(sel.window)
        df = df.withColumn("__et", F.timestamp_millis("__ts")).withWatermark("__et", f"{self.late} milliseconds")
        df = df.withColumn("__w", F.window("__et", f"{size} milliseconds", f"{hop[0]} milliseconds" if hop else None))
        df = df.withColumns({"__ws": F.unix_millis("__w.start"), "__we": F.unix_millis("__w.end")})
        return self._grouped(sel, df, sources, {}, [])

    def _analytic(self, df: DataFrame, sources, nodes, known, over=None) -> DataFrame:
        calls = [n for e in nodes if e is not None for n in A.walk(e) if isinstance(n, A.Call) and n.name in ANALYTIC]
        calls = list(dict.fromkeys(c for c in calls if c not in known))
        if not calls:
            return df
        if over is not None or any(c.name not in FOLDED for c in calls):
            raise CompileError("this state function runs in batch mode")
        if len({c.partition or () for c in calls}) > 1:
            raise CompileError("the state functions of a stream share one PARTITION BY")
        ctx = self._exprs(df, sources, known)
        keys = [ctx.compile(p).c for p in calls[0].partition or ()] or [F.lit(0)]
        columns, folds, out = [], [], []
        for i, c in enumerate(calls):
            when = F.lit(True) if c.when is None else F.coalesce(ctx.predicate(c.when), F.lit(False))
            pattern = c.name.startswith("sequence")
            args = [Val(F.lit(1), LONG) if isinstance(a, A.Star) else ctx.compile(a) for a in c.args]
            literals = [a.lit for a in args]
            if c.name in ("had_changed", "changed_col") and len(args) > 1 and isinstance(literals[0], bool):
                args, literals = args[1:], literals[1:]
            if pattern:
                inputs = [F.coalesce(as_bool(a), F.lit(False)) for a in args[1:]]
            elif c.name in ("acc_avg",):
                inputs = [as_double(args[0])]
            else:
                inputs = [a.c for a in args] if c.name != "lag" else [args[0].c]
            columns += [x.alias(f"__i{i}_{k}") for k, x in enumerate(inputs)] + [when.alias(f"__on{i}")]
            kind = _kind(c.name, args)
            folds.append((c.name, literals, len(inputs)))
            out.append((f"__v{len(known) + i}", kind))
        for (name, kind), c in zip(out, calls):
            known[c] = Val(F.col(name), kind)
        seq = df.schema["__seq"].dataType
        place = ["__ts"] + ([f"__seq.`{f}`" for f in seq.names] if isinstance(seq, T.StructType) else ["__seq"])
        order = [f"__o{i}" for i in range(len(place))]
        rows = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(c).alias(o) for c, o in zip(place, order)], F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("__key"), *columns)
        # whole numbers travel as decimals: as numbers of pandas, those beside nulls would become floats
        exact = T.DecimalType(20, 0)
        whole = [f.name for f in rows.schema if isinstance(f.dataType, T.LongType)]
        rows = rows.withColumns({c: F.col(f"`{c}`").cast(exact) for c in whole})
        kept = list(df.columns)
        schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in kept], *[T.StructField(n, t) for n, t in out]])

        def step(key, batches, state):
            memory = pickle.loads(state.get[0]) if state.exists else [None] * len(folds)
            pdf = pd.concat(list(batches), ignore_index=True)
            pdf = pdf.sort_values(order, kind="stable", ignore_index=True, na_position="first")
            for i, ((name, literals, n), (column, _)) in enumerate(zip(folds, out)):
                inputs = [[None if x is None or x != x else int(x) if isinstance(x, Decimal) and c in whole else x for x in pdf[c]] for c in (f"__i{i}_{k}" for k in range(n))]
                result = []
                for j, (on, ts) in enumerate(zip(pdf[f"__on{i}"], pdf["__ts"])):
                    memory[i], value = fold(name, memory[i], [x[j] for x in inputs], bool(on), int(ts or 0), literals)
                    result.append(value)
                pdf[column] = pd.Series(result, dtype=object)
            state.update((pickle.dumps(memory),))
            yield pdf[[*kept, *[n for n, _ in out]]]

        folded = rows.groupBy("__key").applyInPandasWithState(step, schema, T.StructType([T.StructField("memory", T.BinaryType())]), "append", GroupStateTimeout.NoTimeout)
        return folded.withColumns({c: F.col(f"`{c}`").cast("long") for c in kept if c in whole})


def _kind(name: str, args: list[Val]) -> T.DataType:
    if name in ("acc_count", "row_number", "sequence_count"):
        return LONG
    if name in ("had_changed", "sequence_match"):
        return BOOL
    if name == "acc_avg":
        return DOUBLE
    if name == "acc_sum":
        return LONG if args[0].is_int else DOUBLE
    if name in ("acc_collect", "acc_distinct_collect", "distinct_acc"):
        return T.ArrayType(args[0].t)
    return args[0].t


def fold(name: str, m, x: list, on: bool, ts: int, literals: list):
    """(state, value) after one row; the state of a call starts as None."""
    v = x[0] if x else None
    if name in ("had_changed", "changed_col"):
        m = list(m or [None] * len(x))
        first, hit = None, False
        for i, y in enumerate(x):
            if y is not None and y != m[i]:
                m[i], hit = y, True
                first = y if first is None else first
        return m, hit if name == "had_changed" else first
    if name in ("row_number", "acc_count"):
        m = (m or 0) + (1 if on and (name == "row_number" or v is not None) else 0)
        return m, m
    if name == "acc_sum":
        m = m if not on or v is None else v if m is None else m + v
        return m, m
    if name == "acc_avg":
        s, n = m or (0.0, 0)
        s, n = (s + v, n + 1) if on and v is not None else (s, n)
        return (s, n), s / n if n else None
    if name in ("acc_min", "acc_max"):
        if on and v is not None and (m is None or (v < m if name == "acc_min" else v > m)):
            m = v
        return m, m
    if name in ("acc_min_by", "acc_max_by"):
        if on and v is not None and x[1] is not None and (m is None or (x[1] <= m[1] if name == "acc_min_by" else x[1] >= m[1])):
            m = (v, x[1])
        return m, m[0] if m else None
    if name in ("acc_collect", "acc_distinct_collect", "distinct_acc"):
        m = list(m or [])
        if on and v is not None and (name == "acc_collect" or v not in m):
            m.append(v)
        return m, list(m)
    if name == "lag":
        n = literals[1] if len(literals) > 1 else 1
        if n <= 0:
            return m, v
        m = list(m or [])
        out = m[-n] if len(m) >= n else literals[2] if len(literals) > 2 else None
        if on and not (len(literals) > 3 and literals[3] is True and v is None):
            m = [*m, v][-n:]
        return m, out
    m, hit = advance(m or (0, None, 0), x, on, ts, literals[0])
    return m, m[2] if name == "sequence_count" else hit


def carried(catalog, sel: A.Select) -> bool:
    """Whether a statement's windows need rows carried from batch to batch."""
    if sel.window is None:
        return False
    return sel.window.kind not in ("tumbling", "hopping") or bool(sel.order) or sel.limit is not None or any(not catalog[j.table].table for j in sel.joins)


def stream(engine: Engine, sql: str, late_tolerance: int = 0, **options) -> DataFrame:
    """The statement as a streaming DataFrame; its FROM source must be one."""
    return StreamPlanner(engine, late_tolerance, **options).stream(sql)


def start(engine: Engine, sql: str, checkpoint: str, actions: list[dict] | None = None, name: str | None = None, late_tolerance: int = 0, trigger: dict | None = None, errors: str | None = None, **options):
    """Start the statement as a query that carries out the actions on each micro-batch.

    The checkpoint folder must be shared; a restarted query goes on from it.  errors: a
    folder for the rows that failed, as JSON lines with their messages.
    """
    from brookql.sources.writers import write

    sel = parse_select(sql)
    trigger = trigger or {"availableNow": True}

    def deliver(rows: DataFrame, failed: DataFrame | None = None) -> None:
        rows.persist()
        try:
            for action in actions or ():
                for kind, props in action.items():
                    write(engine, rows, kind, props | {"append": True})
        finally:
            rows.unpersist()
        if failed is not None and errors:
            failed.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(errors)

    if carried(engine.catalog, sel):
        if not actions:
            raise CompileError("micro-batches need actions")
        step = MicroBatches(engine, sel, f"{checkpoint.rstrip('/')}/rows", late_tolerance, lambda plan, _: deliver(plan.rows, plan.dead_letters()), options)
        writer = step.rows().writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(step)
        return (writer.queryName(name) if name else writer).start()
    planner = StreamPlanner(engine, late_tolerance, **options)
    df = planner.stream(sql)
    if errors and planner.errors:
        failed = planner.errors[0]
        for e in planner.errors[1:]:
            failed = failed.unionByName(e)
        failed = failed.select(F.to_json(F.struct("*")).alias("value"))
        failed.writeStream.format("text").option("path", errors).option("checkpointLocation", f"{checkpoint.rstrip('/')}/errors").trigger(**trigger).start()
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    if not actions:
        return writer.format("memory").start()
    return writer.foreachBatch(lambda batch, _: deliver(batch)).start()
