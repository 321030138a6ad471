"""The six GROUP BY windows, as an assignment of rows to windows.

assign() returns the rows with `__w` (the window's identity), `__ws` and `__we` (its
bounds in epoch milliseconds); a row may be in several windows.  Batch mode closes all
windows at the end of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookql.functions.values import CompileError
from brookql.operators.ordering import Ordered
from brookql.plans import ast as A
from brookql.plans.parser import UNITS


def lengths(w: A.Window) -> list[int]:
    """The window's literal arguments, in milliseconds where it has a unit."""
    out = []
    for a in w.args:
        if not isinstance(a, A.Lit) or not isinstance(a.value, int) or isinstance(a.value, bool):
            raise CompileError("window lengths must be whole numbers")
        out.append(a.value * (UNITS[w.unit] if w.unit else 1))
    return out


def assign(df: DataFrame, w: A.Window, predicate, value, bounds: bool = True) -> DataFrame:
    """Rows with their windows; predicate and value compile nodes over df.

    bounds: whether anything asks for the windows' ends, where finding them costs a join.
    """
    if w.filter is not None:
        df = df.where(predicate(w.filter))
    if w.kind == "state":
        return _state(df, w, predicate, value)
    sizes = lengths(w)
    if sizes[0] <= 0:
        return df.where("false").withColumns({"__w": F.lit(0).cast("long"), "__ws": F.lit(0).cast("long"), "__we": F.lit(0).cast("long")})
    if w.kind == "count":
        return _count(df, *sizes)
    if w.kind == "session":
        return _session(df, *sizes, bounds)
    df = df.where("__ts is not null")
    if w.kind == "tumbling":
        return tumbling(df, sizes[0])
    if w.kind == "hopping":
        return hopping(df, *sizes)
    return _sliding(df, sizes[0], sizes[1] if len(sizes) > 1 else 0, None if w.when is None else predicate(w.when))


def tumbling(df: DataFrame, size: int) -> DataFrame:
    start = F.col("__ts") - F.pmod(F.col("__ts"), F.lit(size))
    return df.withColumns({"__w": start, "__ws": start, "__we": start + size})


def hopping(df: DataFrame, size: int, hop: int) -> DataFrame:
    """Windows [end - size, end) for every multiple `end` of hop; hop may exceed size."""
    first = F.col("__ts") - F.pmod(F.col("__ts"), F.lit(hop)) + hop
    last = F.col("__ts") + size - F.pmod(F.col("__ts") + size, F.lit(hop))
    ends = F.when(last >= first, F.sequence(first, F.greatest(first, last), F.lit(hop))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__we", F.explode(ends))
    return df.withColumns({"__w": F.col("__we"), "__ws": F.col("__we") - size})


def _sliding(df: DataFrame, size: int, delay: int, when) -> DataFrame:
    """A window a trigger row: rows of [ts - size, ts] that had arrived, or up to ts + delay.

    A range join by buckets of the window's length: a row meets the triggers of its own
    and of the next bucket, so no task needs more than a bucket's rows.
    """
    reach = size + delay
    triggers = df if when is None else df.where(when)
    triggers = triggers.select(F.col("__ts").alias("__tt"), F.col("__seq").alias("__tq"), F.floor(F.col("__ts") / reach).alias("__bucket"))
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1)) if delay else F.array(F.lit(0), F.lit(1))
    rows = df.withColumn("__bucket", F.explode(F.transform(offsets, lambda k: F.floor(F.col("__ts") / reach) + k)))
    near = (F.col("__ts") >= F.col("__tt") - size) & ((F.col("__ts") <= F.col("__tt") + delay) if delay else ((F.col("__ts") < F.col("__tt")) | ((F.col("__ts") == F.col("__tt")) & (F.col("__seq") <= F.col("__tq")))))
    met = rows.join(triggers, "__bucket").where(near).drop("__bucket")
    return met.withColumns({"__w": F.struct("__tt", "__tq"), "__ws": F.col("__tt") - size, "__we": F.col("__tt") + delay}).drop("__tt", "__tq")


def _count(df: DataFrame, size: int, hop: int | None = None) -> DataFrame:
    """Every `size` rows; with a hop, overlapping or sampled.  Bounds are the last row's time."""
    hop = hop or size
    df = Ordered(df).row_number("__rn").done()
    i = F.col("__rn") - 1
    if hop <= size:
        first = F.greatest(F.lit(0), F.ceil((i - size + 1) / hop)).cast("long")
        df = df.withColumn("__w", F.explode(F.sequence(first, F.floor(i / hop).cast("long"))))
    else:
        # the last `size` rows of every `hop`
        df = df.withColumn("__w", F.floor(i / hop).cast("long")).where(i % hop >= hop - size)
    ends = df.groupBy("__w").agg(F.max("__ts").alias("__we"), F.count("*").alias("__n"))
    # only full windows are emitted
    df = df.join(ends.where(F.col("__n") == size), "__w").withColumn("__ws", F.col("__we"))
    return df.drop("__rn", "__n")


def _session(df: DataFrame, longest: int, gap: int, bounds: bool = True) -> DataFrame:
    """One session at a time for the whole stream; it ends at a gap over `gap` or at `longest`.

    Where a session starts depends on where the one before it started, along the whole
    stream.  Blocks of it are worked through at once all the same:

    1. Each block finds, for every time at which a session could start first in it
       (those of its first `longest` milliseconds), where its last session would start.
    2. One task carries the start of the open session and the last time from block to
       block, by one look-up a block.
    3. Each block finds its own starts.
    4. Rows and starts are sorted together by block; a row's session is the last start.

    Only times go to Python, as arrays; rows are shuffled once.
    """
    df = Ordered(df.where("__ts is not null")).df
    times = df.select("__block", "__ts").distinct()
    entry = times.groupBy("__block").applyInArrow(lambda t: _entries(t, longest, gap), "__block int, first long, last long, at binary, to binary")
    # a block's look-up table is as large as what lies in `longest`, whatever the block's own size
    carried = entry.repartition(1).sortWithinPartitions("__block").mapInArrow(lambda bs: _carry(bs, longest, gap), "__block int, open long, before long")
    starts = times.groupBy("__block").cogroup(carried.groupBy("__block")).applyInArrow(lambda t, c: _starts(t, c, longest, gap), "__block int, __ts long, __ws long, last long")
    if bounds:
        # a session that goes on in later blocks ends with the last of them
        starts = starts.join(starts.groupBy("__ws").agg((F.max("last") + gap).alias("__we")), "__ws")
    else:
        starts = starts.withColumn("__we", F.col("__ws"))
    marks = starts.select("__block", "__ts", F.lit(0).alias("__kind"), F.struct("__ws", "__we").alias("__s"))
    together = df.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("__block").orderBy("__ts", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = together.withColumn("__s", F.last("__s", ignorenulls=True).over(upto)).where("__kind = 1")
    return out.withColumns({"__w": F.col("__s.__ws"), "__ws": F.col("__s.__ws"), "__we": F.col("__s.__we")}).drop("__s", "__kind", "__block")


def _sorted_times(table: pa.Table) -> np.ndarray:
    return np.sort(table.column("__ts").to_numpy())


def _following(t: np.ndarray, longest: int, gap: int) -> tuple[np.ndarray, int]:
    """For a session that starts at t[i], where the next one starts (len(t): not here), and the first time after a gap."""
    n = len(t)
    breaks = np.flatnonzero(np.diff(t) > gap) + 1
    broken = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n), side="right")]
    return np.minimum(np.searchsorted(t, t + longest), broken), int(breaks[0]) if len(breaks) else n


def _entries(table: pa.Table, longest: int, gap: int) -> pa.Table:
    t = _sorted_times(table)
    n = len(t)
    following, broken = _following(t, longest, gap)
    last = np.where(following < n, following, np.arange(n))
    while not np.array_equal(far := last[last], last):
        last = far
    # sessions open before t[0] are over by t[0] + longest, or by the first gap
    k = min(n, max(1, int(np.searchsorted(t, t[0] + longest)) + 1), broken + 1)
    return pa.table({"__block": pa.array([table.column("__block")[0].as_py()], pa.int32()), "first": [int(t[0])], "last": [int(t[-1])], "at": [t[:k].tobytes()], "to": [t[last[:k]].tobytes()]})


def _carry(batches, longest: int, gap: int):
    open_, before = None, None
    for batch in batches:
        rows = []
        for block in batch.to_pylist():
            rows.append((block["__block"], open_, before))
            at, to = np.frombuffer(block["at"], np.int64), np.frombuffer(block["to"], np.int64)
            if open_ is None or block["first"] - before > gap:
                open_ = int(to[0])
            else:
                # without a time of `longest` or more in the table, its last entry is the first after a gap, if there is one
                i = int(np.searchsorted(at, open_ + longest))
                i = i if i < len(at) else int(np.append(np.flatnonzero(np.diff(at) > gap) + 1, len(at))[0])
                open_ = int(to[i]) if i < len(at) else open_
            before = block["last"]
        b, o, t = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(o, pa.int64()), pa.array(t, pa.int64())], names=["__block", "open", "before"])


def _starts(table: pa.Table, carried: pa.Table, longest: int, gap: int) -> pa.Table:
    """(block, time from which it holds, start, last time here) of the sessions of a block."""
    t = _sorted_times(table)
    n = len(t)
    block, open_, before = (carried.column(c)[0].as_py() for c in ("__block", "open", "before"))
    following, broken = _following(t, longest, gap)
    starts, holds = [], []
    i = 0
    if open_ is not None and t[0] - before <= gap:
        starts, holds = [open_], [0]
        i = min(int(np.searchsorted(t, open_ + longest)), broken)
        if i == 0:
            starts, holds = [], []
    following = following.tolist()
    while i < n:
        starts.append(int(t[i]))
        holds.append(i)
        i = following[i]
    holds = np.array(holds, np.int64)
    return pa.table({"__block": pa.array([block] * len(starts), pa.int32()), "__ts": t[holds], "__ws": pa.array(starts, pa.int64()), "last": t[np.append(holds[1:], n) - 1]})


def _state(df: DataFrame, w: A.Window, predicate, value) -> DataFrame:
    """From a row that satisfies the first condition to one that satisfies the second (or the first again)."""
    key = F.struct(*[value(p).c.cast("string") for p in w.partition]) if w.partition else None
    start = F.coalesce(predicate(w.args[0]), F.lit(False))
    df = df.withColumn("__start", start)
    if len(w.args) == 2:
        df = df.withColumn("__end", F.coalesce(predicate(w.args[1]), F.lit(False)))
    if key is not None:
        order = Window.partitionBy(key).orderBy("__ts", "__seq").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("__key", key)
        totals = lambda d, **cs: d.withColumns({n: F.sum(c).over(order) for n, c in cs.items()})
    else:
        df = df.withColumn("__key", F.lit(0))

        def totals(d, **cs):
            o = Ordered(d)
            for n, c in cs.items():
                o = o.running_sum(c, n)
            return o.done(keep=True)

    if len(w.args) == 1:
        df = totals(df, __n=F.col("__start").cast("long")).where("__n > 0")
    else:
        # A row with one condition sets the state, a row with both flips it, others keep it.  So the state
        # after a row is that of the last setting row, flipped once for each row with both since then.
        both = F.col("__start") & F.col("__end")
        sets = F.col("__start") != F.col("__end")
        df = totals(df, __sets=sets.cast("long"), __flips=both.cast("long"))
        at = df.where(sets).select("__key", "__sets", F.col("__start").alias("__on"), F.col("__flips").alias("__flips0"))
        df = df.join(at, ["__key", "__sets"], "left")
        after = F.coalesce("__on", F.lit(False)).cast("int") + F.col("__flips") - F.coalesce("__flips0", F.lit(0))
        df = df.withColumn("__after", after % 2 == 1)
        if key is not None:
            df = df.withColumn("__before", F.lag("__after").over(Window.partitionBy("__key").orderBy("__ts", "__seq")))
        else:
            df = Ordered(df).previous(F.col("__after"), "__before").done(keep=True)
        df = df.withColumn("__before", F.coalesce("__before", F.lit(False)))
        opens = F.col("__after") & ~F.col("__before")
        df = totals(df, __n=opens.cast("long"))
        df = df.where(F.col("__after") | F.col("__before"))
        df = df.drop("__sets", "__flips", "__on", "__flips0", "__after", "__before", "__end")
    bounds = df.groupBy("__key", "__n").agg(F.min("__ts").alias("__ws"), F.max("__ts").alias("__we"))
    if len(w.args) == 1:
        # a window reaches to the row that opens the next one
        following = bounds.select("__key", (F.col("__n") - 1).alias("__n"), F.col("__ws").alias("__next"))
        bounds = bounds.join(following, ["__key", "__n"], "left").withColumn("__we", F.coalesce("__next", "__we")).drop("__next")
    df = df.join(bounds, ["__key", "__n"])
    return df.withColumn("__w", F.struct("__key", "__n")).drop("__key", "__n", "__start", "__block")
