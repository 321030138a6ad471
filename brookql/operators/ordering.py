"""Order-dependent operators over a whole stream, without a single-partition sort.

Rows are cut into blocks that are ranges of event time.  Within a block, window
functions run as usual; across blocks only one small row a block is needed (its count,
sum or last row), carried forward and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def below(bounds: list, c: Column) -> Column:
    """How many of the sorted bounds are below c: a binary search within the plan."""
    table, n = F.lit(bounds), len(bounds)
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) < c), at + step).otherwise(at))


class Ordered:
    """df with `__block`; equal times share a block, unless all are equal.  Order is by __ts, then __seq.

    The methods note columns to add; done() adds them all with one aggregate a block,
    one carry and one join, so the input is read twice, however many there are.
    """

    def __init__(self, df: DataFrame, blocks: int | None = None) -> None:
        self.added: list[tuple[str, Column, Callable, Callable]] = []
        self.within = Window.partitionBy("__block").orderBy("__ts", "__seq")
        if "__block" in df.columns:
            self.df = df
            return
        n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bounds = []
        if n > 1:
            probs = [i / n for i in range(1, n)]
            whole = isinstance(df.schema["__seq"].dataType, T.LongType)
            cut = lambda c: F.percentile_approx(c, probs, 20 * n)
            found, first, last, timed, rows, order = df.select(cut("__ts"), F.min("__ts"), F.max("__ts"), F.count("__ts"), F.count("*"), cut("__seq") if whole else F.lit(None)).head()
            if order and (timed == 0 or timed == rows and first == last):
                # all rows have one time, or none: the tie-break alone orders them
                self.df = df.withColumn("__block", below(sorted(set(order)), F.col("__seq")).cast("int"))
                return
            bounds = sorted(set(found or []))
        # a null time sorts first, as in any ascending order
        block = F.when(F.col("__ts").isNull(), -1).otherwise(below(bounds, F.col("__ts"))) if bounds else F.lit(0)
        self.df = df.withColumn("__block", block.cast("int"))

    def _add(self, name: str, total: Column, carry: Callable, final: Callable) -> Ordered:
        """total: a block's aggregate; carry: from a total to what went before the block; final: from a carry to the column."""
        self.added.append((name, total, carry, final))
        return self

    def running_sum(self, c: Column, name: str) -> Ordered:
        """The inclusive running sum of c over the whole stream, 0 where nothing came yet."""
        own = F.sum(c).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        return self._add(name, F.sum(c), lambda t, before: F.sum(t).over(before), lambda k: F.coalesce(own, F.lit(0)) + F.coalesce(k, F.lit(0)))

    def row_number(self, name: str) -> Ordered:
        """The 1-based place in the whole stream."""
        return self.running_sum(F.lit(1).cast("long"), name)

    def running(self, f, c: Column, name: str) -> Ordered:
        """The running F.min or F.max (f) of c."""
        own = f(c).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        pick = F.least if f is F.min else F.greatest
        return self._add(name, f(c), lambda t, before: f(t).over(before), lambda k: pick(own, k))

    def previous(self, c: Column, name: str) -> Ordered:
        """c of the row before."""
        total = F.max_by(F.struct(c.alias("v")), F.struct("__ts", "__seq"))
        own = F.lag(F.struct(c.alias("v"))).over(self.within)
        return self._add(name, total, lambda t, before: F.last(t, ignorenulls=True).over(before), lambda k: F.coalesce(own, k)["v"])

    def last_at(self, c: Column, name: str) -> Ordered:
        """The last value of c up to each row that is not null."""
        total = F.max_by(c, F.when(c.isNotNull(), F.struct("__ts", "__seq")))
        own = F.last(c, ignorenulls=True).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        return self._add(name, total, lambda t, before: F.last(t, ignorenulls=True).over(before), lambda k: F.coalesce(own, k))

    def last_before(self, c: Column, name: str) -> Ordered:
        """The last value of c before each row that is not null."""
        total = F.max_by(c, F.when(c.isNotNull(), F.struct("__ts", "__seq")))
        own = F.last(c, ignorenulls=True).over(self.within.rowsBetween(Window.unboundedPreceding, -1))
        return self._add(name, total, lambda t, before: F.last(t, ignorenulls=True).over(before), lambda k: F.coalesce(own, k))

    def done(self, keep: bool = False) -> DataFrame:
        """The rows with all columns; keep: with `__block` too, for another round on the same blocks."""
        if self.added:
            totals = self.df.groupBy("__block").agg(*[t.alias(f"__t{i}") for i, (_, t, _, _) in enumerate(self.added)])
            # one row a block: no size that matters to one task or to a broadcast
            before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
            carried = totals.select("__block", *[carry(F.col(f"__t{i}"), before).alias(f"__k{i}") for i, (_, _, carry, _) in enumerate(self.added)])
            df = self.df.join(F.broadcast(carried), "__block", "left")
            df = df.withColumns({name: final(F.col(f"__k{i}")) for i, (name, _, _, final) in enumerate(self.added)})
            self.df, n = df.drop(*[f"__k{i}" for i in range(len(self.added))]), len(self.added)
            self.added = self.added[n:]
        return self.df if keep else self.df.drop("__block")
