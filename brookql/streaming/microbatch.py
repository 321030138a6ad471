"""Windows that Structured Streaming has no operator for, by micro-batches.

Sliding, count, session and state windows, joins of streams within a window, and ORDER
BY or LIMIT of a window need rows of earlier micro-batches.  Those that open windows
still need are carried from batch to batch as Parquet in the query's shared folder.  In
each batch the batch planner works on the carried and the new rows, and only windows
that the watermark has closed are delivered, each of them once.

The watermark is the newest event time seen less the tolerated lateness; with several
streams it is that of the slowest one.  Rows older than the watermark of the batch
before are late and dropped, as are rows without a time.  Count, session and state
windows take the rows before the watermark in order of event time.

A batch reads what the batch before it wrote, so a batch that is run again after a
failure gives the same rows again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookql.functions import ANALYTIC
from brookql.functions.values import CompileError
from brookql.operators import windows
from brookql.operators.ordering import Ordered
from brookql.plans import ast as A
from brookql.plans.catalog import Catalog
from brookql.plans.planner import Planner, check


def place() -> Column:
    """A row's place in the order of its stream."""
    return F.struct("__ts", "__seq")



class Closing(Planner):
    """Plans a statement over the rows at hand and keeps the windows that close between two watermarks.

    keep: of a source's rows, those that windows still open after this batch need.
    """

    frames = False

    def __init__(self, catalog: Catalog, options: dict, udfs: dict, before: int | None, now: int) -> None:
        super().__init__(catalog, options, udfs)
        self.before, self.now = before, now
        self.keep = lambda rows: rows.where(F.col("__ts") >= now)

    def _assign(self, df: DataFrame, w: A.Window, predicate, value, bounds: bool = True) -> DataFrame:
        done = F.lit(True) if self.before is None else F.col("__we") > self.before
        if w.kind in ("tumbling", "hopping"):
            oldest = self.now - max(windows.lengths(w))
            self.keep = lambda rows: rows.where(F.col("__ts") >= oldest)
            return windows.assign(df, w, predicate, value).where((F.col("__we") <= self.now) & done)
        if w.kind == "sliding":
            # its last rows may be as old as the watermark, which more rows may still have
            oldest = self.now - sum(windows.lengths(w))
            self.keep = lambda rows: rows.where(F.col("__ts") >= oldest)
            done = F.lit(True) if self.before is None else F.col("__we") >= self.before
            return windows.assign(df, w, predicate, value).where((F.col("__we") < self.now) & done)
        ripe = df.where(F.col("__ts") < self.now)
        if w.filter is not None:
            ripe, w = ripe.where(predicate(w.filter)), replace(w, filter=None)
        return getattr(self, f"_{w.kind}")(ripe, w, predicate, value, bounds)

    def _from(self, places: DataFrame) -> None:
        """Keep rows from the least of `places` (__at) on, and those from the watermark on."""
        first = places.select(F.min("__at").alias("__at"))
        self.keep = lambda rows: rows.join(F.broadcast(first), F.lit(True)).where((F.col("__ts") >= self.now) | (place() >= F.col("__at"))).drop("__at")

    def _session(self, ripe, w, predicate, value, bounds):
        gap = windows.lengths(w)[1]
        out = windows.assign(ripe, w, predicate, value, bounds).persist()
        start, last = out.agg(F.max("__ws"), F.max("__ts")).head()
        if start is None or self.now - last > gap:
            return out
        self.keep = lambda rows: rows.where(F.col("__ts") >= start)
        return out.where(F.col("__ws") < start)

    def _count(self, ripe, w, predicate, value, bounds):
        size, *hop = windows.lengths(w)
        hop = hop[0] if hop else size
        n = ripe.count()
        whole = n // hop if hop > size else (n - size) // hop + 1 if n >= size else 0
        self._from(Ordered(ripe).row_number("__rn").done().where(F.col("__rn") > whole * hop).select(place().alias("__at")))
        return windows.assign(ripe, w, predicate, value, bounds)

    def _state(self, ripe, w, predicate, value, bounds):
        end = F.coalesce(predicate(w.args[1]), F.lit(False)) if len(w.args) == 2 else F.lit(False)
        out = windows.assign(ripe.withColumn("__done", end), w, predicate, value, bounds).persist()
        groups = out.groupBy("__w").agg(F.min(place()).alias("__at"), F.max_by("__done", place()).alias("__done"), F.count("*").alias("__rows"))
        if len(w.args) == 2:
            # a row that opens a window may satisfy the end as well
            open_ = groups.where(~(F.col("__done") & (F.col("__rows") > 1)))
        else:
            open_ = groups.withColumn("__last", F.max("__w.__n").over(_by_key())).where("__w.__n = __last").drop("__last")
        open_ = open_.select("__w", "__at").persist()
        if w.partition:
            key = F.struct(*[value(p).c.cast("string") for p in w.partition])
            first = open_.select(F.col("__w.__key").alias("__key"), "__at")
            self.keep = lambda rows: rows.withColumn("__key", key).join(first, "__key", "left").where((F.col("__ts") >= self.now) | (place() >= F.col("__at"))).drop("__key", "__at")
        else:
            self._from(open_)
        return out.join(open_.select("__w"), "__w", "left_anti").drop("__done")


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("__w.__key")


class MicroBatches:
    """A statement as a function of micro-batches of its streams, for foreachBatch."""

    def __init__(self, engine, sel: A.Select, folder: str, late: int, deliver, options: dict) -> None:
        check(sel, engine.catalog, engine.udfs)
        if sel.union is not None or any(isinstance(n, A.Call) and n.name in ANALYTIC and n.name != "row_number" for n in A.walk(sel)):
            raise CompileError("UNION and state functions do not go with these windows in a stream")
        if sel.window.kind == "state" and sel.joins:
            raise CompileError("state windows of a stream take no joins")
        self.engine, self.sel, self.folder, self.late, self.deliver, self.options = engine, sel, folder, late, deliver, options
        used = dict.fromkeys([sel.source, *(j.table for j in sel.joins)])
        self.streams = [n for n in used if engine.catalog[n].df.isStreaming]

    def rows(self) -> DataFrame:
        """The streams as one, each row in its source's column."""
        parts = [self.engine.catalog[n].df.select(F.lit(i).alias("__src"), F.struct("*").alias(f"__row{i}")) for i, n in enumerate(self.streams)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def __call__(self, batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        read = lambda what: spark.read.parquet(f"{self.folder}/carried/{k - 1}/{what}")
        clock = {r.src: (r.newest, r.now) for r in read("clock").collect()} if k else {}
        before = next(iter(clock.values()))[1] if clock else None
        catalog, at_hand, newest = Catalog(spark), {}, {}
        catalog.sources = type(self.engine.catalog.sources)() if type(self.engine.catalog.sources) is dict else {}
        catalog.sources.update({n: s for n, s in dict(self.engine.catalog.sources).items() if not s.df.isStreaming})
        batch = batch.persist()
        try:
            for i, name in enumerate(self.streams):
                source = self.engine.catalog[name]
                new = replace(source, df=batch.where(F.col("__src") == i).select(f"__row{i}.*"))
                timed = new.frame()[0].select("__ts")
                newest[i] = max([x for x in (timed.agg(F.max("__ts")).head()[0], clock.get(i, (None,))[0]) if x is not None], default=None)
                keep = F.col("__ts").isNotNull() if before is None else F.col("__ts") >= before
                fresh = self._raw(new, new.frame()[0].where(keep))
                rows = (read(str(i)).unionByName(fresh) if k else fresh).persist()
                at_hand[name] = replace(source, df=rows)
                catalog.sources[name] = at_hand[name]
            now = None if None in newest.values() else max(min(newest.values()) - self.late, before if before is not None else min(newest.values()) - self.late)
            planner = None
            if now is not None:
                planner = Closing(catalog, self.engine.options | self.options, self.engine.udfs, before, now)
                self.deliver(planner.plan(self.sel), k)
            for i, name in enumerate(self.streams):
                source = at_hand[name]
                left = source.df if planner is None else self._raw(source, planner.keep(source.frame()[0]))
                left.write.mode("overwrite").parquet(f"{self.folder}/carried/{k}/{i}")
            spark.createDataFrame([(i, t, now) for i, t in newest.items()], "src int, newest long, now long").write.mode("overwrite").parquet(f"{self.folder}/carried/{k}/clock")
            self._forget(spark, k - 2)
        finally:
            for s in at_hand.values():
                s.df.unpersist()
            batch.unpersist()

    @staticmethod
    def _raw(source, framed: DataFrame) -> DataFrame:
        """Framed rows with the source's own columns and types, to be framed again in the next batch."""
        return framed.select(*[(F.timestamp_millis(f"`{f.name}`") if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in source.df.schema])

    def _forget(self, spark, k: int) -> None:
        """Remove what a batch carried that no later one reads."""
        if k >= 0:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/carried/{k}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
