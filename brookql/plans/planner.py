"""SELECT statements to DataFrames.

Order of work, as the dialect has it: sources and lookups; per-row state functions on
every row, also those that WHERE rejects; WHERE; windows; GROUP BY with the first row's
values for plain columns; HAVING; ORDER BY and LIMIT within each window; projection.
Rows whose expressions fail are taken out and kept as `errors`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions import AGGREGATES, ANALYTIC, FUNCTIONS, WIDENING
from brookql.functions.values import DOUBLE, LONG, CompileError, Val
from brookql.operators import aggregates, analytic, joins, windows
from brookql.operators.ordering import Ordered
from brookql.plans import ast as A
from brookql.plans.catalog import Catalog
from brookql.plans.expressions import Expressions, Scope, quoted

INTERNAL = ("__ts", "__seq", "__w", "__ws", "__we")


@dataclass
class Plan:
    """A query's rows, and the rows that failed (error, row as JSON)."""

    rows: DataFrame
    errors: list[DataFrame] = field(default_factory=list)

    def dead_letters(self, cap: int = 4096) -> DataFrame | None:
        """All failed rows: error, source, and the row as JSON, at most `cap` characters of it; None if none can fail."""
        if not self.errors:
            return None
        out = self.errors[0]
        for e in self.errors[1:]:
            out = out.unionByName(e)
        return out.withColumn("row", F.substring("row", 1, cap))


def check(sel: A.Select, catalog: Catalog, udfs: dict) -> None:
    """The rejections that do not need types."""
    for n in A.walk(sel):
        if isinstance(n, A.Call) and n.name not in FUNCTIONS and n.name not in udfs:
            raise CompileError(f"unknown function {n.name}")
    names = [i.alias or analytic.output_name(i.expr) for i in sel.items if not isinstance(i.expr, A.Star)]
    names = [n for n in names if n]
    if len(set(names)) < len(names):
        raise CompileError("an output name stands twice")
    if sel.keys and sel.window is None:
        raise CompileError("GROUP BY needs a window")
    for j in sel.joins:
        if not catalog[j.table].table and sel.window is None and "asof" not in j.kind:
            raise CompileError("streams join only within a window")


FRAMED = ("count", "sum", "avg", "min", "max")


def framable(sel: A.Select) -> bool:
    """Whether a statement asks of its sliding windows nothing but counts, sums, averages and extremes of all their rows."""

    def plain(e) -> bool:
        if isinstance(e, A.Call) and e.name in FRAMED and e.partition is None:
            return True
        if isinstance(e, A.Ident | A.Star) or isinstance(e, A.Call) and (e.name in AGGREGATES or e.name in ANALYTIC or e.name in WIDENING):
            return False
        parts = (getattr(e, f) for f in e.__dataclass_fields__) if isinstance(e, A.Node) else e if isinstance(e, tuple) else ()
        return all(plain(x) for x in parts if isinstance(x, A.Node | tuple))

    w = sel.window
    return w.kind == "sliding" and len(w.args) == 1 and not sel.keys and all(plain(e) for e in (*(i.expr for i in sel.items), sel.having, *(e for e, _ in sel.order)) if e is not None)


class Planner:
    #: Whether sliding windows may be window frames.
    frames = True

    def __init__(self, catalog: Catalog, options: dict | None = None, udfs: dict | None = None) -> None:
        self.catalog, self.options, self.udfs = catalog, options or {}, udfs or {}
        self.errors: list[DataFrame] = []

    def plan(self, sel: A.Select) -> Plan:
        check(sel, self.catalog, self.udfs)
        rows = self._select(replace(sel, union=None))
        while sel.union is not None:
            check(sel.union, self.catalog, self.udfs)
            more = self._select(replace(sel.union, union=None))
            rows = rows.unionByName(more, allowMissingColumns=True)
            if not sel.union_all:
                rows = rows.distinct()
            sel = sel.union
        return Plan(rows, self.errors)

    # -- helpers

    def _exprs(self, df: DataFrame, sources, known=None) -> Expressions:
        return Expressions(Scope(df, sources), self.options, self.udfs, known)

    def _sound(self, df: DataFrame, errors: list[Column], source: str) -> DataFrame:
        """df without failing rows, which are kept as errors."""
        errors = [e for e in errors if e is not None]
        if not errors:
            return df
        message = F.coalesce(*errors)
        public = [c for c in df.columns if not c.startswith("__")]
        self.errors.append(df.select(message.alias("error"), F.lit(source).alias("source"), F.to_json(F.struct(*[quoted(c) for c in public])).alias("row")).where("error is not null"))
        return df.where(message.isNull())

    def _assign(self, df: DataFrame, w: A.Window, predicate, value, bounds: bool = True) -> DataFrame:
        """Rows with their windows; all windows close with the input."""
        return windows.assign(df, w, predicate, value, bounds)

    # -- statement

    def _select(self, sel: A.Select) -> DataFrame:
        df, sources, windowed = self._sources(sel)
        known: dict[A.Node, Val] = {}
        outer = [sel.having] if sel.window is not None or sel.keys else []
        early = [*(i.expr for i in sel.items), sel.where]
        grouped = sel.window is not None and (bool(sel.keys) or self._aggregated(sel))
        # state functions see every row, so they come before WHERE; in a grouped query those above the groups come later
        if not grouped:
            df = self._analytic(df, sources, early, known)
        elif sel.where is not None:
            df = self._analytic(df, sources, [sel.where], known)
        # WHERE, whose own errors drop a row
        if sel.where is not None:
            ctx = self._exprs(df, sources, known)
            condition = ctx.predicate(sel.where)
            df = self._sound(df, ctx.errors, sel.source)
            df = df.where(condition)
        if grouped and not windowed and self.frames and framable(sel):
            return self._framed(sel, df, sources, known)
        if sel.window is not None and not windowed:
            ctx = self._exprs(df, sources, known)
            # the ends of sessions order the groups of these, too
            ends = sel.order or sel.limit is not None or any(isinstance(n, A.Call) and (n.name in ANALYTIC or n.name in ("window_end", "last_agg_hit_count", "last_agg_hit_time")) for n in A.walk((sel.items, sel.having)))
            df = self._assign(df, sel.window, ctx.predicate, ctx.compile, bool(ends))
        if grouped:
            return self._grouped(sel, df, sources, known, outer)
        if sel.having is not None:
            ctx = self._exprs(df, sources, known)
            df = df.where(ctx.predicate(sel.having))
        return self._project(sel, df, sources, known)

    def _aggregated(self, sel: A.Select) -> bool:
        nodes = [*(i.expr for i in sel.items), sel.having, *(e for e, _ in sel.order)]
        return any(isinstance(n, A.Call) and n.name in AGGREGATES and n.partition is None for e in nodes for n in A.walk(e))

    def _sources(self, sel: A.Select):
        source = self.catalog[sel.source]
        df, bad = source.frame(bool(self.options.get("strict_schema")))
        df = self._sound(df, bad, sel.source).drop("__bad")
        if not sel.joins:
            return df, [(sel.alias, {c: c for c in df.columns if c not in ("__ts", "__seq")})], False
        df, columns = joins.named(df, sel.alias)
        sources = [(sel.alias, columns)]
        windowed = sel.window is not None and any(not self.catalog[j.table].table for j in sel.joins)
        if windowed:
            if sel.window.kind not in ("tumbling", "hopping"):
                raise CompileError("streams join in tumbling and hopping windows")
            if sel.window.filter is not None:
                ctx = self._exprs(df, sources)
                df = df.where(ctx.predicate(sel.window.filter))
            df = self._assign(df, replace(sel.window, filter=None), None, None)
        for j in sel.joins:
            other = self.catalog[j.table]
            rows, _ = other.frame()
            if other.table:
                df, right = joins.join_table(df, sources, rows, j, self.options, self.udfs, windowed)
            else:
                if windowed:
                    if sel.window.filter is not None:
                        ctx = self._exprs(rows, [(j.alias, {c: c for c in rows.columns})])
                        rows = rows.where(ctx.predicate(sel.window.filter))
                    rows = self._assign(rows, replace(sel.window, filter=None), None, None)
                if "asof" in j.kind:
                    df, right = joins.join_asof(df, sources, rows, j, self.options, self.udfs)
                else:
                    df, right = joins.join_window(df, sources, rows, j, self.options, self.udfs)
            sources.append((j.alias, right))
        return df, sources, windowed

    def _analytic(self, df: DataFrame, sources, nodes, known, over=None) -> DataFrame:
        """Adds a column for each state call in the nodes; equal calls share one."""
        if over is None:
            df = self._whole_stream(df, sources, nodes, known)
        for e in nodes:
            for n in A.walk(e) if e is not None else ():
                if not isinstance(n, A.Call) or n in known or n.name == "changed_cols":
                    continue
                if n.name not in ANALYTIC or n.name == "row_number" and over is not None:
                    continue
                ctx = self._exprs(df, sources, known)
                name = f"__v{len(known)}"
                if n.name in analytic.PATTERNS:
                    df, known[n] = analytic.with_pattern(df, ctx, n, name)
                    continue
                staged: list[Column] = []
                ctx.stage = lambda c: (staged.append(c), F.col(f"{name}s"))[1]  # noqa: B023
                v = analytic.compile_call(ctx, n) if over is None else analytic.compile_call(ctx, n, ("__we", "__ord"), over)
                # a window function over another one needs that one as a column first
                for c in staged:
                    df = df.withColumn(f"{name}s", c)
                df = df.withColumn(name, v.c)
                known[n] = Val(F.col(name), v.t, v.nullable)
        return df

    def _whole_stream(self, df: DataFrame, sources, nodes, known) -> DataFrame:
        """Adds the state calls without PARTITION BY that blocks of the stream can keep, all in one step."""
        ordered, later = None, []
        for n in (n for e in nodes if e is not None for n in A.walk(e)):
            # calls within calls come one by one
            inner = any(isinstance(x, A.Call) and x.name in ANALYTIC for x in list(A.walk(n))[1:])
            if not isinstance(n, A.Call) or n.name not in ANALYTIC or n.partition or n in known or inner or any(n == x for x, _ in later):
                continue
            ordered = ordered or Ordered(df)
            made = analytic.whole_stream(ordered, self._exprs(df, sources, known), n, f"__u{len(later)}")
            if made is not None:
                later.append((n, made))
        if not later:
            return df
        known.update((n, made()) for n, made in later)
        return ordered.done()

    # -- groups

    def _grouped(self, sel: A.Select, df: DataFrame, sources, known, outer) -> DataFrame:
        ctx = self._exprs(df, sources, known)
        ctx.aggregate_val = lambda c: Val(c, df.groupBy().agg(c.alias("x")).schema[0].dataType)
        ord_ = F.struct("__ts", "__seq")
        keys = [(k, ctx.compile(k)) for k in sel.keys]
        nodes = [*(i.expr for i in sel.items), sel.having, *(e for e, _ in sel.order)]
        above: dict[A.Node, Val] = {}
        columns: list[Column] = [F.min(ord_).alias("__ord")]
        key_columns = []
        for i, (k, v) in enumerate(keys):
            key_columns.append(v.c.alias(f"__k{i}"))
            above[k] = Val(F.col(f"__k{i}"), v.t, v.nullable)
        bare: dict[str, Val] = {}
        star = False
        late: list[str] = []

        def visit(e) -> None:
            nonlocal star
            if e is None or e in above:
                return
            if isinstance(e, A.Call) and e.name in ("last_agg_hit_count", "last_agg_hit_time"):
                above[e] = Val(F.col(f"__{e.name}"), LONG, False)
                late.append(e.name)
                return
            if isinstance(e, A.Call) and e.name in AGGREGATES and e.partition is None:
                v = aggregates.compile_call(ctx, e, ord_)
                name = f"__a{len(columns)}"
                columns.append(v.c.alias(name))
                above[e] = Val(F.col(name), v.t, v.nullable)
                return
            if isinstance(e, A.Star):
                star = True
                for node, _ in e.replaced:
                    visit(node)
                return
            if isinstance(e, A.Ident):
                v = ctx.compile(e)
                name = f"__b{len(bare)}"
                bare[name] = v
                above[e] = Val(F.col(name), v.t)
                return
            for child in (getattr(e, f) for f in e.__dataclass_fields__) if isinstance(e, A.Node) else e if isinstance(e, tuple) else ():
                if isinstance(child, A.Node | tuple):
                    visit(child)

        for e in nodes:
            visit(e)
        columns += [F.min_by(v.c, ord_).alias(n) for n, v in bare.items()]
        if star:
            public = Scope(df, sources).public()
            columns.append(F.min_by(F.struct(*[quoted(p).alias(n) for n, p in public]), ord_).alias("__row"))
        df = self._sound(df, ctx.errors, sel.source)
        out = df.groupBy("__w", "__ws", "__we", *key_columns).agg(*columns)
        columns_above = {"__ws": "__ws", "__we": "__we"}
        if star:
            out = out.select("*", *[F.col("__row")[n].alias(f"{n}") for n, _ in public if n not in out.columns]).drop("__row")
            columns_above = {n: n for n, _ in public} | columns_above
        for name in late:
            w = Window.orderBy("__we", "__ord")
            # windows are few beside rows; they are numbered in one order
            c = F.row_number().over(w).cast("long") - 1 if name == "last_agg_hit_count" else F.coalesce(F.lag("__we").over(w), F.lit(0))
            out = out.withColumn(f"__{name}", c)
        over = [above[k] for k, _ in keys]
        out = self._analytic(out, [(sel.alias, columns_above)], [*outer, *(i.expr for i in sel.items)], above, over)
        if sel.having is not None:
            hctx = self._exprs(out, [(sel.alias, columns_above)], above)
            out = out.where(hctx.predicate(sel.having))
        return self._project(sel, out.withColumn("__seq", F.col("__ord")), [(sel.alias, columns_above)], above)

    def _framed(self, sel: A.Select, df: DataFrame, sources, known) -> DataFrame:
        """Sliding windows as two running frames: no row is paired with a trigger, and none is read once a window.

        Rows are dealt by stretches of the window's length, each with the stretch before
        it.  A window is the start of its trigger's stretch, up to the trigger, and the
        end of the stretch before, from the trigger's time less the length.
        """
        (size,) = windows.lengths(sel.window)
        ctx = self._exprs(df, sources, known)
        if sel.window.filter is not None:
            df = df.where(ctx.predicate(sel.window.filter))
        on = F.lit(True) if sel.window.when is None else F.coalesce(ctx.predicate(sel.window.when), F.lit(False))
        nodes = [e for e in (*(i.expr for i in sel.items), sel.having, *(e for e, _ in sel.order)) if e is not None]
        calls = list(dict.fromkeys(n for e in nodes for n in A.walk(e) if isinstance(n, A.Call) and n.name in FRAMED))
        values = [Val(F.lit(1).cast("long"), LONG) if isinstance(c.args[0], A.Star) else ctx.compile(c.args[0]) for c in calls]
        df = self._sound(df, ctx.errors, sel.source).where("__ts is not null")
        if size <= 0:
            df = df.where("false")
        inputs = [aggregates.as_long(v) if c.name == "sum" and v.is_int else aggregates.as_double(v) if c.name in ("sum", "avg") else v.c for c, v in zip(calls, values)]
        length = F.lit(max(size, 1)).cast("long")
        home = F.call_function("div", F.col("__ts"), length) - F.when((F.col("__ts") < 0) & (F.col("__ts") % length != 0), 1).otherwise(0)
        rows = df.select("__ts", "__seq", on.alias("__on"), home.alias("__home"), *[x.alias(f"__x{i}") for i, x in enumerate(inputs)])
        rows = rows.withColumn("__b", F.explode(F.array(F.col("__home"), F.col("__home") + 1)))
        own = F.col("__b") == F.col("__home")
        upto = Window.partitionBy("__b").orderBy("__ts", "__seq").rowsBetween(Window.unboundedPreceding, 0)
        # a trigger stands after the rows of its window's first time, backwards
        since = Window.partitionBy("__b").orderBy(F.desc(F.when(own, F.col("__ts") - size).otherwise(F.col("__ts"))), own).rowsBetween(Window.unboundedPreceding, 0)
        above: dict[A.Node, Val] = {}
        out: dict[str, Column] = {}
        starts: dict[str, Column] = {}
        ends: dict[str, Column] = {}
        either = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

        def both(f, x: Column, name: str) -> tuple[Column, Column]:
            starts[f"__p{name}"], ends[f"__q{name}"] = f(F.when(own, x)).over(upto), f(F.when(~own, x)).over(since)
            return F.col(f"__p{name}"), F.col(f"__q{name}")

        for i, (c, v) in enumerate(zip(calls, values)):
            x = F.col(f"__x{i}")
            if c.name in ("count", "avg"):
                count = sum(both(F.count, x, f"n{i}"), F.lit(0)).cast("long")
            if c.name == "count":
                total, kind = count, LONG
            elif c.name in ("min", "max"):
                total, kind = (F.least if c.name == "min" else F.greatest)(*both(F.min if c.name == "min" else F.max, x, f"{i}")), v.t
            elif c.name == "sum" and v.is_int:
                # a part may be beyond 64 bits where the whole is not
                total, kind = either(*both(F.sum, x.cast("decimal(20,0)"), f"{i}")).try_cast("long"), LONG
            else:
                total, kind = either(*both(F.sum, x, f"{i}")), DOUBLE
                total = total / F.when(count > 0, count) if c.name == "avg" else total
            out[f"__a{i}"] = total
            above[c] = Val(F.col(f"__a{i}"), kind, c.name != "count")
        order = F.struct("__ts", "__seq")
        found = rows.withColumns(starts).where("__on or __b > __home").withColumns(ends).where("__b = __home").withColumns(out)
        found = found.select(order.alias("__w"), (F.col("__ts") - size).alias("__ws"), F.col("__ts").alias("__we"), order.alias("__seq"), *out)
        named = [(sel.alias, {"__ws": "__ws", "__we": "__we"})]
        if sel.having is not None:
            found = found.where(self._exprs(found, named, above).predicate(sel.having))
        return self._project(sel, found, named, above)

    # -- output

    def _project(self, sel: A.Select, df: DataFrame, sources, known) -> DataFrame:
        prefix, unnamed = self.options.get("unnamed_prefix", "field_"), 0
        ctx = self._exprs(df, sources, known)
        if sel.window is None:
            # without a window an aggregate is that of its one row
            for n in (n for i in sel.items for n in A.walk(i.expr)):
                if isinstance(n, A.Call) and n.name in AGGREGATES and n.name != "row_number" and n not in known:
                    known[n] = aggregates.single_row(ctx, n)
        out: dict[str, Column] = {}
        generators: list[tuple[str, Val]] = []
        for item in sel.items:
            e = item.expr
            if isinstance(e, A.Star):
                out |= self._star(ctx, e)
                continue
            if isinstance(e, A.Call) and e.name in WIDENING:
                if e.name == "changed_cols":
                    out |= {n: v.c for n, v in analytic.changed_columns(ctx, e)}
                    continue
                v = ctx.compile(e.args[0])
                if e.name == "extract":
                    if not isinstance(v.t, T.StructType):
                        raise CompileError("extract takes an object with known fields")
                    out |= {n: v.c[n] for n in v.t.names}
                else:
                    generators.append((item.alias or "unnest", v))
                continue
            v = ctx.item(e)
            name = item.alias or analytic.output_name(e)
            if not name:
                name, unnamed = f"{prefix}{unnamed}", unnamed + 1
            out[name] = v.c
        order = []
        for e, down in sel.order:
            alias = e.name if isinstance(e, A.Ident) and not e.path and e.name in out else None
            c = out[alias] if alias else ctx.compile(e).c
            order.append((f"__s{len(order)}", c, down))
        df = self._sound(df, ctx.errors, sel.source)
        keep = [c for c in INTERNAL if c in df.columns]
        renamed = {n: f"__out.{n}" for n in out}
        df = df.select(*[c.alias(renamed[n]) for n, c in out.items()], *[v.c.alias(f"__g{i}") for i, (_, v) in enumerate(generators)], *[c.alias(n) for n, c, _ in order], *keep)
        sort = [F.desc(n) if down else F.asc(n) for n, _, down in order]
        if sel.limit is not None:
            if "__w" in df.columns:
                place = Window.partitionBy("__w").orderBy(*sort, "__seq")
                df = df.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= sel.limit)
            else:
                df = (df.orderBy(*sort) if sort else df).limit(sel.limit)
        elif sort:
            df = df.orderBy(*(["__we"] if "__we" in df.columns else []), *sort)
        final = {n: quoted(p) for n, p in renamed.items()}
        for i, (name, v) in enumerate(generators):
            if not v.is_array:
                final[name] = F.col(f"__g{i}")
                continue
            df = df.withColumn(f"__g{i}", F.explode(f"__g{i}"))
            if isinstance(v.t.elementType, T.StructType):
                final |= {n: F.col(f"__g{i}")[n] for n in v.t.elementType.names}
            else:
                final[name] = F.col(f"__g{i}")
        return df.select(*[c.alias(n) for n, c in final.items()])

    def _star(self, ctx: Expressions, e: A.Star) -> dict[str, Column]:
        if e.source is None:
            columns = {n: quoted(p) for n, p in ctx.scope.public()}
        else:
            found = ctx.scope.source(e.source)
            if found is not None:
                columns = {n: quoted(p) for n, p in found.items() if not n.startswith("__")}
            else:
                v = ctx.compile(A.Ident(e.source))
                if not isinstance(v.t, T.StructType):
                    raise CompileError(f"{e.source} is neither a source nor an object")
                columns = {n: v.c[n] for n in v.t.names}
        replaced = {name: ctx.compile(node).c for node, name in e.replaced}
        columns = {n: c for n, c in columns.items() if n not in e.excluded or n in replaced}
        return columns | replaced
