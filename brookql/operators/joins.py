"""Joins: lookups of tables, streams within a window, and the latest row as of a time.

Every stream's columns are named `alias.column`; bare names mean the leftmost owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookql.functions.values import DOUBLE, LONG, CompileError, Val, as_double, as_long
from brookql.operators.ordering import Ordered
from brookql.plans import ast as A
from brookql.plans.expressions import Expressions, Scope, quoted


def named(df: DataFrame, alias: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its public columns as alias.column, and the mapping."""
    columns = {c: f"{alias}.{c}" for c in df.columns if c not in ("__ts", "__seq")}
    return df.select(*[quoted(c).alias(p) for c, p in columns.items()], "__ts", "__seq"), columns


def conjuncts(e: A.Node | None) -> list[A.Node]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Binary) and e.op == "and" else [e]


def _sides(e: A.Node, right: dict[str, str], alias: str, left: list[tuple[str, dict[str, str]]]):
    """("left" / "right" / "both") that an expression's columns are of."""
    seen = set()
    for n in A.walk(e):
        if isinstance(n, A.Ident):
            if n.path and n.name.lower() == alias.lower() and n.path[0] in right:
                seen.add("right")
            elif n.path and any(a.lower() == n.name.lower() for a, _ in left):
                seen.add("left")
            else:
                seen.add("left" if any(n.name in c for _, c in left) else "right")
    return "both" if len(seen) == 2 else seen.pop() if seen else "none"


def equal_keys(on: A.Node | None, right: dict[str, str], alias: str, left: list[tuple[str, dict[str, str]]]):
    """[(left node, right node)] of ON's equalities between the sides, and the other conditions."""
    pairs, rest = [], []
    for c in conjuncts(on):
        if isinstance(c, A.Binary) and c.op == "=":
            a, b = _sides(c.left, right, alias, left), _sides(c.right, right, alias, left)
            if (a, b) == ("left", "right"):
                pairs.append((c.left, c.right))
                continue
            if (a, b) == ("right", "left"):
                pairs.append((c.right, c.left))
                continue
        rest.append(c)
    return pairs, rest


MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def order_bound(rest: list[A.Node], right: dict[str, str], alias: str, left: list[tuple[str, dict[str, str]]]):
    """(left node, comparison, right node) of the one condition between the sides, and the left's and the right's own conditions; None where ON has others."""
    bound, own, theirs = None, [], []
    for c in rest:
        if (side := _sides(c, right, alias, left)) != "both":
            (own if side == "left" else theirs).append(c)
            continue
        if bound is not None or not isinstance(c, A.Binary) or c.op not in MIRRORED:
            return None
        match _sides(c.left, right, alias, left), _sides(c.right, right, alias, left):
            case "left", "right":
                bound = c.left, c.op, c.right
            case "right", "left":
                bound = c.right, MIRRORED[c.op], c.left
            case _:
                return None
    return None if bound is None else (bound, own, theirs)


def _place(v: Val, whole: bool, down: bool, after: int) -> list[Column]:
    """__ts and __seq by which Ordered sorts a value (down: the largest first); of equal ones, those with after = 0 come first."""
    if whole:
        x = as_long(v)
        return [(F.bitwise_not(x) if down else x).alias("__ts"), F.lit(after).cast("long").alias("__seq")]
    x, inf = as_double(v), F.lit(float("-inf") if down else float("inf"))
    # NaN is above all numbers, as in comparisons
    beyond = F.when(F.isnan(x), 0 if down else 2).otherwise(2 if down else 0)
    return [F.when(F.isnan(x), inf).otherwise((-x if down else x) + 0.0).alias("__ts"), (beyond + after).cast("long").alias("__seq")]


def first_beyond(df: DataFrame, rows: DataFrame, a: Val, op: str, b: Val, how: str) -> DataFrame:
    """df (value a) with the first of rows (value b), by __tseq, for which `a op b` holds; a null finds none.

    Distinct values of both sides are sorted together once, by blocks; the first row is
    then a running minimum, and no value of one side is paired with those of the other.
    """
    whole, down, strict = a.is_int and b.is_int, op in ("<", "<="), op in ("<", ">")
    names = rows.drop("__tseq").columns
    value = as_long(a) if whole else as_double(a)
    df = df.withColumn("__y", value)
    asked = df.select("__y").where("__y is not null").distinct()
    asked = asked.select("__y", *_place(Val(F.col("__y"), LONG if whole else DOUBLE), whole, down, int(not strict)))
    offered = rows.select(*_place(b, whole, down, int(strict)), F.struct(F.col("__tseq").alias("q"), F.struct(*[quoted(c) for c in names]).alias("row")).alias("__row")).where("__ts is not null")
    offered = offered.groupBy("__ts", "__seq").agg(F.min_by("__row", "__row.q").alias("__row"))
    first = lambda c: F.min_by(c, c["q"])
    o = Ordered(asked.unionByName(offered, allowMissingColumns=True))
    own = first(F.col("__row")).over(o.within.rowsBetween(Window.unboundedPreceding, 0))
    o._add("__first", first(F.col("__row")), lambda t, before: first(t).over(before), lambda k: F.when(k.isNull() | (own["q"] < k["q"]), own).otherwise(k))
    found = o.done().where("__y is not null and __first is not null").select(F.col("__y").alias("__found"), F.col("__first")["row"].alias("__row"))
    out = df.join(found, F.col("__y") == F.col("__found"), how)
    return out.select(*[quoted(c) for c in df.columns if c != "__y"], *[F.col("__row")[c].alias(c) for c in names])


def join_table(df: DataFrame, left, table: DataFrame, join: A.Join, options, udfs, windowed: bool):
    """Join a table: of the rows that satisfy ON, the first in the table's order."""
    rows, right = named(table, join.alias)
    rows = rows.withColumnRenamed("__seq", "__tseq").drop("__ts")
    pairs, rest = equal_keys(join.on, right, join.alias, left)
    # beside windows only LEFT keeps rows without a partner
    outer = join.kind == "left" or join.kind == "full" and windowed
    how = "left" if outer else "inner"
    if join.kind == "cross" and windowed:
        return df.crossJoin(rows.drop("__tseq")), right
    only_right = [c for c in rest if _sides(c, right, join.alias, left) in ("right", "none")]
    if len(only_right) == len(rest) and pairs:
        # equalities alone: the first row of each key is the only candidate, so the table shrinks before the join
        own = Expressions(Scope(rows, [(join.alias, right)]), options, udfs)
        for c in only_right:
            rows = rows.where(own.predicate(c))
        keys = [own.compile(r).c for _, r in pairs]
        first = Window.partitionBy(*keys).orderBy("__tseq")
        rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__tseq")
        both = Expressions(Scope(df.limit(0).crossJoin(rows.limit(0)), [*left, (join.alias, right)]), options, udfs)
        on = None
        for a, b in pairs:
            c = both.predicate(A.Binary("=", a, b))
            on = c if on is None else on & c
        return df.join(rows, on, how), right
    if join.on is None:
        # any row matches, so the first one does
        first = rows.orderBy("__tseq").limit(1).drop("__tseq")
        return df.join(F.broadcast(first), F.lit(True), how), right
    both = Expressions(Scope(df.limit(0).crossJoin(rows.limit(0)), [*left, (join.alias, right)]), options, udfs)
    if not pairs and not df.isStreaming and not rows.isStreaming and (found := order_bound(rest, right, join.alias, left)) is not None:
        (x, op, y), mine, theirs = found
        l_exprs, r_exprs = Expressions(Scope(df, left), options, udfs), Expressions(Scope(rows, [(join.alias, right)]), options, udfs)
        a, b = l_exprs.compile(x), r_exprs.compile(y)
        if a.is_number and b.is_number:
            for c in theirs:
                rows = rows.where(r_exprs.predicate(c))
            for c in mine:
                a = Val(F.when(l_exprs.predicate(c), a.c), a.t)
            return first_beyond(df, rows, a, op, b, how), right
    # rows that look alike are told apart by a number of their own, so each finds its partner
    df = df.withColumn("__rid", F.monotonically_increasing_id())
    first = Window.partitionBy("__rid").orderBy("__tseq")
    out = df.join(rows, both.predicate(join.on), how)
    return out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__tseq", "__rid"), right


def join_window(df: DataFrame, left, other: DataFrame, join: A.Join, options, udfs):
    """Join another stream's rows of the same window."""
    keep = [c for c in other.columns if c in ("__ts", "__seq", "__w", "__ws", "__we")]
    right = {c: f"{join.alias}.{c}" for c in other.columns if c not in keep}
    rows = other.select(*[quoted(c).alias(p) for c, p in right.items()], *[F.col(c).alias(f"__r{c[2:]}") for c in keep])
    both = Expressions(Scope(df.limit(0).crossJoin(rows.limit(0)), [*left, (join.alias, right)]), options, udfs)
    on = F.col("__w") == F.col("__rw")
    if join.on is not None and join.kind != "cross":
        on = on & both.predicate(join.on)
    out = df.join(rows, on, {"cross": "inner"}.get(join.kind, join.kind))
    if join.kind in ("right", "full"):
        # rows of the right side alone take their window and order from it
        out = out.withColumns({c: F.coalesce(c, f"__r{c[2:]}") for c in keep})
    return out.drop(*[f"__r{c[2:]}" for c in keep]), right


def join_asof(df: DataFrame, left, other: DataFrame, join: A.Join, options, udfs):
    """The latest right row of equal key at or before each left row's time (of a tie, the later row).

    Both sides are sorted together once by key and time; no row meets more than its own key.
    """
    rows, right = named(other, join.alias)
    pairs, rest = equal_keys(join.on, right, join.alias, left)
    window = [F.col("__w")] if "__w" in df.columns and "__w" in other.columns else []
    if rest:
        raise CompileError("an ASOF join takes equalities only")
    if "__w" in right:
        for c in ("__w", "__ws", "__we"):
            right.pop(c, None)
    l_exprs = Expressions(Scope(df, left), options, udfs)
    r_exprs = Expressions(Scope(rows, [(join.alias, right)]), options, udfs)
    keys = [(l_exprs.compile(a), r_exprs.compile(b)) for a, b in pairs]
    for a, b in keys:
        if not (a.t == b.t or a.is_number and b.is_number):
            raise CompileError("the keys of an ASOF join differ in type")
    as_key = lambda vs: F.struct(F.lit(0).alias("all"), *[(v.c.cast("double") if v.is_number and not (a.is_int and b.is_int) else v.c).alias(f"k{i}") for i, (v, (a, b)) in enumerate(zip(vs, keys))], *window)
    r_cols = list(right.values())
    sides_l = df.withColumns({"__key": as_key([a for a, _ in keys]), "__right": F.lit(1)})
    sides_r = rows.select(as_key([b for _, b in keys]).alias("__key"), F.col("__ts"), F.lit(0).alias("__right"), F.col("__seq").alias("__rseq"), F.struct(*[quoted(c) for c in r_cols]).alias("__row"))
    sides_r = sides_r.where(" and ".join(["__ts is not null", *[f"__key.`{f.name}` is not null" for f in sides_r.schema["__key"].dataType]]))
    together = sides_l.unionByName(sides_r, allowMissingColumns=True)
    w = Window.partitionBy("__key").orderBy("__ts", "__right", "__rseq", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    out = together.withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__right = 1")
    if join.kind == "asof":
        out = out.where(F.col("__row").isNotNull())
    return out.select(*[quoted(c) for c in df.columns], *[F.col("__row")[c].alias(c) for c in r_cols]), right
