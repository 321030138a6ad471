"""Expressions to Columns, with the dialect's value rules.

Comparisons with null are false, AND and OR with a null side are false, NOT of null is
null; whole-number division truncates, and division by zero is a row error; sums of
whole numbers saturate.  `Val.raw` keeps the plain form of a predicate for places where
null and false mean the same (WHERE, HAVING, ON), so that filters still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from brookql.functions import AGGREGATES, ANALYTIC, FUNCTIONS
from brookql.functions.arrays import sliced
from brookql.functions.values import BOOL, DOUBLE, LONG, STRING, CompileError, Val, as_bool, as_double, as_long, as_string, boolean, clamp_index, double, long, null
from brookql.plans import ast as A

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Scope:
    """The columns an expression can see: physical names by source and name."""

    def __init__(self, df: DataFrame, sources: list[tuple[str, dict[str, str]]]) -> None:
        self.df, self.sources = df, sources
        self.types = {f.name: f.dataType for f in df.schema}

    def find(self, name: str) -> str | None:
        for _, columns in self.sources:
            if name in columns:
                return columns[name]
        for _, columns in self.sources:
            for c, physical in columns.items():
                if c.lower() == name.lower():
                    return physical
        return None

    def source(self, alias: str) -> dict[str, str] | None:
        return next((c for a, c in self.sources if a.lower() == alias.lower()), None)

    def public(self) -> list[tuple[str, str]]:
        """(name, physical) of all columns, the leftmost source first, without internal ones."""
        out: dict[str, str] = {}
        for _, columns in self.sources:
            for c, physical in columns.items():
                if not c.startswith("__"):
                    out.setdefault(c, physical)
        return list(out.items())


class Expressions:
    """Compiles nodes within a scope; `known` maps nodes that were computed before to their values."""

    def __init__(self, scope: Scope, options: dict | None = None, udfs: dict | None = None, known: dict[A.Node, Val] | None = None) -> None:
        self.scope, self.options, self.udfs = scope, options or {}, udfs or {}
        self.known = {} if known is None else known
        self.errors: list[Column] = []
        self.guards: list[Column] = []

    # -- services for functions

    def val(self, c: Column) -> Val:
        """A value whose type Spark works out."""
        try:
            return Val(c, self.scope.df.select(c.alias("x")).schema[0].dataType)
        except AnalysisException as e:
            if "lambda" in str(e).lower() or "UNRESOLVED" in str(e):
                return Val(c, STRING)
            raise CompileError(str(e).splitlines()[0]) from e

    def literal(self, v: Val):
        return v.lit

    def error(self, c: Column) -> None:
        for g in self.guards:
            c = F.when(g, c)
        self.errors.append(c)

    def event_time(self) -> Val:
        for name in ("timestamp", "event_time"):
            if (physical := self.scope.find(name)) is not None:
                return Val(quoted(physical), self.scope.types[physical])
        return long(F.col("__ts")) if "__ts" in self.scope.types else null()

    def metadata(self, key: str | None) -> Val:
        physical = self.scope.find("__meta")
        if physical is None:
            return null()
        v = Val(quoted(physical), self.scope.types[physical])
        if key in (None, "*"):
            return v
        if isinstance(v.t, T.StructType):
            name = next((n for n in v.t.names if n.lower() == key.lower()), None)
            return null() if name is None else Val(v.c[name], v.t[name].dataType)
        return self.field(v, key)

    def window_bound(self, which: str) -> Val:
        physical = {"start": "__ws", "end": "__we"}[which]
        return long(F.col(physical)) if physical in self.scope.types else long(F.lit(None).cast("long"))

    def apply(self, name: str, args: list[Val]) -> Val:
        f = FUNCTIONS.get(name)
        if f is None:
            if name in self.udfs:
                return self.val(self.udfs[name](*[a.c for a in args]))
            raise CompileError(f"unknown function {name}")
        if len(args) < f.low or f.high is not None and len(args) > f.high:
            return null()
        if f.compile is None:
            raise CompileError(f"{name} cannot stand here")
        return f.compile(self, *args)

    # -- nodes

    def compile(self, e: A.Node) -> Val:
        if e in self.known:
            return self.known[e]
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def item(self, e: A.Node) -> Val:
        """A SELECT item: plain arithmetic with a division in it is done in doubles throughout."""
        if e not in self.known and _plain(e) and any(isinstance(n, A.Binary) and n.op == "/" for n in A.walk(e)):
            return self._in_doubles(e)
        return self.compile(e)

    def predicate(self, e: A.Node) -> Column:
        """A filter condition; null means no."""
        v = self.compile(e)
        if not (v.is_bool or v.is_null or v.is_variant):
            raise CompileError("a condition must be boolean")
        return v.raw if v.raw is not None else as_bool(v)

    def _in_doubles(self, e: A.Node) -> Val:
        if isinstance(e, A.Binary):
            a, b = self._in_doubles(e.left).c, self._in_doubles(e.right).c
            if e.op == "/":
                self.error(F.when(b == 0, F.lit("divided by zero")))
                return double(F.try_divide(a, b))
            return double({"+": a + b, "-": a - b, "*": a * b}[e.op])
        return double(as_double(self.compile(e)))

    def _lit(self, e: A.Lit) -> Val:
        x = e.value
        if x is None:
            return null()
        if isinstance(x, bool):
            return Val(F.lit(x), BOOL, False, None, x)
        if isinstance(x, int):
            if not MIN <= x <= MAX:
                return Val(F.lit(float(x)), DOUBLE, False, None, float(x))
            return Val(F.lit(x).cast("long"), LONG, False, None, x)
        return Val(F.lit(x), DOUBLE if isinstance(x, float) else STRING, False, None, x)

    def _ident(self, e: A.Ident) -> Val:
        name, path = e.name, list(e.path)
        physical = self.scope.find(name)
        if path and (physical is None or not isinstance(self.scope.types[physical], T.StructType | T.MapType | T.VariantType)):
            flat = self.scope.find(".".join([name, *path]))
            columns = self.scope.source(name)
            if flat is not None:
                physical, path = flat, []
            elif columns is not None:
                physical = columns.get(path[0]) or next((p for c, p in columns.items() if c.lower() == path[0].lower()), None)
                path = path[1:]
        if physical is None:
            if self.options.get("strict"):
                raise CompileError(f"unknown column {'.'.join([name, *e.path])}")
            return null()
        v = Val(quoted(physical), self.scope.types[physical])
        for p in path:
            v = self.field(v, p)
        return v

    def field(self, v: Val, name: str) -> Val:
        if isinstance(v.t, T.StructType):
            found = next((n for n in v.t.names if n == name), None) or next((n for n in v.t.names if n.lower() == name.lower()), None)
            return null() if found is None else Val(v.c[found], v.t[found].dataType)
        if isinstance(v.t, T.MapType):
            return Val(F.try_element_at(v.c, F.lit(name)), v.t.valueType)
        if v.is_variant:
            return Val(F.try_variant_get(v.c, f"$['{name}']", "variant"), v.t)
        return null()

    def _field(self, e: A.Field) -> Val:
        return self.field(self.compile(e.arg), e.name)

    def element(self, v: Val, i: Val) -> Val:
        if v.is_array:
            return Val(F.get(v.c, clamp_index(as_long(i), F.size(v.c))), v.t.elementType)
        if isinstance(v.lit if v.is_string else i.lit, str) and not v.is_string:
            return self.field(v, i.lit)
        if isinstance(v.t, T.MapType):
            return Val(F.try_element_at(v.c, as_string(i)), v.t.valueType)
        if v.is_variant and isinstance(i.lit, int) and i.lit >= 0:
            return Val(F.try_variant_get(v.c, f"$[{i.lit}]", "variant"), v.t)
        return null()

    def _index(self, e: A.Index) -> Val:
        return self.element(self.compile(e.arg), self.compile(e.at))

    def _slice(self, e: A.Slice) -> Val:
        v = self.compile(e.arg)
        if not v.is_array:
            return null()
        size = F.size(v.c)
        bound = lambda x, default: default if x is None else F.when((i := as_long(self.compile(x))) < 0, i + size).otherwise(i)
        return sliced(self, v, bound(e.low, F.lit(0)), bound(e.high, size))

    def _star(self, e: A.Star) -> Val:
        return self.val(F.struct(*[quoted(p).alias(n) for n, p in self.scope.public()]))

    def _unary(self, e: A.Unary) -> Val:
        v = self.compile(e.arg)
        if e.op == "not":
            b = as_bool(v)
            return boolean(~b, v.nullable)
        if v.is_int:
            x = as_long(v)
            return long(F.when(x == MIN, F.lit(MAX)).otherwise(-F.when(x != MIN, x)), v.nullable)
        return double(-as_double(v))

    def _binary(self, e: A.Binary) -> Val:
        a, b = self.compile(e.left), self.compile(e.right)
        if e.op in ("and", "or"):
            x, y = as_bool(a), as_bool(b)
            rx, ry = a.raw if a.raw is not None else x, b.raw if b.raw is not None else y
            plain = (x & y) if e.op == "and" else (x | y)
            exact = plain if not (a.nullable or b.nullable) else F.when(x.isNull() | y.isNull(), False).otherwise(plain)
            # OR keeps its plain form only if no side is ever null
            raw = (rx & ry) if e.op == "and" else (rx | ry) if not (a.nullable or b.nullable) else None
            return boolean(exact, False, raw)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(e.op, a, b)
        if e.op == "like":
            if not (a.is_string or a.is_variant) or not b.is_string:
                return boolean(F.lit(False), False) if not (a.is_null or b.is_null) else boolean(F.lit(None).cast("boolean"))
            s = as_string(a)
            c = s.like(b.lit) if isinstance(b.lit, str) else F.like(s, b.c)
            return boolean(c, True, c)
        if e.op in ("&", "|", "^"):
            f = {"&": "bitwiseAND", "|": "bitwiseOR", "^": "bitwiseXOR"}[e.op]
            if a.is_bool and b.is_bool:
                x, y = a.c, b.c
                return boolean({"&": x & y, "|": x | y, "^": x != y}[e.op])
            return long(getattr(as_long(a), f)(as_long(b)))
        return self.arithmetic(e.op, a, b)

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        for v in (a, b):
            if not (v.is_number or v.is_null or v.is_variant):
                self.error(F.when(a.c.isNotNull() & b.c.isNotNull(), F.lit(f"{op}: not a number")))
                return double(F.lit(None).cast("double"))
        if a.is_null or b.is_null:
            return null()
        if a.is_int and b.is_int:
            x, y = as_long(a), as_long(b)
            if op in ("/", "%"):
                self.error(F.when(y == 0, F.lit("divided by zero")))
                safe = F.when(y != 0, y)
                if op == "%":
                    return long(x % safe)
                # the one quotient that overflows saturates
                q = _div(F.when(~((x == MIN) & (safe == -1)), x), safe)
                return long(F.when((x == MIN) & (safe == -1), F.lit(MAX)).otherwise(q))
            c = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
            if _small(a, b):
                return long({"+": x + y, "-": x - y, "*": x * y}[op])
            negative = {"+": y < 0, "-": y > 0, "*": (x < 0) != (y < 0)}[op]
            limit = F.when(negative, F.lit(MIN)).otherwise(F.lit(MAX))
            return long(F.coalesce(c, F.when(x.isNotNull() & y.isNotNull(), limit)))
        x, y = as_double(a), as_double(b)
        if op in ("/", "%"):
            self.error(F.when(y == 0, F.lit("divided by zero")))
            safe = y if b.lit else F.when(y != 0, y)
            return double(x / safe if op == "/" else x % safe)
        return double({"+": x + y, "-": x - y, "*": x * y}[op])

    def compare(self, op: str, a: Val, b: Val) -> Val:
        if a.is_null or b.is_null:
            return boolean(F.lit(False), False, F.lit(False))
        if a.is_variant or b.is_variant:
            other = b if a.is_variant else a
            cast = as_double if other.is_number else as_bool if other.is_bool else as_string
            x, y = cast(a), cast(b)
        elif a.is_number and b.is_number:
            whole = a.is_int and b.is_int
            # equality of whole numbers is exact; order is that of doubles, which differs only beyond 2**53
            x, y = (as_long(a), as_long(b)) if whole else (as_double(a), as_double(b))
        elif a.t == b.t or a.is_string and b.is_string:
            x, y = a.c, b.c
        else:
            self.error(F.when(a.c.isNotNull() & b.c.isNotNull(), F.lit(f"cannot compare {a.t.simpleString()} with {b.t.simpleString()}")))
            return boolean(F.lit(False), False, F.lit(False))
        c = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return boolean(F.coalesce(c, F.lit(False)), False, c)

    def _between(self, e: A.Between) -> Val:
        v, low, high = self.compile(e.arg), self.compile(e.low), self.compile(e.high)
        both = self.compare(">=", v, low), self.compare("<=", v, high)
        inside = both[0].raw & both[1].raw
        c = ~inside if e.negated else inside
        return boolean(F.coalesce(c, F.lit(False)), False, c)

    def _inlist(self, e: A.InList) -> Val:
        v = self.compile(e.arg)
        items = [self.compile(x) for x in e.items]
        hits = [self._equal(v, x) for x in items]
        if v.is_string and items and all(x.is_string and x.lit is not None for x in items):
            raw = v.c.isin([x.lit for x in items])
        else:
            raw = F.lit(False)
            for h in hits:
                raw = raw | h
        c = F.coalesce(raw, F.lit(False))
        return boolean(~c, False, ~c) if e.negated else boolean(c, False, raw)

    def _equal(self, a: Val, b: Val) -> Column:
        """Equality that is false, not an error, between different types."""
        if a.is_null or b.is_null:
            return F.lit(False)
        if a.is_variant or b.is_variant or a.is_number and b.is_number or a.t == b.t:
            return self.compare("=", a, b).c
        return F.lit(False)

    def _isnull(self, e: A.IsNull) -> Val:
        v = self.compile(e.arg)
        c = v.c.isNotNull() if e.negated else v.c.isNull()
        return boolean(c, False, c)

    def _case(self, e: A.Case) -> Val:
        out: list[tuple[Column, Val]] = []
        operand = None if e.operand is None else self.compile(e.operand)
        before: Column | None = None
        for condition, result in e.arms:
            c = self._equal(operand, self.compile(condition)) if operand is not None else F.coalesce(as_bool(self.compile(condition)), F.lit(False))
            # errors of a branch count only where it is taken
            self.guards.append(c if before is None else ~before & c)
            out.append((c, self.compile(result)))
            self.guards.pop()
            before = c if before is None else before | c
        self.guards.append(~before)
        default = null() if e.default is None else self.compile(e.default)
        self.guards.pop()
        kinds = {v.t for v in [*(v for _, v in out), default] if not v.is_null}
        if not kinds:
            return null()
        if len(kinds) == 1:
            cast, t = (lambda v: v.c), kinds.pop()
        elif all(isinstance(k, T.NumericType) for k in kinds):
            cast, t = as_double, DOUBLE
        else:
            cast, t = as_string, STRING
        chain = None
        for c, v in out:
            chain = F.when(c, cast(v)) if chain is None else chain.when(c, cast(v))
        return Val(chain.otherwise(cast(default) if not default.is_null else F.lit(None)), t)

    def _call(self, e: A.Call) -> Val:
        if e.name in AGGREGATES or e.name in ANALYTIC:
            raise CompileError(f"{e.name} cannot stand here")
        return self.apply(e.name, [self.compile(a) for a in e.args])


def _div(x: Column, y: Column) -> Column:
    """Exact whole division, truncated toward zero."""
    return F.call_function("div", x, y)


def _plain(e: A.Node) -> bool:
    if isinstance(e, A.Binary):
        return e.op in "+-*/" and _plain(e.left) and _plain(e.right)
    return isinstance(e, A.Ident) or isinstance(e, A.Lit) and isinstance(e.value, int | float) and not isinstance(e.value, bool)


def _small(a: Val, b: Val) -> bool:
    """Whether both are literals, whose sum or product cannot overflow unnoticed."""
    return isinstance(a.lit, int) and isinstance(b.lit, int) and abs(a.lit) < 1 << 31 and abs(b.lit) < 1 << 31

