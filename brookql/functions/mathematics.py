"""Mathematical functions (35)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brookql.functions.values import Val, as_double, as_long, double, finite, function, long, null, string


@function("abs", 1)
def absolute(ctx, x: Val) -> Val:
    if x.is_int:
        return long(F.abs(as_long(x)))
    if not x.is_number:
        ctx.error(F.when(x.c.isNotNull(), F.lit("abs: not a number")) if not x.is_null else F.lit("abs: not a number"))
    return double(F.abs(as_double(x)))


@function("ceil ceiling", 1)
def ceil(ctx, x: Val) -> Val:
    return double(F.ceil(as_double(x)).cast("double"))


@function("floor", 1)
def floor(ctx, x: Val) -> Val:
    return double(F.floor(as_double(x)).cast("double"))


@function("round", 1, 2)
def rounded(ctx, x: Val, n: Val | None = None) -> Val:
    d = as_double(x)
    scale = F.pow(F.lit(10.0), as_double(n)) if n is not None else F.lit(1.0)
    y = d * scale
    return double(F.signum(y) * F.floor(F.abs(y) + 0.5).cast("double") / scale)


@function("sqrt", 1)
def sqrt(ctx, x: Val) -> Val:
    d = as_double(x)
    ctx.error(F.when(d < 0, F.lit("sqrt: negative argument")))
    return double(F.when(d >= 0, F.sqrt(d)))


@function("power pow", 2)
def power(ctx, x: Val, y: Val) -> Val:
    p = finite(F.pow(as_double(x), as_double(y)))
    if x.is_int and y.is_int:
        # whole numbers stay whole while the exponent is not negative and the result fits
        whole = F.when(F.abs(p) < float(1 << 63), p.try_cast("long"))
        literal = ctx.literal(y)
        if literal is not None:
            return long(whole) if literal >= 0 else double(p)
        return long(F.when(as_long(y) >= 0, whole))
    return double(p)


def _plain(name: str, f):
    @function(name, 1, category="mathematics")
    def run(ctx, x: Val) -> Val:
        return double(finite(f(as_double(x))))


for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "exp", "cosh", "sinh", "tanh", "radians", "degrees"):
    _plain(_name, getattr(F, _name))


@function("atan2", 2)
def atan2(ctx, y: Val, x: Val) -> Val:
    return double(F.atan2(as_double(y), as_double(x)))


@function("ln", 1, 2)
def ln(ctx, x: Val, extra: Val | None = None) -> Val:
    if extra is not None:
        return null()
    d = as_double(x)
    ctx.error(F.when(d <= 0, F.lit("ln: argument must be positive")))
    return double(F.when(d > 0, F.log(d)))


@function("log", 1, 2)
def log(ctx, a: Val, b: Val | None = None) -> Val:
    """log10(a), or the logarithm of b to base a."""
    x = as_double(a if b is None else b)
    if b is None:
        y = F.when(x > 0, F.log10(x))
    else:
        base = as_double(a)
        y = F.when((x > 0) & (base > 0) & (base != 1), F.log(x) / F.log(base))
    near = F.round(y, 0)
    return double(F.when(F.abs(y - near) < 1e-12, near).otherwise(y))


@function("log2", 1)
def log2(ctx, x: Val) -> Val:
    d = as_double(x)
    return double(F.when(d > 0, F.log2(d)))


@function("log10", 1)
def log10(ctx, x: Val) -> Val:
    d = as_double(x)
    return double(F.when(d > 0, F.log10(d)))


@function("sign", 1)
def sign(ctx, x: Val) -> Val:
    return long(F.signum(as_double(x)).cast("long"))


@function("mod", 2)
def mod(ctx, x: Val, y: Val) -> Val:
    return ctx.arithmetic("%", x, y)


@function("cot", 1)
def cot(ctx, x: Val) -> Val:
    d = as_double(x)
    ctx.error(F.when(d == 0, F.lit("cot: argument is zero")))
    return double(F.when(d != 0, F.cot(d)))


@function("bitand", 2)
def bitand(ctx, x: Val, y: Val) -> Val:
    return long(as_long(x).bitwiseAND(as_long(y)))


@function("bitor", 2)
def bitor(ctx, x: Val, y: Val) -> Val:
    return long(as_long(x).bitwiseOR(as_long(y)))


@function("bitxor", 2)
def bitxor(ctx, x: Val, y: Val) -> Val:
    return long(as_long(x).bitwiseXOR(as_long(y)))


@function("bitnot", 1)
def bitnot(ctx, x: Val) -> Val:
    return long(F.bitwise_not(as_long(x)))


@function("pi", 0)
def pi(ctx) -> Val:
    return double(F.lit(math.pi))


@function("rand", 0)
def rand(ctx) -> Val:
    return double(F.rand())


@function("conv", 3)
def conv(ctx, x: Val, a: Val, b: Val) -> Val:
    """x from base a to base b, in lower case; a minus sign is kept."""
    from brookql.functions.values import as_string

    low, high = ctx.literal(a), ctx.literal(b)
    if low is None or high is None or not (2 <= low <= 36 and 2 <= high <= 36):
        return Val(F.lit(None).cast("string"), string(x.c).t)
    s = F.lower(F.trim(as_string(x)))
    digits = F.regexp_replace(s, "^[-+]", "")
    allowed = "0123456789abcdefghijklmnopqrstuvwxyz"[:low]
    out = F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.lower(F.conv(digits, int(low), int(high))))
    return string(F.when(digits.rlike(f"^[{allowed}]+$"), out))


