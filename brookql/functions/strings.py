"""String functions (19)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from brookql.functions.values import Val, as_double, as_long, as_string, boolean, function, long, string

#: White space as Unicode has it; \p{Z} lacks the control characters.
SPACE = r"[\s\p{Z}\x{85}]+"


@function("concat", 1, None)
def concat(ctx, *args: Val) -> Val:
    return string(F.concat(*[F.coalesce(as_string(a), F.lit("")) for a in args]))


@function("lower", 1)
def lower(ctx, x: Val) -> Val:
    return string(F.lower(as_string(x)))


@function("upper", 1)
def upper(ctx, x: Val) -> Val:
    return string(F.upper(as_string(x)))


@function("length", 1)
def length(ctx, x: Val) -> Val:
    if x.is_null:
        return long(F.lit(0))
    if x.is_array or x.t.typeName() == "map":
        size = F.size(x.c)
    elif x.is_object:
        size = F.lit(len(x.t.fields))
    else:
        size = F.char_length(as_string(x))
    return long(F.when(x.c.isNull(), 0).otherwise(size).cast("long"))


@function("trim", 1)
def trim(ctx, x: Val) -> Val:
    return string(F.regexp_replace(as_string(x), f"^{SPACE}|{SPACE}$", ""))


@function("ltrim", 1)
def ltrim(ctx, x: Val) -> Val:
    return string(F.regexp_replace(as_string(x), f"^{SPACE}", ""))


@function("rtrim", 1)
def rtrim(ctx, x: Val) -> Val:
    return string(F.regexp_replace(as_string(x), f"{SPACE}$", ""))


def _pad(x: Val, n: Val, pad: Val | None, left: bool) -> Val:
    s, k = as_string(x), as_long(n).cast("int")
    if pad is None:
        # two arguments: n blanks beside the text
        blanks = F.repeat(F.lit(" "), F.greatest(k, F.lit(0)))
        return string(F.concat(blanks, s) if left else F.concat(s, blanks))
    more = F.repeat(F.substring(as_string(pad), 1, 1), F.greatest(k - F.char_length(s), F.lit(0)))
    return string(F.concat(more, s) if left else F.concat(s, more))


@function("lpad", 2, 3)
def lpad(ctx, x: Val, n: Val, pad: Val | None = None) -> Val:
    return _pad(x, n, pad, True)


@function("rpad", 2, 3)
def rpad(ctx, x: Val, n: Val, pad: Val | None = None) -> Val:
    return _pad(x, n, pad, False)


@function("replace", 3)
def replace(ctx, x: Val, old: Val, new: Val) -> Val:
    return string(F.replace(as_string(x), as_string(old), as_string(new)))


@function("split", 2)
def split(ctx, x: Val, sep: Val) -> Val:
    return ctx.val(F.split(as_string(x), F.concat(F.lit("\\Q"), as_string(sep), F.lit("\\E"))))


@function("reverse", 1)
def reverse(ctx, x: Val) -> Val:
    return string(F.reverse(as_string(x)))


@function("substr substring", 2, 3)
def substr(ctx, x: Val, start: Val, size: Val | None = None) -> Val:
    s, a = as_string(x), F.greatest(as_long(start), F.lit(1)).cast("int")
    if size is None:
        return string(F.substr(s, a))
    n = as_long(size).cast("int")
    return string(F.when(n >= 0, F.substr(s, a, n)))


@function("startswith", 2)
def startswith(ctx, x: Val, y: Val) -> Val:
    return boolean(F.coalesce(F.startswith(as_string(x), as_string(y)), F.lit(False)), False)


@function("endswith", 2)
def endswith(ctx, x: Val, y: Val) -> Val:
    return boolean(F.coalesce(F.endswith(as_string(x), as_string(y)), F.lit(False)), False)


@function("indexof", 2)
def indexof(ctx, x: Val, y: Val) -> Val:
    """The 0-based byte offset of y, or -1; null unless both are texts."""
    if not (x.is_string and y.is_string):
        return long(F.lit(None).cast("long"))
    at = F.position(y.c, x.c)
    return long(F.when(at > 0, F.octet_length(F.substr(x.c, F.lit(1), at - 1))).when(at == 0, -1).cast("long"))


@function("format", 2, 3)
def formatted(ctx, x: Val, n: Val, locale: Val | None = None) -> Val:
    """x with n decimals; with a locale also with its grouping and decimal marks."""
    places = ctx.literal(n)
    d = as_double(x)
    if places is None:
        places = 0
    places = max(0, int(places))
    name = None if locale is None else str(ctx.literal(locale) or "")
    # the dialect knows two ways of writing: decimal commas for these three, decimal points for all others
    marks = ".," if (name or "")[:2] in ("de", "fr", "it") else ",."

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        # Python rounds the number itself, the JVM its shortest decimal text; only the former is exact
        shown = lambda v: None if v is None or v != v else f"{v:,.{places}f}" if name is not None else f"{v:.{places}f}"
        out = x.map(shown)
        return out if name is None else out.map(lambda t: None if t is None else t.replace(",", "_").replace(".", marks[1]).replace("_", marks[0]))

    return string(run(d))
