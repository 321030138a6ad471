"""Date and time functions (30) and format_time.  All work in UTC on epoch milliseconds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from brookql.functions.values import CompileError, Val, as_long, as_millis, as_string, function, long, string

UNITS = {"dd": 86_400_000, "hh": 3_600_000, "mi": 60_000, "ss": 1000, "ms": 1}
#: strftime directives and their patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "z": "xx", "Z": "z", "%": "%"}
#: Duration units in milliseconds.
DURATIONS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7}


def ts(x: Val):
    return F.timestamp_millis(as_millis(x))


def java_pattern(pattern: str) -> str:
    """A date pattern for Spark from either a letter pattern or a strftime one."""
    if "%" in pattern:
        out, at = "", 0
        for m in re.finditer(r"%[-_0]?(.)", pattern):
            out += _quoted(pattern[at : m.start()]) + STRFTIME.get(m[1], "")
            at = m.end()
        return out + _quoted(pattern[at:])
    pattern = re.sub(r"Y", "y", pattern)
    pattern = re.sub(r"D+", lambda m: "d" * len(m[0]), pattern)
    return re.sub(r"S{4,}", lambda m: m[0], pattern)


def _quoted(text: str) -> str:
    return re.sub(r"([A-Za-z]+)", r"'\1'", text)


def _pattern(ctx, v: Val) -> str:
    p = ctx.literal(v)
    if not isinstance(p, str):
        raise CompileError("a date pattern must be a literal text")
    return java_pattern(p)


def _shown(pattern: str, names: str):
    @function(names, 0, 1, "datetimes")
    def run(ctx, precision: Val | None = None) -> Val:
        return string(F.date_format(F.current_timestamp(), pattern))


_shown("yyyy-MM-dd HH:mm:ss", "now current_timestamp local_timestamp")
_shown("yyyy-MM-dd", "current_date cur_date")
_shown("HH:mm:ss", "current_time cur_time local_time")


@function("format_date", 2)
def format_date(ctx, x: Val, pattern: Val) -> Val:
    return string(F.date_format(ts(x), _pattern(ctx, pattern)))


@function("format_time", 2, category="strings")
def format_time(ctx, x: Val, pattern: Val) -> Val:
    return string(F.date_format(ts(x), _pattern(ctx, pattern)))


@function("from_unix_time", 1, 2)
def from_unix_time(ctx, x: Val, pattern: Val | None = None) -> Val:
    return string(F.date_format(F.timestamp_millis(as_long(x)), "yyyy-MM-dd HH:mm:ss" if pattern is None else _pattern(ctx, pattern)))


@function("date_parse", 2)
def date_parse(ctx, x: Val, pattern: Val) -> Val:
    p = ctx.literal(pattern)
    # only strftime patterns parse
    got = F.try_to_timestamp(as_string(x), F.lit(java_pattern(p))) if isinstance(p, str) and "%" in p else F.lit(None).cast("timestamp")
    return long(F.unix_millis(got))


def _unit(ctx, v: Val) -> int:
    name = ctx.literal(v)
    if not isinstance(name, str) or name.lower() not in UNITS:
        raise CompileError(f"unknown time unit {name!r}")
    return UNITS[name.lower()]


@function("date_add", 3)
def date_add(ctx, a: Val, b: Val, c: Val) -> Val:
    """date_add(unit, n, date), or with the unit last."""
    unit, n, x = (a, b, c) if isinstance(ctx.literal(a), str) and str(ctx.literal(a)).lower() in UNITS else (c, b, a)
    return long(as_millis(x) + as_long(n) * _unit(ctx, unit))


@function("date_diff", 2, 3)
def date_diff(ctx, a: Val, b: Val, c: Val | None = None) -> Val:
    """The second time minus the first, in whole units (days without one)."""
    if c is None:
        unit, x, y = UNITS["dd"], a, b
    elif isinstance(ctx.literal(a), str) and str(ctx.literal(a)).lower() in UNITS:
        unit, x, y = _unit(ctx, a), b, c
    else:
        unit, x, y = _unit(ctx, c), a, b
    return long(_div(as_millis(y) - as_millis(x), unit))


def _div(c, n: int):
    """Whole division, truncated toward zero."""
    return F.when(c >= 0, F.floor(c / n)).otherwise(-F.floor(-c / n)).cast("long")


def duration_ms(text: str) -> int | None:
    """Milliseconds of a duration like 1h30m or -2.5s."""
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhd]))+)", text.strip())
    if not m:
        return None
    total = sum(float(n) * DURATIONS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|[smhd])", m[2]))
    return int(-total if m[1] == "-" else total)


@function("date_calc", 2)
def date_calc(ctx, x: Val, d: Val) -> Val:
    text = ctx.literal(d)
    ms = duration_ms(text) if isinstance(text, str) else None
    return long(as_millis(x) + ms if ms is not None else F.lit(None).cast("long"))


@function("convert_tz", 2, 3)
def convert_tz(ctx, x: Val, a: Val, b: Val | None = None) -> Val:
    zone = ctx.literal(a if b is None else b)
    try:
        from zoneinfo import ZoneInfo

        ZoneInfo(str(zone))
    except Exception:  # noqa: BLE001  an unknown zone gives null
        return string(F.lit(None).cast("string"))
    return string(F.date_format(F.from_utc_timestamp(ts(x), zone), "yyyy-MM-dd HH:mm:ss"))


def _part(names: str, f):
    @function(names, 1, category="datetimes")
    def run(ctx, x: Val) -> Val:
        return long(f(ts(x)).cast("long"))


_part("year", F.year)
_part("month", F.month)
_part("day day_of_month", F.dayofmonth)
_part("day_of_week", F.dayofweek)
_part("day_of_year", F.dayofyear)
_part("hour", F.hour)
_part("minute", F.minute)
_part("second", F.second)
_part("microsecond", lambda t: F.date_format(t, "SSSSSS"))


@function("day_name", 1)
def day_name(ctx, x: Val) -> Val:
    return string(F.date_format(ts(x), "EEEE"))


@function("month_name", 1)
def month_name(ctx, x: Val) -> Val:
    return string(F.date_format(ts(x), "MMMM"))


@function("last_day", 1)
def last_day(ctx, x: Val) -> Val:
    return string(F.date_format(F.last_day(ts(x)), "yyyy-MM-dd"))


@function("to_seconds", 1)
def to_seconds(ctx, x: Val) -> Val:
    return long(F.floor(as_millis(x) / 1000).cast("long"))


@function("from_days", 1)
def from_days(ctx, n: Val) -> Val:
    """The date of a day number; day 366 is 0001-01-01."""
    return string(F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), (as_long(n) - 366).cast("int")), "yyyy-MM-dd"))
