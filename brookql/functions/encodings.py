"""Hashing, regular expressions, encodings and JSON paths (crypto 22, json 3 of 4)."""

from __future__ import annotations

import base64
import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import functions as F

from brookql.functions.values import CompileError, Val, as_double, as_long, as_string, boolean, clamp_index, double, function, long, string


def _hash(name: str, f):
    @function(name, 1, category="crypto")
    def run(ctx, x: Val) -> Val:
        return string(f(as_string(x))) if x.is_string else string(F.lit(None).cast("string"))


_hash("md5", F.md5)
_hash("sha1", F.sha1)
for _bits in (256, 384, 512):
    _hash(f"sha{_bits}", lambda s, n=_bits: F.sha2(s, n))
_hash("crc32", lambda s: F.lower(F.hex(F.crc32(s))))


def _regex(ctx, v: Val) -> str | None:
    """The pattern, if it is a literal that compiles; a bad one gives null."""
    p = ctx.literal(v)
    if not isinstance(p, str):
        raise CompileError("a pattern must be a literal text")
    try:
        re.compile(p)
    except re.error:
        return None
    return p


@function("regexp_matches", 2, category="crypto")
def regexp_matches(ctx, x: Val, p: Val) -> Val:
    pattern = _regex(ctx, p)
    return boolean(as_string(x).rlike(pattern)) if pattern is not None else boolean(F.lit(None).cast("boolean"))


@function("regexp_replace", 3, category="crypto")
def regexp_replace(ctx, x: Val, p: Val, r: Val) -> Val:
    pattern, new = _regex(ctx, p), ctx.literal(r)
    if pattern is None:
        return string(F.lit(None).cast("string"))
    if isinstance(new, str):
        r = string(F.lit(re.sub(r"\$\{(\d+)\}", r"$\1", new)))
    return string(F.regexp_replace(as_string(x), F.lit(pattern), as_string(r)))


@function("regexp_substring regexp_substr", 2, category="crypto")
def regexp_substring(ctx, x: Val, p: Val) -> Val:
    pattern = _regex(ctx, p)
    if pattern is None:
        return string(F.lit(None).cast("string"))
    s = as_string(x)
    return string(F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1 if re.compile(pattern).groups else 0)))


@function("split_value", 3, category="crypto")
def split_value(ctx, x: Val, sep: Val, i: Val) -> Val:
    parts = F.split(as_string(x), F.concat(F.lit("\\Q"), as_string(sep), F.lit("\\E")))
    at = clamp_index(as_long(i), F.size(parts))
    ctx.error(F.when(x.c.isNotNull() & ((at < 0) | (at >= F.size(parts))), F.lit("split_value: index out of range")))
    return string(F.get(parts, at))


@function("numbytes", 1, category="crypto")
def numbytes(ctx, x: Val) -> Val:
    return long(F.octet_length(x.c).cast("long")) if x.is_string else long(F.lit(None).cast("long"))


@function("chr", 1, category="crypto")
def character(ctx, x: Val) -> Val:
    """The character of a code point, or the first character of a text."""
    if x.is_string:
        return string(F.substring(x.c, 1, 1))
    n = as_long(x)
    ok = ((n >= 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    # UTF-32 big-endian bytes of the code point
    return string(F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


@function("trunc", 1, 2, category="crypto")
def trunc(ctx, x: Val, n: Val | None = None) -> Val:
    if x.is_int:
        return long(as_long(x))
    d = as_double(x)
    if n is None:
        return long(F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("long"))
    f = F.pow(F.lit(10.0), as_double(n))
    return double(F.when(d < 0, F.ceil(d * f)).otherwise(F.floor(d * f)) / f)


@function("hex2dec", 1, category="crypto")
def hex2dec(ctx, x: Val) -> Val:
    s = F.regexp_replace(F.trim(as_string(x)), "^0[xX]", "")
    return long(F.when(s.rlike("^[0-9a-fA-F]{1,15}$|^[0-7][0-9a-fA-F]{15}$"), F.conv(s, 16, 10).try_cast("long")))


@function("dec2hex", 1, category="crypto")
def dec2hex(ctx, x: Val) -> Val:
    n = as_long(x)
    return string(F.concat(F.when(n < 0, "-0x").otherwise("0x"), F.lower(F.hex(F.abs(n)))))


def _encoded(x: Val):
    return F.base64(F.encode(as_string(x), "utf-8"))


def _decoded(x: Val):
    raw = F.try_to_binary(as_string(x), F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


@function("encode", 2, category="crypto")
def encode(ctx, x: Val, how: Val) -> Val:
    return string(_encoded(x)) if str(ctx.literal(how)).lower() == "base64" else string(F.lit(None).cast("string"))


@function("base64_encode", 1, category="crypto")
def base64_encode(ctx, x: Val) -> Val:
    return string(_encoded(x))


@function("decode", 2, category="crypto")
def decode(ctx, x: Val, how: Val) -> Val:
    return string(_decoded(x)) if str(ctx.literal(how)).lower() == "base64" else string(F.lit(None).cast("string"))


@function("base64_decode", 1, category="crypto")
def base64_decode(ctx, x: Val) -> Val:
    return string(_decoded(x))


def _codec(how: str, out: bool):
    """The compression of one text, either way; None where there is none."""
    if how == "zlib":
        return zlib.compress if out else zlib.decompress
    if how == "gzip":
        return (lambda b: gzip.compress(b, mtime=0)) if out else gzip.decompress
    if how == "flate":
        return (lambda b: zlib.compress(b)[2:-4]) if out else (lambda b: zlib.decompress(b, -15))
    if how == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress if out else lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)
    return None


@function("compress", 2, category="crypto")
def compress(ctx, x: Val, how: Val) -> Val:
    name = str(ctx.literal(how)).lower()
    if _codec(name, True) is None:
        return string(F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        f = _codec(name, True)
        return s.map(lambda t: None if t is None else base64.b64encode(f(t.encode())).decode())

    return string(run(as_string(x)))


@function("decompress", 2, category="crypto")
def decompress(ctx, x: Val, how: Val) -> Val:
    name = str(ctx.literal(how)).lower()
    if _codec(name, False) is None:
        return string(F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        f = _codec(name, False)

        def one(t):
            if t is None:
                return None
            try:
                raw = f(base64.b64decode(t, validate=True))
            except Exception:  # noqa: BLE001  what does not decompress is null
                return None
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return base64.b64encode(raw).decode()

        return s.map(one)

    return string(run(as_string(x)))


# -- JSON paths -----------------------------------------------------------------


def json_path(path: str) -> str:
    """A path for Spark from a JSON path or a /a/b pointer."""
    if path.startswith("/"):
        path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path[1:].split("/"))
    return path if path.startswith("$") else "$." + path


def _document(x: Val):
    if x.is_string:
        return F.try_parse_json(x.c)
    return x.c if x.is_variant else F.try_parse_json(F.to_json(x.c))


def _found(ctx, x: Val, p: Val):
    """(variant at the path, whether the path has a wildcard); a wildcard collects an array."""
    path = ctx.literal(p)
    if not isinstance(path, str):
        raise CompileError("a JSON path must be a literal text")
    path = json_path(path)
    if x.is_null or not (x.is_string or x.is_variant or x.is_object or x.is_array):
        return F.lit(None), False
    if "*" in path:
        text = F.get_json_object(x.c if x.is_string else F.to_json(x.c), path)
        # one match comes without brackets
        return F.when(text.isNotNull(), F.try_parse_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))))), True
    return F.try_variant_get(_document(x), path, "variant"), False


@function("json_path_query", 2, category="json")
def json_path_query(ctx, x: Val, p: Val) -> Val:
    found, _ = _found(ctx, x, p)
    return ctx.val(found)


@function("json_path_query_first", 2, category="json")
def json_path_query_first(ctx, x: Val, p: Val) -> Val:
    found, many = _found(ctx, x, p)
    return ctx.val(F.try_variant_get(found, "$[0]", "variant") if many else found)


@function("json_path_exists", 2, category="json")
def json_path_exists(ctx, x: Val, p: Val) -> Val:
    found, _ = _found(ctx, x, p)
    return boolean(found.isNotNull(), False)

