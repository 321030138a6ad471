"""Protocol-buffer payloads without a compiler: message definitions read from their text.

Messages, nested messages, enums (by number), repeated and packed fields and proto3
defaults are understood; maps and groups are not.  Payloads are decoded in Arrow
batches to JSON, which Spark reads with the messages' schema.
"""

from __future__ import annotations

import base64
import json
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookql.functions.values import CompileError

_VARINT = {"int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool"}
_FIXED = {"fixed64": "<Q", "sfixed64": "<q", "double": "<d", "fixed32": "<I", "sfixed32": "<i", "float": "<f"}
_FIELD = re.compile(r"(?:(repeated|optional|required)\s+)?([\w.]+)\s+(\w+)\s*=\s*(\d+)\s*(?:\[[^\]]*\])?\s*;")


class Schema:
    """The messages of a definition text: for each, field number to (name, type, repeated)."""

    def __init__(self, text: str) -> None:
        text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
        self.messages: dict[str, dict[int, tuple[str, str, bool]]] = {}
        self.enums: set[str] = set()
        self._scan(text, 0, None)

    def _scan(self, text: str, at: int, owner: str | None) -> int:
        token = re.compile(r"\b(message|enum)\s+(\w+)\s*\{|\}|" + _FIELD.pattern)
        while m := token.search(text, at):
            at = m.end()
            if m[0] == "}":
                return at
            if m[1] == "message":
                self.messages[m[2]] = {}
                at = self._scan(text, at, m[2])
            elif m[1] == "enum":
                self.enums.add(m[2])
                at = text.index("}", at) + 1
            elif owner is not None:
                self.messages[owner][int(m[6])] = (m[5], m[4].rpartition(".")[2], m[3] == "repeated")
        return len(text)

    def spark_type(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(n, T.ArrayType(self._type(t)) if many else self._type(t)) for n, t, many in self.messages[name].values()])

    def _type(self, t: str) -> T.DataType:
        if t in ("double", "float"):
            return T.DoubleType()
        if t == "bool":
            return T.BooleanType()
        if t in ("string", "bytes"):
            return T.StringType()
        if t in _VARINT or t in _FIXED or t in self.enums:
            return T.LongType()
        if t in self.messages:
            return self.spark_type(t)
        raise CompileError(f"unknown field type {t}")

    def decode(self, name: str, raw: bytes) -> dict:
        """A message as a dict; fields that are absent have their type's default, bytes are base64."""
        fields = self.messages[name]
        out = {n: [] if many else self._default(t) for n, t, many in fields.values()}
        at = 0
        while at < len(raw):
            tag, at = _varint(raw, at)
            number, wire = tag >> 3, tag & 7
            field = fields.get(number)
            if wire == 0:
                value, at = _varint(raw, at)
                found = [self._number(field[1], value)] if field else []
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                if at + size > len(raw):
                    raise ValueError("truncated field")
                found = [struct.unpack(_FIXED.get(field[1], "<Q" if wire == 1 else "<I"), raw[at : at + size])[0]] if field else []
                at += size
            elif wire == 2:
                size, at = _varint(raw, at)
                if at + size > len(raw):
                    raise ValueError("truncated field")
                found = list(self._sized(field, raw[at : at + size])) if field else []
                at += size
            else:
                raise ValueError(f"wire type {wire}")
            for v in found:
                if field[2]:
                    out[field[0]].append(v)
                else:
                    out[field[0]] = v
        return out

    def _default(self, t: str):
        return {"string": "", "bytes": "", "bool": False, "double": 0.0, "float": 0.0}.get(t, None if t in self.messages else 0)

    def _number(self, t: str, v: int):
        if t == "bool":
            return bool(v)
        if t in ("sint32", "sint64"):
            return (v >> 1) ^ -(v & 1)
        return v - (1 << 64) if v >= 1 << 63 and t not in ("uint32", "uint64") else v

    def _sized(self, field, raw: bytes):
        _, t, _ = field
        if t == "string":
            yield raw.decode()
        elif t == "bytes":
            yield base64.b64encode(raw).decode()
        elif t in self.messages:
            yield self.decode(t, raw)
        elif t in _FIXED:
            yield from (x[0] for x in struct.iter_unpack(_FIXED[t], raw))
        else:
            at = 0
            while at < len(raw):
                v, at = _varint(raw, at)
                yield self._number(t, v)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("truncated number")
        out |= (raw[at] & 127) << shift
        at += 1
        if not raw[at - 1] & 128:
            return out & ((1 << 64) - 1), at
        shift += 7


def from_protobuf(column: Column, text: str, message: str) -> Column:
    """A binary column of messages as structs; what does not decode is null."""
    schema = Schema(text)
    if message not in schema.messages:
        raise CompileError(f"no message {message}")

    @F.pandas_udf("string")
    def run(payloads: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else json.dumps(schema.decode(message, bytes(raw)))
            except (ValueError, struct.error):
                return None

        return payloads.map(one)

    return F.from_json(run(column), schema.spark_type(message))
