"""Data templates: a small subset of the brace-brace template language for sink rows.

{{.a.b}}, {{f arg ...}}, pipes, {{if}}/{{else}}/{{end}} and {{range}}, over one row as a
dict (or a list of rows).
"""

from __future__ import annotations

import base64
import json
import re
from typing import Any

_TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
_WORD = re.compile(r'"(?:[^"\\]|\\.)*"|\(|\)|\||[^\s()|]+')


def _number(x: Any) -> float:
    n = float(x)
    return int(n) if n.is_integer() and not isinstance(x, float) else n


FUNCTIONS = {
    "json": lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False),
    "base64": lambda x: base64.b64encode(_text(x).encode()).decode(),
    "b64dec": lambda x: base64.b64decode(x).decode(),
    "printf": lambda f, *a: re.sub(r"%v", "%s", f) % tuple(_text(x) if "%v" in f else x for x in a),
    "index": lambda x, *path: _index(x, path),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "trimPrefix": lambda p, x: _text(x).removeprefix(p),
    "trimSuffix": lambda p, x: _text(x).removesuffix(p),
    "replace": lambda old, new, x: _text(x).replace(old, new),
    "len": len,
    "add": lambda a, b: _number(a) + _number(b),
    "sub": lambda a, b: _number(a) - _number(b),
    "mul": lambda a, b: _number(a) * _number(b),
    "div": lambda a, b: _number(a) / _number(b) if isinstance(a, float) or isinstance(b, float) else int(_number(a) / _number(b)),
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "default": lambda d, x: d if x in (None, "", 0, False) else x,
}


def _text(x: Any) -> str:
    if x is None:
        return "<no value>"
    if isinstance(x, bool):
        return "true" if x else "false"
    return x if isinstance(x, str) else json.dumps(x, separators=(",", ":")) if isinstance(x, dict | list) else f"{x:g}" if isinstance(x, float) else str(x)


def _index(x: Any, path) -> Any:
    for p in path:
        x = x[p] if isinstance(x, list) else (x or {}).get(p)
    return x


def _evaluate(words: list[str], row: Any) -> Any:
    """A pipeline: each stage's result is the last argument of the next."""
    stages: list[list[Any]] = [[]]
    at = 0
    while at < len(words):
        w = words[at]
        if w == "|":
            stages.append([])
        elif w == "(":
            depth, end = 1, at + 1
            while depth:
                depth += (words[end] == "(") - (words[end] == ")")
                end += 1
            stages[-1].append(("value", _evaluate(words[at + 1 : end - 1], row)))
            at = end - 1
        else:
            stages[-1].append(_word(w, row))
        at += 1
    out, first = None, True
    for stage in stages:
        kind, head = stage[0]
        args = [v for _, v in stage[1:]] + ([] if first else [out])
        out = FUNCTIONS[head](*args) if kind == "name" else head
        first = False
    return out


def _word(w: str, row: Any) -> tuple[str, Any]:
    if w.startswith('"'):
        return "value", json.loads(w)
    if w == ".":
        return "value", row
    if w.startswith("."):
        return "value", _index(row, w[1:].split("."))
    if w in ("true", "false"):
        return "value", w == "true"
    if re.fullmatch(r"-?\d+(\.\d+)?", w):
        return "value", float(w) if "." in w else int(w)
    if w not in FUNCTIONS:
        raise ValueError(f"unknown template function {w}")
    return "name", w


def render(template: str, row: Any) -> str:
    pieces = _TAG.split(template)
    return _block(pieces, 0, row)[0]


def _block(pieces: list[str], at: int, row: Any) -> tuple[str, int, str]:
    """(text, next piece, the word that ended it) of the pieces up to else or end."""
    out = ""
    while at < len(pieces):
        if at % 2 == 0:
            out += pieces[at]
            at += 1
            continue
        words = _WORD.findall(pieces[at])
        at += 1
        if not words:
            continue
        if words[0] in ("end", "else"):
            return out, at, words[0]
        if words[0] == "if":
            chosen = bool(_evaluate(words[1:], row))
            text, at, ended = _block(pieces, at, row)
            other = ""
            if ended == "else":
                other, at, _ = _block(pieces, at, row)
            out += text if chosen else other
        elif words[0] == "range":
            items = _evaluate(words[1:], row) or []
            after = at
            for item in items:
                text, after, _ = _block(pieces, at, item)
                out += text
            if not items:
                _, after, _ = _block(pieces, at, {})
            at = after
        else:
            out += _text(_evaluate(words, row))
    return out, at, ""
