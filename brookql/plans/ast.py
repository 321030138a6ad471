"""Syntax trees of the dialect.  Nodes are frozen, so equal text means equal nodes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Ident(Node):
    """A column; `path` holds further field names of a dotted reference."""

    name: str
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Star(Node):
    source: str | None = None
    excluded: tuple[str, ...] = ()
    replaced: tuple[tuple[Node, str], ...] = ()


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    arms: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Field(Node):
    arg: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    arg: Node
    at: Node


@dataclass(frozen=True)
class Slice(Node):
    arg: Node
    low: Node | None
    high: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    partition: tuple[Node, ...] | None = None
    when: Node | None = None


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    kind: str
    table: str
    alias: str
    on: Node | None


@dataclass(frozen=True)
class Window(Node):
    kind: str
    args: tuple[Node, ...]
    unit: str | None = None
    filter: Node | None = None
    partition: tuple[Node, ...] = ()
    when: Node | None = None


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    source: str
    alias: str
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    keys: tuple[Node, ...] = ()
    window: Window | None = None
    having: Node | None = None
    order: tuple[tuple[Node, bool], ...] = ()
    limit: int | None = None
    union: Select | None = None
    union_all: bool = False


@dataclass(frozen=True)
class ColumnDef(Node):
    name: str
    type: str
    required: bool = False
    default: Any = None


@dataclass
class Definition:
    """A CREATE STREAM or CREATE TABLE statement."""

    name: str
    columns: list[ColumnDef]
    options: dict[str, str] = field(default_factory=dict)
    table: bool = False


def walk(node: Any):
    """The node and all nodes below it."""
    if isinstance(node, Node):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)
