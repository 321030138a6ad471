"""Recursive-descent parser: text to the nodes of ast.py.

Precedence from loose to tight: OR, AND, NOT, then BETWEEN / IN / IS, comparisons and
LIKE, |, ^, &, + -, * / %, unary minus, postfix (field, index, slice).
"""

from __future__ import annotations

import re

from brookql.plans import ast as A

UNITS = {"dd": 86_400_000, "hh": 3_600_000, "mi": 60_000, "ss": 1000, "ms": 1}
WINDOWS = {"TUMBLINGWINDOW": "tumbling", "HOPPINGWINDOW": "hopping", "SLIDINGWINDOW": "sliding", "COUNTWINDOW": "count", "SESSIONWINDOW": "session", "STATEWINDOW": "state"}
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "ASOF", "ON", "AS", "AND", "OR", "NOT", "BETWEEN", "IN", "IS", "LIKE", "THEN", "WHEN", "ELSE", "END", "ASC", "DESC", "EXCEPT", "REPLACE", "OVER", "FILTER"}
_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<quoted>`[^`]*`)
    |(?P<word>[^\W\d]\w*)
    |(?P<op>->|<=|>=|!=|<>|==|[-+*/%&|^=<>(),.\[\]{}:;])""",
    re.X | re.S,
)


class ParseError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


def _unquote(text: str) -> str:
    quote, body = text[0], text[1:-1]
    body = body.replace(quote * 2, quote)
    keep = {"n": "\n", "t": "\t", "r": "\r", quote: quote, "\\": "\\"}
    # a backslash before any other character stays: LIKE patterns and regular expressions need it
    return re.sub(r"\\(.)", lambda m: keep.get(m[1], m[0]), body, flags=re.S)


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    # -- token helpers

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, text = self.peek(ahead)
        return kind == "word" and text.upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, *what: str) -> None:
        if not (self.op(*what) or self.word(*what)):
            raise ParseError(f"expected {' or '.join(what)}, got {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.next()
        if kind == "quoted":
            return text[1:-1]
        if kind == "word":
            return text
        raise ParseError(f"expected a name, got {text or 'the end'!r}")

    def done(self) -> None:
        self.op(";")
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")

    # -- statements

    def definition(self) -> A.Definition:
        self.need("CREATE")
        table = self.word("TABLE")
        if not table:
            self.need("STREAM")
        name, columns, options = self.name(), [], {}
        if self.op("("):
            while not self.op(")"):
                columns.append(self._column())
                self.op(",")
        if self.word("WITH"):
            self.need("(")
            while not self.op(")"):
                key = self.next()[1].strip("`\"'").upper()
                self.need("=")
                kind, value = self.next()
                options[key] = _unquote(value) if kind == "str" else value
                self.op(",")
        self.done()
        return A.Definition(name, columns, options, table)

    def _column(self) -> A.ColumnDef:
        name, kind = self.name(), self._type()
        required, default = False, None
        while True:
            if self.word("NOT"):
                self.need("NULL")
                required = True
            elif self.word("DEFAULT"):
                value = self.unary()
                if isinstance(value, A.Unary) and isinstance(value.arg, A.Lit):
                    value = A.Lit(-value.arg.value)
                if not isinstance(value, A.Lit):
                    raise ParseError("a default must be a literal")
                default = value.value
            elif not self.word("NULL"):
                return A.ColumnDef(name, kind, required, default)

    def _type(self) -> str:
        kind = self.name().lower()
        if self.op("("):
            if kind == "array":
                kind = f"array<{self._type()}>"
                self.need(")")
            elif kind == "struct":
                fields = []
                while not self.op(")"):
                    fields.append(f"{self.name()}:{self._type()}")
                    self.op(",")
                kind = f"struct<{','.join(fields)}>"
            else:
                while not self.op(")"):
                    self.next()
        elif kind == "array" and self.op("["):
            kind = f"array<{self._type()}>"
            self.need("]")
        while self.op("["):
            self.need("]")
            kind = f"array<{kind}>"
        return kind

    def statement(self) -> A.Select:
        out = self.select()
        self.done()
        return out

    def select(self) -> A.Select:
        self.need("SELECT")
        items = [self._item()]
        while self.op(","):
            items.append(self._item())
        self.need("FROM")
        source = self._source()
        alias = self._alias() or source
        joins = []
        while (join := self._join()) is not None:
            joins.append(join)
        where = self.expr() if self.word("WHERE") else None
        keys, window, having, order, limit = [], None, None, [], None
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.peek()[0] == "word" and self.peek()[1].upper() in WINDOWS and self.peek(1)[1] == "(":
                    window = self._window()
                else:
                    keys.append(self.expr())
                if not self.op(","):
                    break
        if self.word("HAVING"):
            having = self.expr()
        if self.word("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                order.append((e, down))
                if not self.op(","):
                    break
        if self.word("LIMIT"):
            kind, text = self.next()
            if kind != "num" or not text.isdigit():
                raise ParseError("LIMIT needs a whole number")
            limit = int(text)
        union, every = None, False
        if self.word("UNION"):
            every = self.word("ALL")
            union = self.select()
        return A.Select(tuple(items), source, alias, tuple(joins), where, tuple(keys), window, having, tuple(order), limit, union, every)

    def _source(self) -> str:
        out = self.name()
        while self.op("/", "."):
            out += "/" + self.name()
        return out

    def _alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        kind, text = self.peek()
        if kind == "quoted" or kind == "word" and text.upper() not in _CLAUSES:
            return self.name()
        return None

    def _item(self) -> A.Item:
        if self.op("*"):
            return A.Item(self._star(None))
        if self.peek()[0] in ("word", "quoted") and self.peek(1)[1] == "." and self.peek(2)[1] == "*":
            source = self.name()
            self.at += 2
            return A.Item(self._star(source))
        e = self.expr()
        alias = None
        if self.word("AS"):
            kind, text = self.next()
            alias = _unquote(text) if kind == "str" else text.strip("`")
        elif self.peek()[0] in ("word", "quoted") and (self.peek()[0] == "quoted" or self.peek()[1].upper() not in _CLAUSES):
            alias = self.name()
        return A.Item(e, alias)

    def _star(self, source: str | None) -> A.Star:
        excluded, replaced = [], []
        while True:
            if self.word("EXCEPT"):
                self.need("(")
                while not self.op(")"):
                    excluded.append(self.name())
                    self.op(",")
            elif self.word("REPLACE"):
                self.need("(")
                while not self.op(")"):
                    e = self.expr()
                    self.need("AS")
                    replaced.append((e, self.name()))
                    self.op(",")
            else:
                return A.Star(source, tuple(excluded), tuple(replaced))

    def _join(self) -> A.Join | None:
        start, kind = self.at, "inner"
        if self.word("LEFT"):
            kind = "left asof" if self.word("ASOF") else "left"
        elif self.word("RIGHT"):
            kind = "right"
        elif self.word("FULL"):
            kind = "full"
        elif self.word("CROSS"):
            kind = "cross"
        elif self.word("ASOF"):
            kind = "asof"
        else:
            self.word("INNER")
        self.word("OUTER")
        if not self.word("JOIN"):
            self.at = start
            return None
        table = self._source()
        alias = self._alias() or table
        on = self.expr() if self.word("ON") else None
        return A.Join(kind, table, alias, on)

    def _window(self) -> A.Window:
        kind = WINDOWS[self.next()[1].upper()]
        self.need("(")
        unit, args = None, []
        if kind not in ("count", "state"):
            unit = self.name().lower()
            if unit not in UNITS:
                raise ParseError(f"unknown window unit {unit!r}")
            self.op(",")
        while not self.op(")"):
            args.append(self.expr())
            self.op(",")
        condition, partition, when = None, (), None
        while True:
            if self.word("FILTER"):
                self.need("(")
                self.need("WHERE")
                condition = self.expr()
                self.need(")")
            elif self.word("OVER"):
                partition, when = self._over()
            else:
                low, high = {"tumbling": (1, 1), "hopping": (2, 2), "sliding": (1, 2), "count": (1, 2), "session": (2, 2), "state": (1, 2)}[kind]
                if not low <= len(args) <= high:
                    raise ParseError(f"a {kind} window takes {low} to {high} arguments, got {len(args)}")
                return A.Window(kind, tuple(args), unit, condition, partition or (), when)

    def _over(self) -> tuple[tuple[A.Node, ...], A.Node | None]:
        self.need("(")
        partition, when = [], None
        if self.word("PARTITION"):
            self.need("BY")
            partition.append(self.expr())
            while self.op(","):
                partition.append(self.expr())
        if self.word("WHEN"):
            when = self.expr()
        self.need(")")
        return tuple(partition), when

    # -- expressions

    def expr(self) -> A.Node:
        left = self._and()
        while self.word("OR"):
            left = A.Binary("or", left, self._and())
        return left

    def _and(self) -> A.Node:
        left = self._not()
        while self.word("AND"):
            left = A.Binary("and", left, self._not())
        return left

    def _not(self) -> A.Node:
        if self.is_word("NOT"):
            self.at += 1
            return A.Unary("not", self._not())
        return self._range()

    def _range(self) -> A.Node:
        left = self._comparison()
        while True:
            start = self.at
            negated = self.word("NOT")
            if self.word("BETWEEN"):
                low = self._comparison()
                self.need("AND")
                left = A.Between(left, low, self._comparison(), negated)
            elif self.word("IN"):
                self.need("(", "[")
                items = []
                while not self.op(")", "]"):
                    items.append(self.expr())
                    self.op(",")
                left = A.InList(left, tuple(items), negated)
            elif not negated and self.word("IS"):
                no = self.word("NOT")
                self.need("NULL")
                left = A.IsNull(left, no)
            elif negated and self.word("LIKE"):
                left = A.Unary("not", A.Binary("like", left, self._bit_or()))
            else:
                self.at = start
                return left

    def _comparison(self) -> A.Node:
        left = self._bit_or()
        while True:
            if op := self.op("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                left = A.Binary({"==": "=", "<>": "!="}.get(op, op), left, self._bit_or())
            elif self.word("LIKE"):
                left = A.Binary("like", left, self._bit_or())
            else:
                return left

    def _chain(self, below, *ops: str) -> A.Node:
        left = below()
        while op := self.op(*ops):
            left = A.Binary(op, left, below())
        return left

    def _bit_or(self) -> A.Node:
        return self._chain(self._bit_xor, "|")

    def _bit_xor(self) -> A.Node:
        return self._chain(self._bit_and, "^")

    def _bit_and(self) -> A.Node:
        return self._chain(self._sum, "&")

    def _sum(self) -> A.Node:
        return self._chain(self._product, "+", "-")

    def _product(self) -> A.Node:
        return self._chain(self.unary, "*", "/", "%")

    def unary(self) -> A.Node:
        if self.op("-"):
            arg = self.unary()
            if isinstance(arg, A.Lit) and isinstance(arg.value, int | float) and not isinstance(arg.value, bool):
                return A.Lit(-arg.value)
            return A.Unary("-", arg)
        if self.op("+"):
            return self.unary()
        return self._postfix()

    def _postfix(self) -> A.Node:
        e = self._primary()
        while True:
            if self.op(".", "->"):
                name = self.name()
                e = A.Ident(e.name, (*e.path, name)) if isinstance(e, A.Ident) else A.Field(e, name)
            elif self.op("["):
                low = None if self.peek()[1] == ":" else self.expr()
                if self.op(":"):
                    high = None if self.peek()[1] == "]" else self.expr()
                    e = A.Slice(e, low, high)
                else:
                    e = A.Index(e, low)
                self.need("]")
            else:
                return e

    def _primary(self) -> A.Node:
        kind, text = self.next()
        if kind == "num":
            return A.Lit(int(text) if text.isdigit() else float(text))
        if kind == "str":
            return A.Lit(_unquote(text))
        if kind == "quoted":
            return A.Ident(text[1:-1])
        if kind == "op" and text == "(":
            e = self.expr()
            self.need(")")
            return e
        if kind == "op" and text == "[":
            items = []
            while not self.op("]"):
                items.append(self.expr())
                self.op(",")
            return A.Call("array_create", tuple(items))
        if kind == "op" and text == "{":
            items = []
            while not self.op("}"):
                k, word = self.next()
                items.append(A.Lit(_unquote(word) if k == "str" else word.strip("`")))
                self.need(":")
                items.append(self.expr())
                self.op(",")
            return A.Call("json_map", tuple(items))
        if kind == "op" and text == "*":
            return A.Star()
        if kind != "word":
            raise ParseError(f"unexpected {text or 'the end'!r}")
        upper = text.upper()
        if upper in ("TRUE", "FALSE"):
            return A.Lit(upper == "TRUE")
        if upper == "NULL":
            return A.Lit(None)
        if upper == "CASE":
            return self._case()
        if self.op("("):
            args = []
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
            if self.word("OVER"):
                partition, when = self._over()
                return A.Call(text.lower(), tuple(args), partition, when)
            return A.Call(text.lower(), tuple(args))
        if upper in _CLAUSES and upper not in ("REPLACE", "FILTER", "FULL"):
            raise ParseError(f"unexpected {text!r}")
        return A.Ident(text)

    def _case(self) -> A.Node:
        operand = None if self.is_word("WHEN") else self.expr()
        arms, default = [], None
        while self.word("WHEN"):
            condition = self.expr()
            self.need("THEN")
            arms.append((condition, self.expr()))
        if self.word("ELSE"):
            default = self.expr()
        self.need("END")
        if not arms:
            raise ParseError("CASE needs a WHEN")
        return A.Case(operand, tuple(arms), default)


def parse_select(text: str) -> A.Select:
    return Parser(text).statement()


def parse_definition(text: str) -> A.Definition:
    return Parser(text).definition()
