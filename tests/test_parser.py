import pytest

from brookql.plans import ast as A
from brookql.plans.parser import ParseError, parse_definition, parse_select


def test_precedence():
    e = parse_select("SELECT a OR b AND NOT c = 1 + 2 * 3 FROM s").items[0].expr
    assert e.op == "or" and e.right.op == "and"
    assert e.right.right == A.Unary("not", A.Binary("=", A.Ident("c"), A.Binary("+", A.Lit(1), A.Binary("*", A.Lit(2), A.Lit(3)))))


def test_bit_operators_bind_between_comparison_and_sum():
    e = parse_select("SELECT a & 1 + 2 = b | c FROM s").items[0].expr
    assert e == A.Binary("=", A.Binary("&", A.Ident("a"), A.Binary("+", A.Lit(1), A.Lit(2))), A.Binary("|", A.Ident("b"), A.Ident("c")))


def test_windows_and_over():
    s = parse_select("SELECT lag(a, 1) OVER (PARTITION BY k WHEN b > 1) FROM s GROUP BY k, HOPPINGWINDOW(mi, 10, 5) FILTER (WHERE a > 0)")
    assert s.window == A.Window("hopping", (A.Lit(10), A.Lit(5)), "mi", A.Binary(">", A.Ident("a"), A.Lit(0)))
    assert s.items[0].expr.partition == (A.Ident("k"),) and s.keys == (A.Ident("k"),)


def test_definition():
    d = parse_definition('CREATE TABLE t (id BIGINT NOT NULL, v FLOAT DEFAULT -1.5, tags ARRAY(STRING), o STRUCT(a BIGINT, b TEXT[])) WITH (DATASOURCE="x", KEY="id")')
    assert d.table and d.options == {"DATASOURCE": "x", "KEY": "id"}
    assert [c.type for c in d.columns] == ["bigint", "float", "array<string>", "struct<a:bigint,b:array<text>>"]
    assert d.columns[0].required and d.columns[1].default == -1.5


@pytest.mark.parametrize("text", ["SELECT FROM s", "SELECT a", "SELECT a FROM s WHERE", "SELECT a FROM s LIMIT x", "SELECT a FROM s GROUP BY TUMBLINGWINDOW(xx, 1)", "SELECT a FROM s GROUP BY HOPPINGWINDOW(ss, 1)", "SELECT a b c FROM s", "SELECT CASE END FROM s"])
def test_rejected(text):
    with pytest.raises(ParseError):
        parse_select(text)
