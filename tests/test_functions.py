import json

import pytest

from brookql.functions import AGGREGATES, ANALYTIC, FUNCTIONS, WIDENING
from brookql.functions.values import CompileError
from brookql.session import Engine

ALIASES = {"euclidean_distance", "vector_dot_product", "wasm"}

#: expression, value (as JSON if it is no scalar)
CASES = [
    ("7 / 2", 3.5), ("abs(7 / 2)", 3), ("-7 % 3", -1), ("2 + 3 * 4", 14), ("9223372036854775807 + 1", 9223372036854775807),
    ("abs(-3)", 3), ("abs(-2.5)", 2.5), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(1.2345, 2)", 1.23),
    ("power(2, 10)", 1024), ("power(2.0, 0.5)", 2**0.5), ("log(100)", 2.0), ("log(2, 8)", 3.0), ("sign(-4)", -1), ("asin(2)", None), ("log2(-1)", None),
    ("conv('-15', 10, 16)", "-f"), ("conv('zz', 10, 16)", None), ("hex2dec('0xFF')", 255), ("dec2hex(-255)", "-0xff"), ("trunc(-1.29, 1)", -1.2), ("trunc(7.9)", 7),
    ("concat('a', null, 1)", "a1"), ("length(null)", 0), ("length([1, 2])", 2), ("lpad('ab', 3)", "   ab"), ("lpad('ab', 5, 'xy')", "xxxab"), ("rpad('abc', 2, 'x')", "abc"),
    ("substr('hello', 0, 2)", "he"), ("substr('hello', 9)", ""), ("substr('hello', 1, -1)", None), ("indexof('añb', 'b')", 3), ("indexof('abc', 'z')", -1), ("startswith(null, 'a')", False),
    ("trim('  x\t')", "x"), ("format(1234.5, 2)", "1234.50"), ("format(1234567.891, 2, 'de_DE')", "1.234.567,89"), ("reverse('abc')", "cba"), ("split_value('a/b/c', '/', -1)", "c"),
    ("array_position([5, 6], 6)", 1), ("array_position([5, 6], 7)", -1), ("array_last_position([1, 2, 1], 1)", 2), ("element_at([5, 6, 7], 0)", 5), ("element_at([5, 6, 7], -1)", 7), ("element_at([5], 9)", None),
    ("array_join([])", None), ("array_join(['a', null, 'b'], '-')", "a-b"), ("array_length(null)", None), ("cardinality(null)", 0), ("array_contains([1, 2], 2.0)", True),
    ("to_json(array_slice([1, 2, 3, 4], 2, 3))", "[2,3]"), ("to_json(array_except([1, 1, 2], [2]))", "[1,1]"), ("to_json(deduplicate([1, null, null, 1]))", "[1,null,null]"), ("to_json(sequence(5, 1, -2))", "[5,3,1]"), ("sequence(1, 5, 0)", None),
    ("to_json(zip([['a', 'x'], ['b', 'y']]))", '{"a":"x","b":"y"}'), ("to_json(object_construct('a', 1, 'b', null))", '{"a":1}'), ("to_json({a: 1, b: 'x'})", '{"a":1,"b":"x"}'), ("to_json('q')", '"q"'),
    ("to_json(kvpair_array_to_obj([{key: 'a', value: 1}]))", '{"a":1}'), ("to_json(items({a: 'x'}))", '[["a","x"]]'),
    ("date_parse('2024-01-02 03:04:05', '%Y-%m-%d %H:%M:%S')", 1704164645000), ("format_date(1704164645000, 'yyyy-MM-dd HH:mm:ss')", "2024-01-02 03:04:05"), ("from_unix_time(1704164645000)", "2024-01-02 03:04:05"), ("date_diff('dd', 0, -86400001)", -1),
    ("day_of_week(1704164645000)", 3), ("day_name(1704164645000)", "Tuesday"), ("month_name(1704164645000)", "January"), ("last_day(1704164645000)", "2024-01-31"), ("to_seconds(1704164645999)", 1704164645), ("from_days(366)", "0001-01-01"), ("date_calc(0, '-1h30m')", -5400000), ("convert_tz(0, 'nowhere')", None), ("year('2024-05-06')", 2024),
    ("md5('a')", "0cc175b9c0f1b6a831c399e269772661"), ("crc32('')", "0"), ("chr(8364)", "€"), ("numbytes('é')", 2), ("regexp_substr('ab12', '[a-z]+([0-9])')", "1"), ("regexp_substr('ab', '[0-9]')", None), ("regexp_matches('a', '(')", None), ("base64_decode('YQ==')", "a"), ("base64_decode('!')", None), ("decompress(compress('hey', 'zstd'), 'zstd')", "hey"), ("encode('a', 'hex')", None),
    ("json_path_exists('{\"a\": null}', '$.a')", True), ("json_path_exists('{\"a\": 1}', '$.b')", False), ("to_json(json_path_query('{\"a\":[{\"b\":1},{\"b\":2}]}', '$.a[*].b'))", "[1,2]"), ("to_json(parse_json('bad{'))", None),
    ("cast('12', 'bigint')", 12), ("cast(1.9, 'int')", 1), ("cast('t', 'boolean')", True), ("isnumeric('1e3')", True), ("coalesce(null, 2)", 2), ("nvl(null, 'x')", "x"), ("isnull(null)", True),
    ("cosine_similarity([1, 0], [0, 1])", 0.0), ("cosine_similarity([0, 0], [1, 1])", 0.0), ("cosine_similarity([1], [1, 2])", None), ("vector_l2([0, 0], [3, 4])", 5.0), ("vector_dot([1, 2], [3, 4])", 11.0), ("cosine_similarity('[1, 0]', '[1, 0]')", 1.0),
    ("1 > null", False), ("not (1 = null)", True), ("true or null", False), ("null in (1)", False), ("null not in (1)", True), ("null between 1 and 2", False), ("'abc' like 'a_c'", True), ("[1, 2, 3, 4][1:3][0]", 2), ("[1, 2, 3][-1]", 3), ("[1][5]", None), ("{a: 1}['a']", 1),
    ("case when null then 1 else 2 end", 2), ("case 2 when 1 then 'a' when 2 then 'b' end", "b"), ("5 & 3", 1), ("5 | 3", 7), ("5 ^ 3", 6),
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("one", spark.range(1))
    return e


def test_catalogue_is_complete():
    known = set(FUNCTIONS) | set(AGGREGATES) | set(ANALYTIC) | set(WIDENING)
    assert len(known - ALIASES) == 221


def test_values(engine):
    for at in range(0, len(CASES), 30):
        part = CASES[at : at + 30]
        row = engine.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(part)) + " FROM one").collect()[0]
        for i, (e, want) in enumerate(part):
            got = row[f"c{i}"]
            if isinstance(want, float):
                assert got == pytest.approx(want), e
            elif isinstance(want, str) and want[:1] in ("[", "{") and isinstance(got, str):
                assert json.loads(got or 'null') == json.loads(want), (e, got)
            else:
                assert got == want and isinstance(got, type(want)), e


@pytest.mark.parametrize("e", ["1 / (id * 0)", "mod(1, id * 0)", "sqrt(id - 1)", "ln(id * 0)", "cot(id * 0)", "abs('x')", "cast('x', 'int')", "'a' < 1", "split_value('a', '/', 3)", "'a' + 1"])
def test_row_errors(engine, e):
    plan = engine.plan(f"SELECT {e} AS x FROM one")
    assert plan.rows.count() == 0
    assert sum(f.count() for f in plan.errors) == 1


def test_error_of_untaken_branch_does_not_count(engine):
    assert engine.sql("SELECT case when id > 0 then 1 / (id * 0) else 5 end AS x FROM one").collect()[0].x == 5


def test_rejections(engine):
    for text in ("SELECT nofunc(id) FROM one", "SELECT id AS a, id AS a FROM one", "SELECT count(*) FROM one GROUP BY id", "SELECT a.id FROM one AS a INNER JOIN one AS b ON a.id = b.id", "SELECT id FROM missing"):
        with pytest.raises(CompileError):
            engine.sql(text)


def test_unnamed_columns(engine):
    assert engine.sql("SELECT 1 + 1, upper('a'), 2 FROM one").columns == ["field_0", "upper", "field_1"]
