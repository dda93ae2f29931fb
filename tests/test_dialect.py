"""Golden values of MySQL expressions, and errors by number."""

import datetime as dt

import pytest

from millrace import dialect
from millrace.errors import EngineError
from millrace.functions import collation, fulltext, geo, json_fn
from millrace.lexer import quote, statements, tokens
from millrace.operators.recursion import fixpoint_distinct
from millrace.sources.partitions import RangePartitions


@pytest.fixture(scope="module")
def value(spark):
    json_fn.register(spark)
    return lambda text: spark.sql(dialect.to_spark("SELECT " + text)).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        # Control flow: the first true branch; no branch is NULL; text counts as its leading number.
        ("CASE 'k' WHEN 'j' THEN 10 WHEN 'k' THEN 20 ELSE 30 END", 20), ("CASE WHEN 1 > NULL THEN 'n' WHEN 3 > 2 THEN 'yes' END", "yes"), ("CASE 8 WHEN 9 THEN 1 END", None),
        ("IF(2 > 7, 'more', 'less')", "less"), ("IF(NULL, 4, 5)", 5), ("IF('0.0kg', 'heavy', 'light')", "light"), ("IFNULL(NULL, 'fallback')", "fallback"), ("NULLIF(6, 6)", None), ("NULLIF(6, 5)", 6),
        # Extremes of several arities; any NULL wins; mixed kinds compare as text.
        ("GREATEST(-4, -9, -2, -30)", -2), ("LEAST(17, 4, 11, 4)", 4), ("LEAST(3.5, NULL, 9)", None), ("GREATEST('pear', 'fig', 'plum')", "plum"), ("GREATEST('9', 70)", "9"), ("LEAST('81', 9)", "81"),
        # Text, with letters of several bytes.
        ("TRIM('\t żółw  ')", "żółw"), ("TRIM(TRAILING '!' FROM 'hey!!!')", "hey"), ("TRIM(BOTH '-' FROM '--a-b--')", "a-b"), ("LTRIM('00420', '0')", "420"), ("RTRIM('x.y...', '.')", "x.y"),
        ("REPLACE('banana', 'an', 'AN')", "bANANa"), ("REPLACE('Banana', 'b', 'm')", "Banana"), ("REPLACE('keep', '', '?')", "keep"), ("LENGTH('naïve 🙂')", 11), ("CHAR_LENGTH('naïve 🙂')", 7),
        ("SUBSTRING('łąka zielona', 6)", "zielona"), ("SUBSTRING('abcdefgh', -3, 2)", "fg"), ("SUBSTRING('abcdefgh', 0, 4)", ""), ("SUBSTR('abcdefgh', 7, 50)", "gh"), ("SUBSTRING('abcdefgh' FROM 2 FOR 3)", "bcd"),
        ("SUBSTRING_INDEX('www.example.org', '.', 1)", "www"), ("SUBSTRING_INDEX('www.example.org', '.', -1)", "org"), ("SUBSTRING_INDEX('nodots', '.', 3)", "nodots"),
        ("CONCAT('a', NULL, 'b')", None), ("CONCAT(1, '-', 2)", "1-2"), ("'don''t' || \" stop\"", "don't stop"), ("UPPER('straße é')", "STRASSE É"),
        # Dates follow the calendar.
        ("DATE_ADD('2023-12-25', INTERVAL 2 WEEK)", dt.date(2024, 1, 8)), ("DATE_ADD('2024-02-28 22:15:00', INTERVAL 150 MINUTE)", dt.datetime(2024, 2, 29, 0, 45)), ("DATE_SUB('2024-05-31', INTERVAL 3 MONTH)", dt.date(2024, 2, 29)),
        ("SUBDATE('2020-02-29', INTERVAL 1 YEAR)", dt.date(2019, 2, 28)), ("ADDDATE('1999-12-31', 1)", dt.date(2000, 1, 1)), ("CAST('2021-07-30' AS DATE) - INTERVAL 1 QUARTER", dt.date(2021, 4, 30)),
        ("DATEDIFF('2024-03-01', '2024-02-01')", 29), ("DATEDIFF('1970-01-01 23:59:59', '1970-01-02 00:00:00')", -1), ("DATE_FORMAT('1987-06-05 04:03:02', '%d.%m.%Y, %H h %i')", "05.06.1987, 04 h 03"), ("DATE_FORMAT('2015-10-21', '%Y%%')", "2015%"),
        # JSON: strings stay quoted, keys are sorted, what is not there is NULL.
        ("JSON_EXTRACT('{\"k\":{\"list\":[3,4]}}', '$.k.list')", "[3,4]"), ("JSON_EXTRACT('{\"name\":\"Ada\"}', '$.name')", '"Ada"'), ("JSON_EXTRACT('{\"p\":true}', '$.q')", None), ("JSON_UNQUOTE('\"tab\"')", "tab"), ("JSON_UNQUOTE('bare')", "bare"),
        ("JSON_OBJECT('zeta', NULL, 'alpha', 2.5)", '{"alpha": 2.5, "zeta": null}'), ("JSON_ARRAY()", "[]"), ("JSON_ARRAY('é', 7, NULL)", '["é", 7, null]'), ("JSON_SET('{\"n\": 5}', '$.n', 6, '$.m', 'new')", '{"m": "new", "n": 6}'), ("JSON_SET('{}', '$.a.b', 1)", "{}"),
        # Operators and conversions.
        ("5 > 3 XOR 2 > 9", True), ("NOT (1 = 2) AND 4 BETWEEN 3 AND 5", True), ("NULL XOR TRUE", None), ("'Hello' LIKE 'hELL_'", True), ("'abc' NOT LIKE '%d%'", True), ("CAST('-42' AS SIGNED) * 2", -84), ("CAST(3.7 AS CHAR)", "3.7"), ("CONVERT('ü' USING utf8mb4)", "ü"), ("LAST_INSERT_ID(41.2)", 41),
    ],
)
def test_golden(value, text, want):
    assert value(text) == want


@pytest.mark.parametrize(
    "text,code",
    [
        ("GREATEST(1)", 1582), ("JSON_OBJECT('a')", 1582), ("JSON_OBJECT(NULL, 1)", 3158), ("JSON_SET('{}', '$.a')", 1582), ("CONVERT('a' USING latin9)", 1115),
        ("DATE_FORMAT('2026-01-02', '%M')", 1235), ("(1", 1064), ("'open", 1064), ("@@nope", 1193),
        ("SUM(x) OVER (ORDER BY y ROWS BETWEEN CURRENT ROW AND 1 PRECEDING)", 3585), ("MATCH(a) AGAINST ('x')", 1235), ("MATCH(a) AGAINST ('\"x y\"' IN BOOLEAN MODE)", 1235),
    ],
)
def test_errors(text, code):
    with pytest.raises(EngineError) as e:
        dialect.to_spark("SELECT " + text)
    assert e.value.code == code
    with pytest.raises(EngineError, match="1136"):
        dialect.to_spark("VALUES ROW(1, 2), ROW(3)")


def test_json_errors():
    for doc, path, code in (("{", "$.a", 3141), ("{}", "a", 3143)):
        with pytest.raises(EngineError) as e:
            json_fn.set_paths(doc, [path], ["1"])
        assert e.value.code == code


def test_lexer():
    assert [t.value() for t in tokens("SELECT `a``b`, 'x\\'y', 1.5e3 -- c\n# d\n/* e */ FROM t")] == ["SELECT", "a`b", ",", "x'y", ",", "1.5e3", "FROM", "t"]
    assert len(statements("SELECT ';'; SELECT 2")) == 2 and quote("a'b\\") == "'a\\'b\\\\'"
    assert len(statements("CREATE PROCEDURE p() BEGIN IF 1 THEN SELECT 1; END IF; END; SELECT 2")) == 2


@pytest.mark.parametrize("query,body,hit", [("+foo -bar", "foo baz", True), ("+foo -bar", "Foo bar", False), ("foo qux", "the QUX", True), ("-foo", "x", False), ("of", "of", False)])
def test_fulltext(spark, query, body, hit):
    assert spark.sql(f"SELECT {fulltext.match_sql([quote(body)], query)}").first()[0] is hit


def test_collation_keys():
    assert collation.fold("Straße", True) == "strasse" and collation.fold("Straße", False) != "strasse" and collation.fold("ÉCLAIR", False) == "eclair"


def test_partitions(spark):
    parts = RangePartitions("k", (10, 20), False)
    assert [parts.number(v) for v in (-5, 9, 10, 19)] == [0, 0, 1, 1]
    with pytest.raises(EngineError):
        parts.number(20)
    df = parts.tag(spark.range(20).toDF("k"))
    assert parts.prune_equal(df, 12).collect()[0]["k"] == 12


def test_fixpoint(spark):
    step = lambda w: w.selectExpr("(k * 3) % 7 AS k")
    assert {r[0] for r in fixpoint_distinct(spark.range(1, 2).toDF("k"), step).collect()} == {1, 3, 2, 6, 4, 5}
    with pytest.raises(EngineError, match="3636"):
        fixpoint_distinct(spark.range(1).toDF("k"), lambda w: w.selectExpr("k + 1 AS k"), 3)


@pytest.mark.parametrize("wkt", ["POINT(1 2)", "LINESTRING(0 0,1 1.5)", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT((0 0),(1 1))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))"])
def test_wkt_round_trip(wkt):
    assert geo.as_text(geo.from_text(wkt)) == wkt and geo.as_text(geo.from_text(wkt, 4326)) == wkt


@pytest.mark.parametrize("args,code", [(("POINT(1)",), 3037), (("POINT(1 2)", 7), 3548), (("POINT(91 0)", 4326), 3617), (("POINT(0 181)", 4326), 3616), (("POINT(1 2)", 0, 2), 3516), (("POLYGON((0 0,1 1,2 2,3 3))",), 3037)])
def test_geometry_errors(args, code):
    with pytest.raises(EngineError) as e:
        geo.from_text(*args)
    assert e.value.code == code
