"""Queries in MySQL text, run through the dialect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import dialect
from millrace.functions import collation, fulltext, json_fn
from millrace.plans.registry import QUERIES, TABLES, Query, df_query, load


def mysql_query(name: str, text: str, oracle: str | None = None) -> None:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        json_fn.register(spark)
        sql = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", dialect.to_spark(text).replace("{", "{{").replace("}", "}}"))
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})

    QUERIES[name] = Query(run, oracle)


mysql_query("expr_arith", "SELECT p_partkey, p_size + 2 * 3 - 1 AS a, -p_size AS neg FROM part", "SELECT p_partkey, p_size + 2 * 3 - 1 AS a, -p_size AS neg FROM part")
mysql_query("expr_divide", "SELECT p_partkey, ROUND(p_size / 7, 6) AS d FROM part", "SELECT p_partkey, ROUND(p_size / 7, 6) AS d FROM part")
mysql_query("expr_bool_int", "SELECT p_partkey, CAST(p_size > 25 AS SIGNED) AS big, CAST(p_size = 3 AND p_brand <> 'x' AS SIGNED) AS three FROM part", "SELECT p_partkey, CAST(p_size > 25 AS BIGINT) AS big, CAST(p_size = 3 AND p_brand <> 'x' AS BIGINT) AS three FROM part")
mysql_query("expr_xor", "SELECT p_partkey FROM part WHERE p_size > 25 XOR p_brand = 'Brand#11'", "SELECT p_partkey FROM part WHERE (p_size > 25) <> (p_brand = 'Brand#11')")
mysql_query("expr_truthy", "SELECT p_partkey, IF(TRUTHY(p_name), 1, 0) AS t, IF(0, 'a', 'b') AS b FROM part", "SELECT p_partkey, CASE WHEN coalesce(TRY_CAST(nullif(regexp_extract(p_name, '^\\s*([+-]?[0-9]+([.][0-9]*)?)', 1), '') AS DOUBLE), 0) <> 0 THEN 1 ELSE 0 END AS t, 'b' AS b FROM part")
mysql_query("fn_concat", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS a, c_name || '!' AS b FROM customer", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, c_name || '!' AS b FROM customer")
mysql_query("fn_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS b FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS b FROM customer")
mysql_query("fn_if", "SELECT c_custkey, IF(c_acctbal > 0, 'plus', 'minus') AS s FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s FROM customer")
mysql_query("fn_coalesce", "SELECT c.c_custkey, COALESCE(o.o_orderkey, -1) AS a, IFNULL(o.o_orderpriority, 'none') AS b FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c.c_custkey, COALESCE(o.o_orderkey, -1) AS a, COALESCE(o.o_orderpriority, 'none') AS b FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
mysql_query("fn_nullif", "SELECT p_partkey, NULLIF(p_size, 10) AS n FROM part", "SELECT p_partkey, NULLIF(p_size, 10) AS n FROM part")
mysql_query("fn_greatest_least", "SELECT p_partkey, GREATEST(p_size, 20, NULLIF(p_size, 7)) AS g, LEAST(p_size, 20) AS l FROM part", "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE greatest(p_size, 20) END AS g, least(p_size, 20) AS l FROM part")
mysql_query("fn_substring", "SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTR(p_name, -4, 2) AS b, SUBSTRING(p_name FROM 0 FOR 2) AS c, SUBSTRING(p_type, 3) AS d FROM part", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, -4, 2) AS b, '' AS c, substring(p_type, 3) AS d FROM part")
mysql_query("fn_substring_index", "SELECT page_id, SUBSTRING_INDEX(url, '/', 3) AS host, SUBSTRING_INDEX(url, '/', -1) AS tail FROM pages", "SELECT page_id, array_to_string(string_split(url, '/')[1:3], '/') AS host, string_split(url, '/')[-1] AS tail FROM pages")
mysql_query("fn_replace", "SELECT p_partkey, REPLACE(p_type, 'O', '0') AS r, REPLACE(p_type, '', 'x') AS same FROM part", "SELECT p_partkey, replace(p_type, 'O', '0') AS r, p_type AS same FROM part")
mysql_query("fn_trim", "SELECT p_partkey, TRIM(CONCAT('  ', p_name, ' ')) AS a, TRIM(LEADING 'p' FROM p_name) AS b, TRIM(BOTH 'x' FROM CONCAT('xx', p_name, 'x')) AS c FROM part", "SELECT p_partkey, trim('  ' || p_name || ' ') AS a, ltrim(p_name, 'p') AS b, trim('xx' || p_name || 'x', 'x') AS c FROM part")
mysql_query("fn_ltrim_rtrim", "SELECT p_partkey, LTRIM(CONCAT('  ', p_name)) AS a, RTRIM(p_name, '0') AS b, LTRIM(p_name, 'p') AS c FROM part", "SELECT p_partkey, ltrim('  ' || p_name) AS a, rtrim(p_name, '0') AS b, ltrim(p_name, 'p') AS c FROM part")
mysql_query("fn_length", "SELECT doc_id, LENGTH(text) AS bytes, CHAR_LENGTH(text) AS chars FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents")
mysql_query("fn_lower_upper", "SELECT p_partkey, LOWER(p_type) AS a, UPPER(p_name) AS b FROM part", "SELECT p_partkey, lower(p_type) AS a, upper(p_name) AS b FROM part")
mysql_query("fn_round", "SELECT p_partkey, ROUND(p_retailprice) AS a, ROUND(p_retailprice, -2) AS b FROM part", "SELECT p_partkey, round(p_retailprice) AS a, round(p_retailprice, -2) AS b FROM part")
mysql_query("fn_date_add", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 10 DAY) AS a, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS b, ADDDATE(o_orderdate, 3) AS c, o_orderdate + INTERVAL 2 HOUR AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, o_orderdate + INTERVAL 1 MONTH AS b, o_orderdate + INTERVAL 3 DAY AS c, o_orderdate + INTERVAL 2 HOUR AS d FROM orders")
mysql_query("fn_date_sub", "SELECT o_orderkey, DATE_SUB(o_orderdate, INTERVAL 1 YEAR) AS a, SUBDATE(o_orderdate, INTERVAL 90 MINUTE) AS b FROM orders", "SELECT o_orderkey, o_orderdate - INTERVAL 1 YEAR AS a, o_orderdate - INTERVAL 90 MINUTE AS b FROM orders")
mysql_query("fn_datediff", "SELECT o_orderkey, DATEDIFF(o_orderdate, '1995-01-01') AS d FROM orders", "SELECT o_orderkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d FROM orders")
mysql_query("fn_date_format", "SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d at %H:%i:%s %%') AS t FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d at %H:%M:%S %%') AS t FROM events")
mysql_query("fn_cast", "SELECT p_partkey, CAST(p_size AS CHAR) AS a, CAST('12' AS SIGNED) AS b, CAST(p_retailprice AS DECIMAL(12, 2)) > 1000 AS c FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST('12' AS BIGINT) AS b, CAST(p_retailprice AS DECIMAL(12, 2)) > 1000 AS c FROM part")
mysql_query("fn_convert_using", "SELECT p_partkey, CONVERT(p_name USING utf8mb4) AS n FROM part", "SELECT p_partkey, p_name AS n FROM part")
mysql_query("fn_json_extract", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, JSON_EXTRACT(props, '$.none') AS missing FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
mysql_query("fn_json_arrow", "SELECT event_id, props->'$.k' AS a, props->>'$.k' AS b FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS a, json_extract_string(props, '$.k') AS b FROM events")
mysql_query("fn_json_unquote", "SELECT event_id, JSON_UNQUOTE(CONCAT('\"', event_type, '\"')) AS u FROM events", "SELECT event_id, event_type AS u FROM events")
mysql_query("fn_json_object", "SELECT event_id, JSON_OBJECT('id', event_id, 'a', event_type, 'n', NULL) AS o FROM events", "SELECT event_id, '{\"a\": \"' || event_type || '\", \"id\": ' || event_id || ', \"n\": null}' AS o FROM events")
mysql_query("fn_json_array", "SELECT event_id, JSON_ARRAY(event_id, event_type, NULL) AS a FROM events", "SELECT event_id, '[' || event_id || ', \"' || event_type || '\", null]' AS a FROM events")
mysql_query("fn_json_set", "SELECT event_id, JSON_SET(props, '$.k', 5, '$.z', event_type) AS j FROM events", "SELECT event_id, '{\"k\": 5, \"z\": \"' || event_type || '\"}' AS j FROM events")
mysql_query("win_rank_frame_ignored", "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS SIGNED) AS rk FROM orders", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders")
mysql_query("win_sum_default_frame", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s FROM orders", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders")
mysql_query("values_row_mysql", "VALUES ROW(1, 'a'), ROW(2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(column_0, column_1)")
mysql_query("limit_comma", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
_WORDS = "string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')"
mysql_query("fulltext_boolean", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('+the -idiot tion' IN BOOLEAN MODE)", f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'the') AND NOT list_contains({_WORDS}, 'idiot')")
mysql_query("fulltext_optional", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST ('license copyright' IN BOOLEAN MODE)", f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'license') OR list_contains({_WORDS}, 'copyright')")


@df_query("fulltext_tokens", f"SELECT doc_id, CAST(len(list_distinct(list_filter({_WORDS}, lambda x: length(x) >= 3))) AS BIGINT) AS n FROM documents")
def fulltext_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(fulltext.tokens(F.col("text"))).cast("long").alias("n"))


@df_query("order_by_collate")
def order_by_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("straße", "Strasse", "éclair", "Eclair", "zebra", "Äpfel", "apfel")], "w string")
    return words.select("w", collation.sort_key(F.col("w")).alias("key")).orderBy(F.expr("w COLLATE UNICODE_CI_AI"), "w")


# What they give depends on time, chance or the session, so rows alone are compared.
mysql_query("fn_now", "SELECT n_nationkey, NOW() AS now_at, CURDATE() AS today FROM nation")
mysql_query("fn_uuid", "SELECT n_nationkey, UUID() AS id FROM nation")
mysql_query("fn_session_info", "SELECT DATABASE() AS db, CURRENT_USER() AS who, VERSION() AS v, CONNECTION_ID() AS c, LAST_INSERT_ID() AS l, ROW_COUNT() AS r")
