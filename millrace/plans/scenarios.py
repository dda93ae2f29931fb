"""Scripts of statements whose last result is the query's, and statements that must fail with a given error."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from millrace import programs
from millrace.errors import EngineError
from millrace.plans.registry import TABLES, df_query, load
from millrace.session import Session


def _session(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session with those of the tables that ``text`` names."""
    s = Session(spark)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            s.load(t, load(spark, sf_dir, t))
    return s


def script(name: str, statements: str, oracle: str) -> None:
    """Register the last result of ``statements``."""

    @df_query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir, statements).sql(statements)


def fails(name: str, code: int, setup: str, statement: str, after: str = "SELECT 0 AS n", n: int = 0, user: str | None = None) -> None:
    """Register (code, n): the error of ``statement`` after ``setup``, and the number that ``after`` gives then."""

    @df_query(name, f"SELECT {code} AS code, CAST({n} AS BIGINT) AS n")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(spark)
        if setup:
            s.sql(setup)
        found, who = 0, s.user
        try:
            s.user = user or who
            s.sql(statement).collect()
        except EngineError as e:
            found = e.code
        except Exception as e:  # raised inside a task, with the number in front of the text
            found = int((re.search(r"\b(1265|3636)\b", str(e)) or [0])[0])
        s.user = who
        return spark.createDataFrame([(found, int(s.sql(after).first()[0]))], "code int, n long")


def values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


# ---- writes ----
_TWO = "CREATE TABLE t (id INT PRIMARY KEY, u INT UNIQUE, v INT CHECK (v >= 0)); INSERT INTO t VALUES (1, 10, 0), (2, 20, 0); "
_PARENT = "CREATE TABLE p (id INT PRIMARY KEY, w INT); CREATE TABLE c (id INT PRIMARY KEY AUTO_INCREMENT, pid INT NOT NULL, CONSTRAINT fk FOREIGN KEY (pid) REFERENCES p (id)); INSERT INTO p VALUES (1, 1), (2, 2); INSERT INTO c (pid) VALUES (1)"
script("dml_upsert_two_keys", _TWO + "INSERT INTO t VALUES (1, 99, 5), (7, 20, 6), (8, 80, 7) ON DUPLICATE KEY UPDATE v = VALUES(v); SELECT id, u, v FROM t", values("id, u, v", "(1, 10, 5)", "(2, 20, 6)", "(8, 80, 7)"))
script("dml_upsert_batch", _TWO + "INSERT INTO t VALUES (1, NULL, 1), (3, 30, 2), (1, NULL, 4), (3, 31, 8), (1, NULL, 16) ON DUPLICATE KEY UPDATE v = v + VALUES(v); SELECT id, u, v FROM t", values("id, u, v", "(1, 10, 21)", "(2, 20, 0)", "(3, 30, 10)"))
fails("dml_upsert_check", 3819, _TWO, "INSERT INTO t VALUES (1, 10, 3) ON DUPLICATE KEY UPDATE v = v - VALUES(v)", "SELECT SUM(v) FROM t", 0)
fails("dml_upsert_unique", 1062, _TWO, "INSERT INTO t VALUES (1, 11, 3) ON DUPLICATE KEY UPDATE u = 20", "SELECT SUM(u) FROM t", 30)
fails("dml_upsert_parent", 1451, _PARENT, "INSERT INTO p VALUES (1, 5) ON DUPLICATE KEY UPDATE id = 9", "SELECT SUM(id) FROM p", 3)
fails("dml_replace_parent", 1451, _PARENT, "REPLACE INTO p VALUES (1, 5)", "SELECT SUM(w) FROM p", 3)
script("dml_replace_two_keys", _TWO + "REPLACE INTO t VALUES (1, 20, 5); SELECT id, u, v FROM t", values("id, u, v", "(1, 20, 5)"))
script("dml_insert_defaults", "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, a VARCHAR(9) DEFAULT 'none', b INT DEFAULT 4); INSERT INTO t VALUES (DEFAULT, 'x', DEFAULT); INSERT INTO t (b) VALUES (9); INSERT INTO t SET a = 'y'; INSERT INTO t (id, a) VALUES (20, 'z'); INSERT INTO t (a) VALUES ('after'); SELECT id, a, b FROM t", values("id, a, b", "(1, 'x', 4)", "(2, 'none', 9)", "(3, 'y', 4)", "(20, 'z', 4)", "(21, 'after', 4)"))
script("dml_insert_cte", "CREATE TABLE t (k INT, n BIGINT); INSERT INTO t WITH big AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) SELECT k, n FROM big WHERE n > 1; SELECT k, n FROM t", "SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
fails("dml_not_null", 1048, _PARENT, "INSERT INTO c (pid) VALUES (NULL)")
fails("dml_check", 3819, _TWO, "UPDATE t SET v = -1 WHERE id = 2")
fails("dml_duplicate", 1062, _TWO, "INSERT INTO t VALUES (5, 20, 1)", "SELECT COUNT(*) FROM t", 2)
fails("dml_update_duplicate", 1062, _TWO, "UPDATE t SET u = 10", "SELECT SUM(u) FROM t", 30)
fails("dml_orphan", 1452, _PARENT, "INSERT INTO c (pid) VALUES (77)", "SELECT COUNT(*) FROM c", 1)
fails("dml_delete_parent", 1451, _PARENT, "DELETE FROM p WHERE w = 1", "SELECT COUNT(*) FROM p", 2)
fails("dml_update_parent", 1451, _PARENT, "UPDATE p SET id = 8 WHERE id = 1", "SELECT SUM(id) FROM p", 3)
script("dml_enum_set", "CREATE TABLE t (e ENUM('Low','High'), f SET('x','y','z')); INSERT INTO t VALUES ('HIGH', 'z,X'), (NULL, ''), ('low', 'y'); SELECT e, f FROM t", values("e, f", "('High', 'x,z')", "(NULL, '')", "('Low', 'y')"))
fails("dml_enum_truncated", 1265, "CREATE TABLE t (e ENUM('Low','High'))", "INSERT INTO t VALUES ('mid')", "SELECT COUNT(*) FROM t")
fails("dml_generated_guard", 3105, "CREATE TABLE t (a INT, b INT GENERATED ALWAYS AS (a * 2) VIRTUAL)", "INSERT INTO t (a, b) VALUES (1, 2)")
fails("dml_column_count", 1136, "CREATE TABLE t (a INT, b INT)", "INSERT INTO t VALUES (1, 2), (3)")

# ---- definitions ----
script("ddl_generated", "CREATE TABLE t (k BIGINT, price DOUBLE, tax DOUBLE, gross DOUBLE GENERATED ALWAYS AS (ROUND(price * (1 + tax), 4)) VIRTUAL); INSERT INTO t SELECT l_orderkey, l_extendedprice, l_tax FROM lineitem WHERE l_linenumber = 1; SELECT k, gross FROM t", "SELECT l_orderkey AS k, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem WHERE l_linenumber = 1")
script("ddl_invisible", "CREATE TABLE t (a INT, h INT INVISIBLE DEFAULT 7); INSERT INTO t VALUES (1), (2); SELECT s.a, s.n, t.h FROM (SELECT *, 1 AS n FROM t) s JOIN t ON s.a = t.a", values("a, n, h", "(1, 1, 7)", "(2, 1, 7)"))
script("ddl_view", "CREATE VIEW rich AS SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000; CREATE OR REPLACE VIEW rich AS SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 6000; SELECT c_custkey, c_acctbal FROM rich WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 6000 AND c_mktsegment = 'BUILDING'")
fails("ddl_view_over_table", 1347, "CREATE TABLE a (i INT)", "CREATE VIEW a AS SELECT 1")
script("ddl_ctas", "CREATE TABLE t AS SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey = 1; INSERT INTO t VALUES (99, 'x'); SELECT k, n_name FROM t", "SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 99, 'x'")
script("ddl_like", "CREATE TABLE a (id INT PRIMARY KEY, v INT DEFAULT 3); INSERT INTO a VALUES (1, 1); CREATE TABLE b LIKE a; INSERT INTO b (id) VALUES (5); SELECT id, v FROM b", values("id, v", "(5, 3)"))
script("ddl_rename_swap", "CREATE TABLE a (i INT); CREATE TABLE b (i INT); INSERT INTO a VALUES (1); INSERT INTO b VALUES (2), (3); RENAME TABLE a TO t1, b TO a, t1 TO b; SELECT 'a' AS t, i FROM a UNION ALL SELECT 'b', i FROM b", values("t, i", "('a', 2)", "('a', 3)", "('b', 1)"))
script("ddl_truncate", "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT); INSERT INTO t (v) VALUES (5), (6); TRUNCATE TABLE t; INSERT INTO t (v) VALUES (7); SELECT id, v FROM t", values("id, v", "(1, 7)"))
script("ddl_alter_columns", "CREATE TABLE t (a INT, b INT, c VARCHAR(5)); INSERT INTO t VALUES (1, 2, 'x'); ALTER TABLE t DROP COLUMN b; ALTER TABLE t MODIFY a BIGINT; ALTER TABLE t CHANGE COLUMN c d VARCHAR(9); ALTER TABLE t ADD COLUMN e INT DEFAULT 8; SELECT * FROM t", values("a, d, e", "(CAST(1 AS BIGINT), 'x', 8)"))
script("ddl_alter_keys", "CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 1), (2, 2); ALTER TABLE t ADD UNIQUE KEY ub (b); INSERT IGNORE INTO t VALUES (3, 2), (4, 4); ALTER TABLE t DROP INDEX ub; INSERT INTO t VALUES (5, 4); SELECT a, b FROM t", values("a, b", "(1, 1)", "(2, 2)", "(4, 4)", "(5, 4)"))
script("ddl_databases", "CREATE DATABASE d2; USE d2; CREATE TABLE x (i INT); INSERT INTO x VALUES (1), (2); USE default; SELECT SUM(i) AS s FROM d2.x", values("s", "(CAST(3 AS BIGINT))"))
fails("ddl_unknown_database", 1049, "", "USE nowhere")
fails("ddl_unknown_table", 1051, "", "DROP TABLE nothing")
script("ddl_partitions", "CREATE TABLE r (k BIGINT, c BIGINT) PARTITION BY RANGE (c) (PARTITION p0 VALUES LESS THAN (250), PARTITION p1 VALUES LESS THAN (500), PARTITION p2 VALUES LESS THAN MAXVALUE); INSERT INTO r SELECT o_orderkey, o_custkey FROM orders; DELETE FROM r WHERE c = 7; SELECT k, c FROM r WHERE c BETWEEN 5 AND 260", "SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey BETWEEN 5 AND 260 AND o_custkey <> 7")
script("ddl_index_lookup", "CREATE TABLE t (id INT PRIMARY KEY, a INT, b VARCHAR(9)); CREATE INDEX ab ON t (a, b); CREATE UNIQUE INDEX ub ON t (b); INSERT INTO t VALUES (1, 5, 'x'), (2, 5, 'y'), (3, 6, 'z'); SELECT id FROM t WHERE a = 5 AND b = 'Y'", values("id", "(2)"))

# ---- collation ----
_NAMES = "CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(20), bin VARCHAR(20) COLLATE utf8mb4_bin); INSERT INTO t VALUES (1, 'alice', 'alice'), (2, 'Bob', 'Bob'), (3, 'ALICE', 'ALICE'), (4, 'Éric', 'Éric'), (5, 'eric', 'eric'), (6, 'straße', 'straße'), (7, NULL, NULL); "
script("collate_equal", _NAMES + "SELECT id FROM t WHERE name = 'Alice' OR name = 'STRASSE'", values("id", "(1)", "(3)", "(6)"))
script("collate_in_between_like", _NAMES + "SELECT id, name IN ('BOB', 'x') AS a, name BETWEEN 'b' AND 'BOC' AS b, name LIKE 'AL%' AS c, name NOT LIKE '%E' AS d FROM t WHERE id < 4", values("id, a, b, c, d", "(1, false, false, true, false)", "(2, true, true, false, true)", "(3, false, false, true, false)"))
script("collate_group", _NAMES + "SELECT LOWER(MIN(name)) AS w, COUNT(*) AS n FROM t WHERE id < 4 GROUP BY name", values("w, n", "('alice', CAST(2 AS BIGINT))", "('bob', CAST(1 AS BIGINT))"))
script("collate_distinct", _NAMES + "SELECT COUNT(DISTINCT name) AS a, COUNT(DISTINCT bin) AS b FROM t", values("a, b", "(CAST(4 AS BIGINT), CAST(6 AS BIGINT))"))
script("collate_join", _NAMES + "SELECT a.id, b.id AS other FROM t a JOIN t b ON a.name = b.name AND a.id < b.id", values("id, other", "(1, 3)", "(4, 5)"))
script("collate_order", _NAMES + "SELECT id, ROW_NUMBER() OVER (ORDER BY name, id) AS place FROM t WHERE name IS NOT NULL", values("id, place", "(1, 1)", "(3, 2)", "(2, 3)", "(4, 4)", "(5, 5)", "(6, 6)"))
script("collate_binary", _NAMES + "SELECT id FROM t WHERE bin = 'alice' OR bin > 'b'", values("id", "(1)", "(5)", "(6)", "(4)"))
script("collate_write", _NAMES + "UPDATE t SET name = 'Carol' WHERE name = 'ALICE'; DELETE FROM t WHERE name = 'ERIC'; SELECT id, name FROM t", values("id, name", "(1, 'Carol')", "(2, 'Bob')", "(3, 'Carol')", "(6, 'straße')", "(7, NULL)"))
fails("collate_unique", 1062, "CREATE TABLE t (name VARCHAR(9) PRIMARY KEY); INSERT INTO t VALUES ('ab')", "INSERT INTO t VALUES ('AB')", "SELECT COUNT(*) FROM t", 1)
script("collate_upsert", "CREATE TABLE t (name VARCHAR(9) PRIMARY KEY, n INT); INSERT INTO t VALUES ('ab', 1); INSERT INTO t VALUES ('AB', 5), ('c', 2) ON DUPLICATE KEY UPDATE n = n + VALUES(n); SELECT name, n FROM t", values("name, n", "('ab', 6)", "('c', 2)"))

# ---- programs ----
_T3 = "CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30); "
script("procedure_cursor", _T3 + "CREATE PROCEDURE total(IN least INT, OUT s INT) BEGIN DECLARE done INT DEFAULT 0; DECLARE x INT; DECLARE c CURSOR FOR SELECT v FROM t WHERE id >= least; DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1; SET s = 0; OPEN c; l: LOOP FETCH c INTO x; IF done = 1 THEN LEAVE l; END IF; SET s = s + x; END LOOP l; CLOSE c; END; CALL total(2, @s); SELECT CAST(@s AS SIGNED) AS s", values("s", "(CAST(50 AS BIGINT))"))
script("procedure_if", "CREATE PROCEDURE kind(IN n INT, OUT k CHAR(9)) BEGIN IF n < 0 THEN SET k = 'minus'; ELSEIF n = 0 THEN SET k = 'zero'; ELSE SET k = 'plus'; END IF; END; CALL kind(-5, @a); CALL kind(0, @b); CALL kind(3, @c); SELECT @a AS a, @b AS b, @c AS c", values("a, b, c", "('minus', 'zero', 'plus')"))
script("procedure_inout", "CREATE PROCEDURE twice(INOUT n INT) BEGIN SET n = n * 2; END; SET @n = 4; CALL twice(@n); CALL twice(@n); SELECT CAST(@n AS SIGNED) AS n", values("n", "(CAST(16 AS BIGINT))"))
script("procedure_handler", "CREATE PROCEDURE p() BEGIN DECLARE EXIT HANDLER FOR SQLSTATE '45000' SET @m = 'caught'; SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'no'; SET @m = 'missed'; END; CALL p(); SELECT @m AS m", values("m", "('caught')"))
fails("procedure_signal", 1644, "CREATE PROCEDURE p() BEGIN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'stop'; END", "CALL p()")
fails("procedure_unknown", 1305, "", "CALL nothing()")
script("trigger_before", "CREATE TABLE t (id INT PRIMARY KEY, v INT); CREATE TRIGGER b BEFORE INSERT ON t FOR EACH ROW SET NEW.v = NEW.v * 2; INSERT INTO t VALUES (1, 5), (2, NULL); SELECT id, v FROM t", values("id, v", "(1, 10)", "(2, NULL)"))
script("trigger_after_delete", _T3 + "CREATE TABLE gone (id INT, v INT); CREATE TRIGGER d AFTER DELETE ON t FOR EACH ROW INSERT INTO gone VALUES (OLD.id, OLD.v); DELETE FROM t WHERE v > 15; SELECT id, v FROM gone", values("id, v", "(2, 20)", "(3, 30)"))
fails("trigger_signal", 1644, "CREATE TABLE t (id INT PRIMARY KEY, v INT); CREATE TRIGGER b BEFORE INSERT ON t FOR EACH ROW BEGIN IF NEW.v < 0 THEN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'negative'; END IF; END", "INSERT INTO t VALUES (1, -1)", "SELECT COUNT(*) FROM t")


@df_query("events_due", values("id", "(2)", "(9)", "(9)"))
def events_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.sql("CREATE TABLE log (id INT); INSERT INTO log VALUES (1), (2); CREATE EVENT e ON SCHEDULE EVERY 1 HOUR DO INSERT INTO log VALUES (9); CREATE EVENT once ON SCHEDULE AT '2030-01-01 00:00:00' DO DELETE FROM log WHERE id = 1")
    for now in (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 5), dt.datetime(2031, 1, 1)):
        programs.run_due_events(s, now)
    return s.sql("SELECT id FROM log")


# ---- sessions ----
script("session_variables", "SET @x = 5, @y = 'q'; SELECT @x + 1 AS a, @y AS b, @none AS c", values("a, b, c", "(6, 'q', NULL)"))
script("session_assignment", "SELECT @k := 3 + 4; SELECT CAST(@k AS SIGNED) AS k", values("k", "(CAST(7 AS BIGINT))"))
script("session_last_id", "CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT); INSERT INTO t (v) VALUES (1), (2); INSERT INTO t (v) VALUES (3), (4); SELECT CAST(LAST_INSERT_ID() AS SIGNED) AS id, CAST(ROW_COUNT() AS SIGNED) AS n", values("id, n", "(CAST(3 AS BIGINT), CAST(2 AS BIGINT))"))
script("session_locks", "SELECT GET_LOCK('scenario', 0) AS a, IS_FREE_LOCK('scenario') AS b, RELEASE_LOCK('scenario') AS c, IS_FREE_LOCK('scenario') AS d", values("a, b, c, d", "(1, 0, 1, 1)"))
script("session_select_into", _T3 + "SELECT MAX(v), COUNT(*) INTO @m, @n FROM t; SELECT CAST(@m AS SIGNED) AS m, CAST(@n AS SIGNED) AS n", values("m, n", "(CAST(30 AS BIGINT), CAST(3 AS BIGINT))"))
script("txn_rollback", _T3 + "BEGIN; DELETE FROM t; ROLLBACK; BEGIN; UPDATE t SET v = 0 WHERE id = 1; COMMIT; ROLLBACK; SELECT id, v FROM t", values("id, v", "(1, 0)", "(2, 20)", "(3, 30)"))
fails("session_unknown_variable", 1193, "", "SET SESSION nope = 1")
fails("session_read_only", 1238, "", "SET GLOBAL version = 1")
fails("prepared_unknown", 1243, "PREPARE p FROM 'SELECT 1'; DEALLOCATE PREPARE p", "EXECUTE p")
fails("grant_denied", 1142, _T3 + "CREATE USER bob; GRANT SELECT ON t TO bob", "DELETE FROM t", "SELECT COUNT(*) FROM t", 3, user="bob@localhost")
fails("fulltext_mode", 1235, "CREATE TABLE t (id INT, b VARCHAR(9), FULLTEXT KEY ft (b))", "SELECT id FROM t WHERE MATCH(b) AGAINST ('x' IN NATURAL LANGUAGE MODE)")
script("fulltext_table", "CREATE TABLE t (id INT, b VARCHAR(50), FULLTEXT KEY ft (b)); INSERT INTO t VALUES (1, 'Foo bar'), (2, 'baz, FOO'), (3, 'bar only'); SELECT id FROM t WHERE MATCH(b) AGAINST ('+foo -bar' IN BOOLEAN MODE)", values("id", "(2)"))
script("describe_table", "CREATE TABLE t (id INT PRIMARY KEY, k INT NOT NULL, b VARCHAR(9) DEFAULT 'x', KEY kk (k)); DESCRIBE t", values('"Field", "Type", "Null", "Key", "Default", "Extra"', "('id', 'int', 'NO', 'PRI', NULL, '')", "('k', 'int', 'NO', 'MUL', NULL, '')", "('b', 'varchar(9)', 'YES', '', 'x', '')"))
script("show_tables", "CREATE TABLE b (i INT); CREATE TABLE a (i INT); SHOW TABLES", values('"Tables_in_default"', "('a')", "('b')"))

# ---- spatial ----
script("spatial_kinds", "SELECT ST_AsText(ST_LineFromText('LINESTRING(0 0,1 2)')) AS a, ST_AsText(ST_PolyFromText('POLYGON((0 0,4 0,4 4,0 0))')) AS b, ST_AsText(ST_MPointFromText('MULTIPOINT(1 1,2 2)')) AS c, ST_AsText(ST_MLineFromText('MULTILINESTRING((0 0,1 1),(2 2,3 3))')) AS d, ST_AsText(ST_MPolyFromText('MULTIPOLYGON(((0 0,4 0,4 4,0 0)))')) AS e", values("a, b, c, d, e", "('LINESTRING(0 0,1 2)', 'POLYGON((0 0,4 0,4 4,0 0))', 'MULTIPOINT((1 1),(2 2))', 'MULTILINESTRING((0 0,1 1),(2 2,3 3))', 'MULTIPOLYGON(((0 0,4 0,4 4,0 0)))')"))
script("spatial_properties", "SELECT CAST(ST_SRID(g) AS SIGNED) AS srid, ST_Latitude(g) AS lat, ST_Longitude(g) AS lon, CAST(ST_Dimension(g) AS SIGNED) AS d, CAST(ST_IsEmpty(g) AS SIGNED) AS e, CAST(ST_SRID(ST_PointFromText('POINT(3 4)')) AS SIGNED) AS z FROM (SELECT ST_GeomFromText('POINT(40 -70)', 4326) AS g) p", values("srid, lat, lon, d, e, z", "(CAST(4326 AS BIGINT), CAST(40 AS DOUBLE), CAST(-70 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT))"))
