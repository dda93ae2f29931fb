import datetime as dt

import pytest

from millrace import programs
from millrace.errors import EngineError
from millrace.session import Session
from millrace.streaming.changelog import ChangeLog, Replica, applied, follow, gtid_set


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/tables")


def got(s, text):
    return [tuple(r) for r in s.sql(text).collect()]


def fails(s, code, text):
    with pytest.raises(EngineError) as e:
        s.sql(text)
    assert e.value.code == code, e.value


def test_insert_select_update_delete(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(8) DEFAULT 'x', cnt INT)")
    assert got(s, "INSERT INTO t VALUES (1, 'a', 1), (2, DEFAULT, 2)") == [(2,)]
    s.sql("INSERT INTO t SET id = 3, cnt = 5")
    assert got(s, "SELECT * FROM t ORDER BY id") == [(1, "a", 1), (2, "x", 2), (3, "x", 5)]
    assert got(s, "UPDATE t SET cnt = cnt + 1 WHERE id > 1 AND name = 'x'") == [(2,)]
    assert got(s, "DELETE FROM t WHERE cnt = 3") == [(1,)]
    assert got(s, "SELECT COUNT(*), SUM(cnt) FROM t") == [(2, 7)]
    fails(s, 1062, "INSERT INTO t VALUES (1, 'b', 1)")
    fails(s, 1136, "INSERT INTO t VALUES (9)")
    fails(s, 1146, "SELECT 1 FROM t; INSERT INTO nope VALUES (1)")


def test_upserts(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(8), cnt INT); INSERT INTO t VALUES (1, 'a', 1)")
    assert got(s, "INSERT INTO t VALUES (1, 'b', 9) ON DUPLICATE KEY UPDATE name = VALUES(name), cnt = cnt + 1") == [(2,)]
    assert got(s, "SELECT * FROM t") == [(1, "b", 2)]
    assert got(s, "INSERT INTO t VALUES (1, 'b', 2) AS n ON DUPLICATE KEY UPDATE name = n.name") == [(0,)]
    assert got(s, "INSERT INTO t VALUES (5, 'p', 1), (5, 'q', 1) ON DUPLICATE KEY UPDATE cnt = cnt + 10") == [(3,)]
    assert got(s, "INSERT IGNORE INTO t VALUES (1, 'z', 99), (2, 'n', 20)") == [(1,)]
    assert got(s, "REPLACE INTO t VALUES (2, 'r', 0), (3, 's', 0)") == [(3,)]
    assert got(s, "SELECT * FROM t ORDER BY id") == [(1, "b", 2), (2, "r", 0), (3, "s", 0), (5, "p", 11)]


def test_constraints(s):
    s.sql("CREATE TABLE p (id INT PRIMARY KEY, u INT UNIQUE, CHECK (u > 0))")
    s.sql("CREATE TABLE c (id INT PRIMARY KEY AUTO_INCREMENT, pid INT NOT NULL, CONSTRAINT fk FOREIGN KEY (pid) REFERENCES p (id))")
    s.sql("INSERT INTO p VALUES (1, 10), (2, NULL)")
    fails(s, 3819, "INSERT INTO p VALUES (3, 0)")
    fails(s, 1062, "INSERT INTO p VALUES (3, 10)")
    fails(s, 1452, "INSERT INTO c (pid) VALUES (7)")
    fails(s, 1048, "INSERT INTO c (pid) VALUES (NULL)")
    s.sql("INSERT INTO c (pid) VALUES (1), (2)")
    assert got(s, "SELECT LAST_INSERT_ID()") == [(1,)]
    s.sql("INSERT INTO c VALUES (10, 1); INSERT INTO c (pid) VALUES (2)")
    assert [r[0] for r in got(s, "SELECT id FROM c ORDER BY id")] == [1, 2, 10, 11]
    fails(s, 1451, "DELETE FROM p WHERE id = 1")
    fails(s, 1451, "UPDATE p SET id = 9 WHERE id = 1")


def test_generated_invisible_enum_and_partitions(s):
    s.sql("CREATE TABLE g (a INT, b INT GENERATED ALWAYS AS (a * 2) VIRTUAL, h INT INVISIBLE DEFAULT 7, e ENUM('Low','High'), f SET('x','y','z'))")
    s.sql("INSERT INTO g (a, e, f) VALUES (3, 'low', 'z,X')")
    assert got(s, "SELECT * FROM g") == [(3, 6, "Low", "x,z")] and got(s, "SELECT h, b FROM g") == [(7, 6)]
    fails(s, 3105, "INSERT INTO g (a, b) VALUES (1, 2)")
    with pytest.raises(Exception, match="truncated"):
        s.sql("INSERT INTO g (a, e) VALUES (1, 'mid')")
    s.sql("CREATE TABLE r (k INT, v INT) PARTITION BY RANGE (k) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN MAXVALUE)")
    s.sql("INSERT INTO r VALUES (1, 1), (50, 2)")
    assert got(s, "SELECT v FROM r WHERE k = 50") == [(2,)]


def test_joined_writes_views_and_ddl(s):
    s.sql("CREATE TABLE a (id INT PRIMARY KEY, v INT); CREATE TABLE b (id INT PRIMARY KEY, w INT)")
    s.sql("INSERT INTO a VALUES (1, 1), (2, 2), (3, 3); INSERT INTO b VALUES (2, 20), (3, 30)")
    assert got(s, "UPDATE a JOIN b ON a.id = b.id SET v = b.w WHERE b.w > 20") == [(1,)]
    assert got(s, "DELETE a FROM a JOIN b ON a.id = b.id WHERE b.w = 20") == [(1,)]
    s.sql("CREATE VIEW big AS SELECT id, v FROM a WHERE v > 5")
    assert got(s, "SELECT id FROM big") == [(3,)]
    fails(s, 1347, "CREATE VIEW a AS SELECT 1")
    s.sql("ALTER TABLE a ADD COLUMN n INT DEFAULT 4; ALTER TABLE a RENAME COLUMN v TO val; ALTER TABLE a MODIFY n BIGINT")
    assert got(s, "SELECT id, val, n FROM a ORDER BY id") == [(1, 1, 4), (3, 30, 4)]
    s.sql("ALTER TABLE a DROP COLUMN n; CREATE TABLE a2 LIKE a; CREATE TABLE a3 AS SELECT id FROM a; RENAME TABLE a TO t1, a2 TO a, t1 TO a2")
    assert got(s, "SELECT COUNT(*) FROM a") == [(0,)] and got(s, "SELECT COUNT(*) FROM a2") == [(2,)] and got(s, "SELECT COUNT(*) FROM a3") == [(2,)]
    s.sql("TRUNCATE TABLE a2; DROP TABLE a3; DROP TABLE IF EXISTS a3")
    fails(s, 1051, "DROP TABLE a3")
    s.sql("CREATE DATABASE d2; USE d2; CREATE TABLE x (i INT); INSERT INTO x VALUES (1); USE default")
    assert got(s, "SELECT i FROM d2.x") == [(1,)]


def test_transactions(s):
    s.sql("CREATE TABLE t (id INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT p; INSERT INTO t VALUES (2); ROLLBACK TO p")
    assert got(s, "SELECT id FROM t") == [(1,)]
    s.sql("ROLLBACK")
    assert got(s, "SELECT id FROM t") == []
    s.sql("BEGIN; INSERT INTO t VALUES (5); COMMIT; ROLLBACK")
    assert got(s, "SELECT id FROM t") == [(5,)]


def test_variables_prepared_and_found_rows(s):
    s.sql("SET @x = 5, @y = 'q'; CREATE TABLE t (id INT); INSERT INTO t VALUES (1), (2), (3)")
    assert got(s, "SELECT @x + 1, @y, @none") == [(6, "q", None)]
    s.sql("PREPARE st FROM 'SELECT id FROM t WHERE id > ?'; SET @a = 1")
    assert len(got(s, "EXECUTE st USING @a")) == 2
    s.sql("DEALLOCATE PREPARE st")
    fails(s, 1243, "EXECUTE st")
    got(s, "SELECT SQL_CALC_FOUND_ROWS id FROM t ORDER BY id LIMIT 1")
    assert got(s, "SELECT FOUND_ROWS(), DATABASE()") == [(3, "default")]
    fails(s, 1193, "SET SESSION nope = 1")
    fails(s, 1238, "SET GLOBAL version = 1")


def test_procedures(s):
    s.sql("""CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)""")
    s.sql("""CREATE PROCEDURE total(IN least INT, OUT s INT) BEGIN
        DECLARE done INT DEFAULT 0; DECLARE x INT; DECLARE c CURSOR FOR SELECT v FROM t WHERE id >= least;
        DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
        SET s = 0; OPEN c;
        l: LOOP FETCH c INTO x; IF done = 1 THEN LEAVE l; END IF; SET s = s + x; END LOOP l; CLOSE c; END""")
    s.sql("CALL total(2, @s)")
    assert got(s, "SELECT @s") == [(50,)]
    s.sql("CREATE PROCEDURE bad() BEGIN DECLARE EXIT HANDLER FOR SQLSTATE '45000' SET @m = 'caught'; SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'no'; SET @m = 'missed'; END")
    s.sql("CALL bad()")
    assert got(s, "SELECT @m") == [("caught",)]
    s.sql("CREATE PROCEDURE fill() BEGIN DECLARE i INT DEFAULT 0; WHILE i < 3 DO INSERT INTO t VALUES (100 + i, i); SET i = i + 1; END WHILE; END; CALL fill()")
    assert got(s, "SELECT COUNT(*) FROM t WHERE id >= 100") == [(3,)]
    fails(s, 1305, "CALL nope()")
    s.sql("CREATE FUNCTION seven() RETURNS INT RETURN 3 + 4")
    assert got(s, "SELECT seven() * 2") == [(14,)]


def test_triggers_and_events(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT); CREATE TABLE log (id INT, was INT, now INT)")
    s.sql("CREATE TRIGGER b BEFORE INSERT ON t FOR EACH ROW BEGIN IF NEW.v < 0 THEN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'negative'; END IF; SET NEW.v = NEW.v * 2; END")
    s.sql("CREATE TRIGGER a AFTER UPDATE ON t FOR EACH ROW INSERT INTO log VALUES (NEW.id, OLD.v, NEW.v)")
    s.sql("INSERT INTO t VALUES (1, 5), (2, 6)")
    fails(s, 1644, "INSERT INTO t VALUES (3, -1)")
    s.sql("UPDATE t SET v = v + 1")
    assert sorted(got(s, "SELECT * FROM log")) == [(1, 10, 11), (2, 12, 13)]
    s.sql("CREATE EVENT e ON SCHEDULE EVERY 1 HOUR DO INSERT INTO log VALUES (9, 9, 9); CREATE EVENT once ON SCHEDULE AT '2030-01-01 00:00:00' DO DELETE FROM log WHERE id = 1")
    now = dt.datetime(2026, 1, 1)
    assert programs.run_due_events(s, now) == ["e"] and programs.run_due_events(s, now + dt.timedelta(minutes=5)) == []
    assert programs.run_due_events(s, dt.datetime(2031, 1, 1)) == ["e", "once"] and "once" not in s.catalog.programs["EVENT"]
    assert sorted(r[0] for r in got(s, "SELECT id FROM log")) == [2, 9, 9]


def test_metadata_explain_and_privileges(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, k INT, b VARCHAR(9), KEY kk (k), FULLTEXT KEY ft (b)); INSERT INTO t VALUES (1, 10, 'foo bar'), (2, 20, 'baz qux')")
    assert [(r[0], r[3]) for r in got(s, "DESCRIBE t")] == [("id", "PRI"), ("k", "MUL"), ("b", "MUL")]
    assert got(s, "SELECT COLUMN_NAME FROM information_schema.columns WHERE TABLE_NAME = 't' AND COLUMN_KEY = 'PRI'") == [("id",)]
    assert got(s, "SHOW TABLES") == [("t",)] and "PRIMARY KEY (`id`)" in got(s, "SHOW CREATE TABLE t")[0][1]
    assert [got(s, f"EXPLAIN SELECT * FROM t WHERE {w}")[0][3] for w in ("id = 1", "k = 3", "k BETWEEN 1 AND 5", "b = 'x'")] == ["const", "ref", "range", "ALL"]
    assert got(s, "SELECT id FROM t WHERE MATCH(b) AGAINST ('+foo' IN BOOLEAN MODE)") == [(1,)]
    fails(s, 1235, "SELECT id FROM t WHERE MATCH(b) AGAINST ('foo' IN NATURAL LANGUAGE MODE)")
    s.sql("CREATE USER bob; GRANT SELECT ON t TO bob")
    s.user = "bob@localhost"
    assert len(got(s, "SELECT id FROM t")) == 2
    fails(s, 1142, "DELETE FROM t")


def test_recursive_and_spatial(s):
    assert len(got(s, "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 500) SELECT i FROM n")) == 500
    assert got(s, "SELECT ST_AsText(ST_GeomFromText('POINT(1 2)')), ST_X(ST_GeomFromText('POINT(1 2)')), ST_GeometryType(ST_GeomFromText('LINESTRING(0 0,1 1)'))") == [("POINT(1 2)", 1.0, "LINESTRING")]
    assert got(s, "SELECT ST_Latitude(ST_GeomFromText('POINT(40 -70)', 4326)), ST_SRID(ST_GeomFromText('POINT(1 2)', 4326)), ST_AsText(ST_GeomFromText('MULTIPOLYGON(((0 0,4 0,4 4,0 0)))'))") == [(40.0, 4326, "MULTIPOLYGON(((0 0,4 0,4 4,0 0)))")]


def test_change_stream_and_replica(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    s = Session(spark, f"file://{tmp_path}/tables", log)
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v STRING)")
    s.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b'); UPDATE t SET v = 'c' WHERE id = 2")
    replica = Replica(spark, log.path, "t", "id int, v string", ["id"], f"file://{tmp_path}/replica")
    replica.catch_up(f"file://{tmp_path}/cp")
    assert sorted(map(tuple, replica.state().collect())) == [(1, "a"), (2, "c")]
    s.sql("DELETE FROM t WHERE id = 1; BEGIN; INSERT INTO t VALUES (7, 'x'); ROLLBACK")
    replica.catch_up(f"file://{tmp_path}/cp")
    replica.catch_up(f"file://{tmp_path}/cp")
    assert sorted(map(tuple, replica.state().collect())) == [(2, "c")] and log.last == 3
    again = Replica(spark, log.path, "t", "id int, v string", ["id"], f"file://{tmp_path}/replica")
    assert again.seen == 3 and sorted(map(tuple, again.state().collect())) == [(2, "c")]
    assert gtid_set("u", [1, 2, 3, 5]) == "u:1-3:5" and follow(spark, log.path).isStreaming
    assert applied(replica.state(), spark.read.parquet(log.path), "id int, v string", ["id"]).count() == 1


def test_advisory_locks(spark, s, tmp_path):
    other = Session(spark, f"file://{tmp_path}/other")
    assert got(s, "SELECT GET_LOCK('a', 0), IS_FREE_LOCK('a'), GET_LOCK('a', 0)") == [(1, 0, 1)]
    assert got(other, "SELECT GET_LOCK('a', 0), RELEASE_LOCK('a'), RELEASE_LOCK('none')") == [(0, 0, None)]
    assert got(s, "SELECT RELEASE_LOCK('a'), RELEASE_LOCK('a'), IS_USED_LOCK('a')") == [(1, 1, None)]


def test_auto_increment_of_whole_queries(s):
    s.sql("CREATE TABLE src (v INT); INSERT INTO src VALUES (1), (2), (3), (4); CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v INT); INSERT INTO t (v) SELECT v FROM src")
    assert sorted(r[0] for r in got(s, "SELECT id FROM t")) == [1, 2, 3, 4]
    s.sql("INSERT INTO t VALUES (10, 0), (NULL, 1), (5, 2), (NULL, 3)")
    assert [r[0] for r in got(s, "SELECT id FROM t WHERE id > 4 ORDER BY id")] == [5, 10, 11, 12]
