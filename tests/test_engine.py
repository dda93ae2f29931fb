"""Plans and writes that the scenario queries do not show."""

import pytest

from millrace.errors import EngineError
from millrace.lexer import statements
from millrace.session import Session


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/tables")


def got(s, text):
    return sorted(map(tuple, s.sql(text).collect()), key=str)


def test_a_lookup_reads_one_partition(s):
    s.sql("CREATE TABLE r (k INT, v INT) PARTITION BY RANGE (k) (PARTITION p0 VALUES LESS THAN (10), PARTITION p1 VALUES LESS THAN (20), PARTITION p2 VALUES LESS THAN MAXVALUE)")
    s.sql("INSERT INTO r VALUES (1, 1), (15, 2), (16, 3), (50, 4), (NULL, 5)")
    df = s.sql("SELECT v FROM r WHERE k = 15")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(_partition#" in plan.split("PartitionFilters")[1].split("]")[0] and " = 1)" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert got(s, "SELECT v FROM r WHERE k = 15") == [(2,)] and len(got(s, "SELECT v FROM r")) == 5 and got(s, "SELECT v FROM r WHERE k IS NULL") == [(5,)]


def test_upserts_of_one_batch_see_each_other(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, u INT UNIQUE, v INT); INSERT INTO t VALUES (1, 10, 0)")
    # The second row meets row 1 by u, the first by id: both change it, in order.
    assert got(s, "INSERT INTO t VALUES (1, 55, 2), (9, 10, 3) ON DUPLICATE KEY UPDATE v = v * 10 + VALUES(v)") == [(4,)]
    assert got(s, "SELECT * FROM t") == [(1, 10, 23)]
    # A row that an earlier one of the batch made is met by later ones.
    assert got(s, "INSERT INTO t VALUES (5, 50, 1), (6, 50, 2), (5, 60, 3) ON DUPLICATE KEY UPDATE v = v * 10 + VALUES(v)") == [(5,)]
    assert got(s, "SELECT * FROM t") == [(1, 10, 23), (5, 50, 123)]


def test_upserts_are_checked_like_updates(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT NOT NULL, CHECK (v > 0)); INSERT INTO t VALUES (1, 5)")
    for code, value in ((3819, "-v"), (1048, "NULL")):
        with pytest.raises(EngineError) as e:
            s.sql(f"INSERT INTO t VALUES (1, 5) ON DUPLICATE KEY UPDATE v = {value}")
        assert e.value.code == code
    assert got(s, "SELECT * FROM t") == [(1, 5)]


def test_generated_ids_follow_given_ones_over_tasks(s, spark):
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY AUTO_INCREMENT, v BIGINT)")
    rows = spark.range(0, 40, 1, 5).selectExpr("IF(id % 13 = 5, id * 100, NULL) AS id", "id AS v")
    s.load("src", rows)
    s.sql("INSERT INTO t SELECT id, v FROM src ORDER BY v")
    want, last = [], 0
    for v in range(40):
        want.append((v * 100 if v % 13 == 5 else last + 1, v))
        last = max(last, want[-1][0])
    assert got(s, "SELECT id, v FROM t") == sorted(want, key=str)


def test_statements_after_others_keep_their_blocks(s):
    assert len(statements("SELECT 1; CREATE PROCEDURE p() BEGIN IF 1 THEN SET @a = 1; END IF; END; SELECT 2")) == 3


def test_a_text_key_is_one_whatever_its_case(s):
    s.sql("CREATE TABLE t (name VARCHAR(9) PRIMARY KEY, n INT); INSERT INTO t VALUES ('Ab', 1); INSERT IGNORE INTO t VALUES ('aB', 2), ('c', 3); REPLACE INTO t VALUES ('C', 4)")
    assert got(s, "SELECT * FROM t") == [("Ab", 1), ("C", 4)]
    s.sql("CREATE TABLE b (name VARCHAR(9) COLLATE utf8mb4_bin PRIMARY KEY); INSERT INTO b VALUES ('x'), ('X')")
    assert got(s, "SELECT name FROM b WHERE name = 'X'") == [("X",)]


def test_many_rows_are_one_local_relation(s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, a VARCHAR(40), d DOUBLE DEFAULT 2.5)")
    s.sql("INSERT INTO t VALUES " + ", ".join(f"({k}, {'NULL' if k % 3 else repr(str(k))}, DEFAULT)" for k in range(300)))
    assert got(s, "SELECT COUNT(*), COUNT(a), SUM(d) FROM t") == [(300, 100, 750.0)]
    s.sql("INSERT INTO t (id, a) VALUES (1000, UUID()), (1001, 'x')")
    assert got(s, "SELECT LENGTH(a) FROM t WHERE id >= 1000") == [(1,), (36,)]
