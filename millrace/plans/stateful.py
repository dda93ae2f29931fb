"""Scenarios that write: DML, transactions, programs, metadata, spatial functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import df_query, load
from millrace.session import Session
from millrace.storage import shared_root
from millrace.streaming import changelog
from millrace.streaming.changelog import ChangeLog, Replica


def _customers(spark: SparkSession, sf_dir: str, log: ChangeLog | None = None) -> Session:
    s = Session(spark, changelog=log)
    s.load("cust", load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), ("c_custkey",))
    return s


_ALL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM cust"


def scenario(name: str, statements: str, oracle: str):
    """Register: run ``statements`` over the table cust, then return it whole."""

    @df_query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _customers(spark, sf_dir)
        s.sql(statements)
        return s.sql(_ALL)


scenario("dml_update", "UPDATE cust SET c_acctbal = c_acctbal + 100, c_name = UPPER(c_name) WHERE c_nationkey IN (1, 2) AND NOT c_acctbal < 0", "SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) AND c_acctbal >= 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey IN (1, 2) AND c_acctbal >= 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
scenario("dml_delete", "DELETE FROM cust WHERE c_acctbal < 1000 OR c_nationkey = 3", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 1000 OR c_nationkey = 3)")
scenario("dml_insert_select", "INSERT INTO cust SELECT c_custkey + 1000000, c_name, c_nationkey, 0 FROM cust WHERE c_nationkey = 5", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, 0 FROM customer WHERE c_nationkey = 5")
scenario("dml_upsert", "INSERT INTO cust SELECT c_custkey + 5, 'new', c_nationkey, 1 FROM cust ON DUPLICATE KEY UPDATE c_name = VALUES(c_name), c_acctbal = c_acctbal + VALUES(c_acctbal)", "SELECT c.c_custkey, CASE WHEN p.c_custkey IS NULL THEN c.c_name ELSE 'new' END AS c_name, c.c_nationkey, CASE WHEN p.c_custkey IS NULL THEN c.c_acctbal ELSE c.c_acctbal + 1 END AS c_acctbal FROM customer c LEFT JOIN customer p ON p.c_custkey + 5 = c.c_custkey UNION ALL SELECT p.c_custkey + 5, 'new', p.c_nationkey, 1 FROM customer p WHERE p.c_custkey + 5 NOT IN (SELECT c_custkey FROM customer)")
scenario("dml_insert_ignore", "INSERT IGNORE INTO cust SELECT c_custkey + 5, 'new', c_nationkey, 1 FROM cust", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer UNION ALL SELECT p.c_custkey + 5, 'new', p.c_nationkey, 1 FROM customer p WHERE p.c_custkey + 5 NOT IN (SELECT c_custkey FROM customer)")
scenario("dml_replace", "REPLACE INTO cust SELECT c_custkey + 5, 'new', c_nationkey, 1 FROM cust", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey + 5 FROM customer) UNION ALL SELECT p.c_custkey + 5, 'new', p.c_nationkey, 1 FROM customer p")
scenario("txn_savepoint", "BEGIN; DELETE FROM cust WHERE c_nationkey = 1; SAVEPOINT a; DELETE FROM cust; ROLLBACK TO a; COMMIT", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <> 1")
scenario("ddl_alter", "ALTER TABLE cust ADD COLUMN extra INT DEFAULT 3; ALTER TABLE cust RENAME COLUMN c_name TO label; UPDATE cust SET label = CONCAT(label, extra); ALTER TABLE cust RENAME COLUMN label TO c_name", "SELECT c_custkey, c_name || '3' AS c_name, c_nationkey, c_acctbal FROM customer")


@df_query("dml_update_join", "SELECT c_custkey, CASE WHEN n_name IS NULL THEN c_name ELSE n_name END AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 2")
def dml_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.load("nat", load(spark, sf_dir, "nation"), ("n_nationkey",))
    s.sql("UPDATE cust JOIN nat ON cust.c_nationkey = nat.n_nationkey SET c_name = nat.n_name WHERE nat.n_regionkey = 2")
    return s.sql("SELECT c_custkey, c_name FROM cust")


@df_query("dml_delete_join", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def dml_delete_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.load("nat", load(spark, sf_dir, "nation"), ("n_nationkey",))
    s.sql("DELETE cust FROM cust JOIN nat ON cust.c_nationkey = nat.n_nationkey WHERE nat.n_regionkey = 2")
    return s.sql("SELECT c_custkey FROM cust")


@df_query("trigger_audit", "SELECT c_custkey AS id, c_acctbal AS was, c_acctbal * 2 AS now FROM customer WHERE c_nationkey = 4 AND c_acctbal <> 0")
def trigger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.sql("CREATE TABLE audit (id BIGINT, was DOUBLE, now DOUBLE)")
    s.sql("CREATE TRIGGER t AFTER UPDATE ON cust FOR EACH ROW INSERT INTO audit VALUES (NEW.c_custkey, OLD.c_acctbal, NEW.c_acctbal)")
    s.sql("UPDATE cust SET c_acctbal = c_acctbal * 2 WHERE c_nationkey = 4")
    return s.sql("SELECT id, was, now FROM audit")


@df_query("procedure_call", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_nationkey < 5")
def procedure_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.sql("CREATE PROCEDURE below(IN top INT, OUT n BIGINT) BEGIN DECLARE i INT DEFAULT 0; DECLARE x BIGINT; SET n = 0; WHILE i < top DO SELECT COUNT(*) INTO x FROM cust WHERE c_nationkey = i; SET n = n + x; SET i = i + 1; END WHILE; END")
    s.sql("CALL below(5, @n)")
    return s.sql("SELECT CAST(@n AS SIGNED) AS n")


@df_query("sql_function", "SELECT n_nationkey, n_nationkey * 10 AS tenfold FROM nation")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.load("nat", load(spark, sf_dir, "nation"))
    s.sql("CREATE FUNCTION tenfold() RETURNS INT RETURN n_nationkey * 10")
    return s.sql("SELECT n_nationkey, tenfold() AS tenfold FROM nat")


@df_query("prepared_statement", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    return s.sql("PREPARE p FROM 'SELECT c_custkey FROM cust WHERE c_nationkey = ?'; SET @k = 7; EXECUTE p USING @k")


@df_query("info_schema_tables", "SELECT 'cust' AS TABLE_NAME, 'BASE TABLE' AS TABLE_TYPE, CAST(count(*) AS VARCHAR) AS TABLE_ROWS FROM customer")
def info_schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sql("SELECT TABLE_NAME, TABLE_TYPE, TABLE_ROWS FROM information_schema.tables")


@df_query("info_schema_columns", "SELECT * FROM (VALUES ('c_custkey', '1', 'PRI'), ('c_name', '2', ''), ('c_nationkey', '3', ''), ('c_acctbal', '4', '')) AS t(COLUMN_NAME, ORDINAL_POSITION, COLUMN_KEY)")
def info_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sql("SELECT COLUMN_NAME, ORDINAL_POSITION, COLUMN_KEY FROM information_schema.columns WHERE TABLE_NAME = 'cust'")


@df_query("explain_access", "SELECT * FROM (VALUES ('const', 'PRIMARY'), ('ref', 'nk'), ('range', 'nk'), ('ALL', NULL)) AS t(type, key)")
def explain_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    s.sql("CREATE INDEX nk ON cust (c_nationkey)")
    out = None
    for where in ("c_custkey = 1", "c_nationkey = 3", "c_nationkey BETWEEN 1 AND 2", "c_name = 'x'"):
        one = s.sql(f"EXPLAIN SELECT c_name FROM cust WHERE {where}").select("type", "key")
        out = one if out is None else out.union(one)
    return out


@df_query("spatial_functions", "SELECT c_custkey, 'POINT(' || c_custkey || ' ' || (c_custkey % 90) || ')' AS wkt, CAST(c_custkey AS DOUBLE) AS x, 'POINT' AS kind FROM customer")
def spatial_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    return s.sql("SELECT c_custkey, ST_AsText(g) AS wkt, ST_X(g) AS x, ST_GeometryType(g) AS kind FROM (SELECT c_custkey, ST_GeomFromText(CONCAT('POINT(', c_custkey, ' ', c_custkey % 90, ')')) AS g FROM cust) p")


# ---- streams ----


def _changed(spark: SparkSession, sf_dir: str) -> ChangeLog:
    log = ChangeLog(spark, shared_root(spark, "log"))
    s = _customers(spark, sf_dir, log)
    s.sql("UPDATE cust SET c_acctbal = 0 WHERE c_nationkey = 2; DELETE FROM cust WHERE c_nationkey = 3; INSERT INTO cust VALUES (99999999, 'late', 1, 5)")
    return log


@df_query("stream_changelog", "SELECT op, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['UPDATE', 'UPDATE_BEFORE']) AS op FROM customer WHERE c_nationkey = 2 AND c_acctbal <> 0 UNION ALL SELECT 'DELETE' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'INSERT') x GROUP BY op")
def stream_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(changelog.SCHEMA).parquet(_changed(spark, sf_dir).path).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@df_query("stream_follow", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 1) x")
def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, out = _changed(spark, sf_dir), shared_root(spark, "followed")
    q = changelog.follow(spark, log.path, after=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(changelog.SCHEMA).parquet(out).agg(F.count(F.lit(1)).alias("n"))


@df_query("stream_apply", "SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CAST(0 AS DOUBLE) AS c_acctbal FROM customer WHERE c_nationkey = 2 AND c_acctbal <> 0 UNION ALL SELECT 99999999, CAST(5 AS DOUBLE)) x")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, root = _changed(spark, sf_dir), shared_root(spark, "replica")
    replica = Replica(spark, log.path, "cust", "c_custkey long, c_name string, c_nationkey int, c_acctbal double", ["c_custkey"], root)
    replica.catch_up(f"{root}-cp")
    return replica.state().select("c_custkey", "c_acctbal")


@df_query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows over a stream; late rows within the watermark count."""
    out = shared_root(spark, "tumbling")
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")

    # Complete mode ends with all windows, so the last batch is the whole result.
    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    rows = spark.read.parquet(f"{out}/{last}")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
