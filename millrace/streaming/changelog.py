"""The change stream: committed row changes as Parquet, followed and applied by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "gtid long, seq long, op string, table string, before string, after string, ts timestamp_ntz"


class ChangeLog:
    """Appends each transaction under the next number of its source; images are JSON of the row."""

    def __init__(self, spark: SparkSession, path: str, image: str = "FULL", keys: dict[str, tuple[str, ...]] | None = None):
        if image not in ("FULL", "MINIMAL", "NOBLOB"):
            raise ValueError("image must be FULL, MINIMAL or NOBLOB")
        self.spark, self.path, self.image, self.keys = spark, path.rstrip("/"), image, keys or {}
        self.source = str(uuid.uuid4())
        self.last = 0

    def _image(self, df: DataFrame, table: str, before: bool):
        names = df.columns
        if self.image == "MINIMAL" and before and table in self.keys:
            names = [c for c in names if c in self.keys[table]]
        elif self.image == "NOBLOB":
            names = [c for c, kind in df.dtypes if kind != "binary" or c in self.keys.get(table, ())]
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    def append(self, changes: list[tuple[str, str, DataFrame | None, DataFrame | None]]) -> int:
        """Write one transaction of (op, table, before, after); returns its number, or 0 if it changed nothing."""
        out = None
        for n, (op, table, before, after) in enumerate(changes):
            rows = before if after is None else after
            old, new = F.lit(None).cast("string"), F.lit(None).cast("string")
            if op == "DELETE":
                old = self._image(before, table, True)
            else:
                new = self._image(after, table, False)
            part = rows.select(F.lit(n).alias("n"), F.lit(op).alias("op"), F.lit(table).alias("table"), old.alias("before"), new.alias("after"))
            if op == "UPDATE":
                # Before images are events of their own kind, so that rows need not be paired again.
                part = before.select(F.lit(n).alias("n"), F.lit("UPDATE_BEFORE").alias("op"), F.lit(table).alias("table"), self._image(before, table, True).alias("before"), new_null().alias("after")).unionByName(part)
            out = part if out is None else out.unionByName(part)
        if out is None or not out.take(1):
            return 0
        self.last += 1
        out.select(F.lit(self.last).cast("long").alias("gtid"), F.monotonically_increasing_id().alias("seq"), "op", "table", "before", "after", F.expr("CAST(now() AS TIMESTAMP_NTZ)").alias("ts")).write.mode("append").parquet(self.path)
        return self.last

    def executed(self) -> str:
        return gtid_set(self.source, range(1, self.last + 1))


def new_null():
    return F.lit(None).cast("string")


def gtid_set(source: str, numbers) -> str:
    """``source`` with its numbers as ranges, such as uuid:1-3:5."""
    spans: list[list[int]] = []
    for n in sorted(set(numbers)):
        if spans and n == spans[-1][1] + 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return source + "".join(f":{a}" if a == b else f":{a}-{b}" for a, b in spans)


def follow(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """A stream of the changes whose transaction number is above ``after``."""
    return spark.readStream.schema(SCHEMA).parquet(path).filter(F.col("gtid") > after)


def latest(changes: DataFrame, schema: str, key: list[str]) -> DataFrame:
    """The last state of each key in ``changes``: columns of ``schema`` and __op; repeated events change nothing."""
    rows = changes.filter("op != 'UPDATE_BEFORE'").dropDuplicates(["gtid", "seq"]).withColumn("__row", F.from_json(F.coalesce("after", "before"), schema))
    rows = rows.select("gtid", "seq", F.col("op").alias("__op"), "__row.*")
    # A delete before an insert of the same transaction must not win: inserts rank later.
    order = Window.partitionBy(*key).orderBy(F.desc("gtid"), F.desc("seq"))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "gtid", "seq")


def applied(state: DataFrame, changes: DataFrame, schema: str, key: list[str]) -> DataFrame:
    """``state`` after ``changes``: keys that occur in them are replaced or deleted."""
    last = latest(changes, schema, key)
    stay = state.join(last.select(*key), key, "left_anti").select(*state.columns)
    return stay.unionByName(last.filter("__op != 'DELETE'").select(*state.columns))


class Replica:
    """Applies a change stream to a table of its own, each transaction once."""

    def __init__(self, spark: SparkSession, path: str, table: str, schema: str, key: list[str], root: str):
        self.spark, self.path, self.table, self.schema, self.key, self.root = spark, path, table, schema, key, root.rstrip("/")
        self.current: str | None = None
        self.seen = 0
        self._resume()

    def _resume(self) -> None:
        """Take up the newest state that was written whole; its folder's name begins with its last transaction."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [p for p in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        if whole:
            newest = max(whole, key=lambda p: p.getName())
            self.current, self.seen = newest.toString(), int(newest.getName().split("-")[0])

    def state(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.current) if self.current else self.spark.createDataFrame([], self.schema)

    def _apply(self, batch: DataFrame, _: int) -> None:
        new = batch.filter((F.col("gtid") > self.seen) & (F.col("table") == self.table)).persist()
        top = new.agg(F.max("gtid")).first()[0]
        if top is not None:
            path = f"{self.root}/{top:020d}-{uuid.uuid4().hex}"
            applied(self.state(), new, self.schema, self.key).write.parquet(path)
            self.current, self.seen = path, top
        new.unpersist()

    def catch_up(self, checkpoint: str) -> None:
        """Apply all changes that are there now."""
        q = follow(self.spark, self.path).writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
