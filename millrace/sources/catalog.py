"""Tables, indexes and views over immutable data directories.

A table's rows lie in segments, Parquet directories that are never changed. An insert adds a segment,
an update or delete writes a new one in place of all; so what a reader holds stays valid, a
transaction is a copy of this catalog, and a rollback forgets one.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions.collation import collated
from millrace.sources.partitions import RangePartitions


@dataclass
class Column:
    name: str
    type: str  # as declared
    spark_type: str
    nullable: bool = True
    default: str | None = None  # Spark SQL
    auto_increment: bool = False
    generated: str | None = None  # Spark SQL of a virtual column
    invisible: bool = False
    members: tuple[str, ...] = ()  # of ENUM or SET
    is_set: bool = False
    collation: str = ""  # as declared, or the default's for ''

    @property
    def folds(self) -> bool:
        """Whether values are compared without case and accents, as texts are by default."""
        return self.spark_type.upper() == "STRING" and not self.type.upper().startswith("JSON") and not self.collation.lower().endswith("_bin")

    def key(self, value: SparkColumn) -> SparkColumn:
        """``value`` of this column as it is compared."""
        return collated(value) if self.folds else value


@dataclass
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    fulltext: bool = False
    invisible: bool = False


@dataclass
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary_key: tuple[str, ...] = ()
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)  # name, Spark SQL
    partitions: RangePartitions | None = None
    auto_next: int = 1
    segments: list[str] = field(default_factory=list)
    rows: int = 0

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise EngineError(1054, f"Unknown column '{name}' in 'field list'")

    @property
    def stored(self) -> list[Column]:
        return [c for c in self.columns if c.generated is None]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {c.spark_type}" for c in self.stored)

    def unique_keys(self) -> list[tuple[str, tuple[str, ...]]]:
        keys = [("PRIMARY", self.primary_key)] if self.primary_key else []
        return keys + [(i.name, i.columns) for i in self.indexes if i.unique]


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.databases: dict[str, dict[str, Table]] = {"default": {}}
        self.views: dict[str, dict[str, str]] = {"default": {}}
        self.programs: dict[str, dict] = {"PROCEDURE": {}, "FUNCTION": {}, "TRIGGER": {}, "EVENT": {}}

    def snapshot(self) -> tuple:
        return copy.deepcopy((self.databases, self.views, self.programs))

    def restore(self, state: tuple) -> None:
        self.databases, self.views, self.programs = copy.deepcopy(state)

    def table(self, db: str, name: str) -> Table:
        if db not in self.databases:
            raise EngineError(1049, f"Unknown database '{db}'")
        found = self.databases[db].get(name.lower())
        if not found:
            raise EngineError(1146, f"Table '{db}.{name}' doesn't exist")
        return found

    # ---- data ----

    def read(self, t: Table) -> DataFrame:
        """Stored columns of ``t``."""
        if not t.segments:
            return self.spark.createDataFrame([], t.schema)
        schema = t.schema + (", _partition INT" if t.partitions else "")
        parts = [self.spark.read.schema(schema).parquet(s) for s in t.segments]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def visible(self, t: Table, named: set[str]) -> DataFrame:
        """``t`` as queries see it: virtual columns computed, invisible ones only where ``named``, texts with their collation.

        A filter on the column of a partitioned table reaches the partitions: its number follows from the column, and for
        one value the optimizer computes it.
        """
        df = self.read(t)
        if t.partitions:
            df = df.filter(F.col("_partition") == t.partitions.number_of(F.col(t.partitions.column)))
        for c in t.columns:
            if c.generated is not None:
                df = df.withColumn(c.name, F.expr(c.generated).cast(c.spark_type))
        keep = [c.name for c in t.columns if not c.invisible or c.name.lower() in named]
        return df.select(*[t.column(c).key(F.col(f"`{c}`")).alias(c) for c in keep])

    def write(self, t: Table, df: DataFrame) -> str:
        """A new segment with the stored columns of ``df``; it is not yet part of the table."""
        path = f"{self.root}/{t.name}/{uuid.uuid4().hex}"
        df = df.select(*[F.col(f"`{c.name}`").cast(c.spark_type).alias(c.name) for c in t.stored])
        if t.partitions:
            t.partitions.tag(df).write.partitionBy("_partition").parquet(path)
        else:
            df.write.parquet(path)
        return path

    def append(self, t: Table, df: DataFrame, n: int) -> None:
        t.segments = [*t.segments, self.write(t, df)]
        t.rows += n

    def replace(self, t: Table, df: DataFrame) -> None:
        path = self.write(t, df)
        t.segments = [path]
        t.rows = self.spark.read.parquet(path).count()
