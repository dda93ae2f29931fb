"""The registered queries: each is Spark SQL or a DataFrame function, with DuckDB SQL to compare with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(name: str, text: str, oracle: str | None = "same") -> None:
    """Register Spark SQL over the tables as ``name``; ``oracle`` 'same' means DuckDB reads the same text."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not used:
            return spark.sql(text)
        # Tables are bound to this call, so two calls with different folders do not disturb each other.
        bound = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", text)
        return spark.sql(bound, **{t: load(spark, sf_dir, t) for t in used})

    QUERIES[name] = Query(run, text if oracle == "same" else oracle)


def df_query(name: str, oracle: str | None = None):
    """Register the decorated function of (spark, sf_dir) as ``name``."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(run, oracle)
        return run

    return add
