"""Connected components of a distributed graph by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, is_empty


def _pointed(hooks: DataFrame) -> DataFrame:
    """``hooks`` (id, to) with to < id, each led on until it ends at an id that has no hook."""
    while True:
        further = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = checkpointed(hooks.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        hooks = moved.select("id", "to")
        if is_empty(moved.filter("moved")):
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in ``edges`` (a, b): root is the least id of its component.

    Each round hooks every id to its least neighbour if that is less, follows the hooks to their
    end, and contracts the edges; rounds grow with the logarithm of the component size.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = checkpointed(edges.filter("a != b").distinct())
    labels = checkpointed(ids.withColumn("root", F.col("id")))
    while not is_empty(edges):
        hooks = _pointed(checkpointed(edges.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "id")))
        to_a, to_b = hooks.select(F.col("id").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        edges = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        led = hooks.select(F.col("id").alias("root"), F.col("to").alias("next"))
        labels = checkpointed(labels.join(led, "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    return labels
