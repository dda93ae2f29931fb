"""Recursive queries that Spark's own recursion does not cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.errors import EngineError
from millrace.storage import shared_base

MAX_ROUNDS = 1000


def shared(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def fixpoint_distinct(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """All rows of ``WITH RECURSIVE … UNION``: only rows not seen before go into the next round.

    Rows are compared null-safely as a set; more than ``max_rounds`` rounds are error 3636.
    """
    new = shared(start.distinct())
    seen = new
    for _ in range(max_rounds + 1):
        if not new.take(1):
            return seen
        new = shared(step(new).toDF(*start.columns).distinct().subtract(seen))
        seen = shared(seen.union(new))
    raise EngineError(3636, f"Recursive query aborted after {max_rounds + 1} iterations")
