"""RANGE partitioning on an integer column: the first partition whose bound is above the value."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import EngineError


class RangePartitions:
    def __init__(self, column: str, bounds: tuple[int, ...], max_value: bool = True):
        self.column, self.bounds, self.max_value = column, tuple(bounds), max_value

    def number(self, value: int) -> int:
        """Partition of ``value``; error 1526 where none takes it."""
        n = bisect.bisect_right(self.bounds, value)
        if n == len(self.bounds) and not self.max_value:
            raise EngineError(1526, f"Table has no partition for value {value}")
        return n

    def tag(self, df: DataFrame, name: str = "_partition") -> DataFrame:
        """``df`` with its partition number, to write with partitionBy so that files can be skipped."""
        return df.withColumn(name, self.number_of(F.col(self.column)))

    def number_of(self, value: Column) -> Column:
        """Partition of ``value`` as an expression; null goes into the first."""
        number = F.lit(len(self.bounds))
        for i in range(len(self.bounds) - 1, -1, -1):
            number = F.when(value < self.bounds[i], i).otherwise(number)
        return F.when(value.isNull(), 0).otherwise(number)

    def prune_equal(self, tagged: DataFrame, value: int, name: str = "_partition") -> DataFrame:
        """Rows with the column equal to ``value``, read from one partition."""
        return tagged.filter((F.col(name) == self.number(value)) & (F.col(self.column) == value)).drop(name)
