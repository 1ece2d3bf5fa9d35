"""The timestamps that a query is evaluated at, and exact integer arithmetic on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """start, start + step, ... up to end, in milliseconds; an instant query has one."""

    start: int
    end: int
    step: int

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(0, self.last + 1, 1, 1).select((F.lit(self.start) + F.col("id") * F.lit(self.step)).alias("ts"))

    def time(self, index: Column) -> Column:
        return F.lit(self.start).cast("long") + index * F.lit(self.step).cast("long")


def floor_div(x: Column, by: int) -> Column:
    """Floor of x / by for whole numbers, without going through doubles."""
    by_ = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, by_), by_)


def ceil_div(x: Column, by: int) -> Column:
    return floor_div(x + F.lit(by - 1).cast("long"), by)
