"""Aggregation of instant vectors over groups of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ieee import COMPARE, INF, NAN, largest, number, smallest
from ..model import METRIC, drop_labels, keep_labels


def group_labels(labels: Column, names: tuple[str, ...], without: bool) -> Column:
    return drop_labels(labels, [*names, METRIC]) if without else keep_labels(labels, names)


_SIMPLE = {
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: F.coalesce(smallest(v), number(NAN)),
    "max": lambda v: F.coalesce(largest(v), number(NAN)),
    "count": lambda v: F.count(F.lit(1)).cast("double"),
    "group": lambda v: F.max(F.lit(1.0)),
    "stddev": lambda v: F.stddev_pop(v),
    "stdvar": lambda v: F.var_pop(v),
}


def aggregate(op: str, vector: DataFrame, names: tuple[str, ...], without: bool) -> DataFrame:
    keyed = vector.select("ts", group_labels(F.col("labels"), names, without).alias("labels"), "v")
    return keyed.groupBy("ts", "labels").agg(_SIMPLE[op](F.col("v")).alias("v"))


def ranked(op: str, vector: DataFrame, k: Column, names: tuple[str, ...], without: bool) -> DataFrame:
    """topk and bottomk: the k first of each group, with their own labels. Ties by labels; NaN comes last.

    vector may have more columns that k reads. A constant k lets Spark cut each task's rows to k before the shuffle.
    """
    order = F.col("v").desc() if op == "topk" else F.col("v").asc()
    group = Window.partitionBy("ts", "group_").orderBy(F.isnan("v").asc(), order, F.col("labels").asc())
    rows = vector.withColumn("group_", group_labels(F.col("labels"), names, without)).withColumn("rank_", F.row_number().over(group))
    return rows.where(F.col("rank_") <= k).select("ts", "labels", "v")


def quantile(vector: DataFrame, phi: Column, names: tuple[str, ...], without: bool) -> DataFrame:
    """Interpolated between the two nearest ranks; NaN values come first. Ranks are by a window, so a group's values are never held at once."""
    keyed = vector.withColumn("labels", group_labels(F.col("labels"), names, without)).withColumn("phi_", phi)
    key = ["ts", "labels"]
    order = Window.partitionBy(*key).orderBy(F.isnan("v").desc(), F.col("v").asc())
    counts = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = keyed.withColumn("at_", F.row_number().over(order) - 1).withColumn("n_", counts)
    fits = F.coalesce(COMPARE[">="](F.col("phi_"), number(0)) & COMPARE["<="](F.col("phi_"), number(1)), F.lit(False))
    rank = F.when(fits, F.col("phi_") * (F.col("n_") - 1)).otherwise(0.0)
    rows = rows.withColumn("rank_", rank)
    low, high = F.floor("rank_"), F.ceil("rank_")
    found = rows.groupBy(*key).agg(
        F.max(F.when(F.col("at_") == low, F.col("v"))).alias("low"), F.max(F.when(F.col("at_") == high, F.col("v"))).alias("high"), F.max("rank_").alias("rank_"), F.max("phi_").alias("phi_")
    )
    weight = F.col("rank_") - F.floor("rank_")
    inside = F.when(weight == 0, F.col("low")).otherwise(F.col("low") * (1 - weight) + F.col("high") * weight)
    v = F.when(F.isnan("phi_"), number(NAN)).when(F.col("phi_") < 0, number(-INF)).when(F.col("phi_") > 1, number(INF)).otherwise(inside)
    return found.select(*key, v.alias("v"))
