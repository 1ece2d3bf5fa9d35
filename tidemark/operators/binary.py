"""Binary operators between vectors: one-to-one joins and set operators on matching labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ieee import ARITHMETIC, COMPARE, number
from ..model import METRIC, drop_labels, keep_labels, no_labels


def signature(labels: Column, on: bool | None, names: tuple[str, ...]) -> Column:
    """What two series must have equal: the labels on(...) names, or all but those of ignoring(...) and the metric's name."""
    return keep_labels(labels, names) if on else drop_labels(labels, [*names, METRIC])


def _single(n: Column, side: str) -> Column:
    """A filter that raises where several series of one side have the same matching labels. A filter, as Spark may leave out columns that nothing reads."""
    message = f"many-to-many matching not allowed: several series on the {side} side have the same matching labels"
    return F.when(n > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def one_to_one(op: str, left: DataFrame, right: DataFrame, returns_bool: bool, on: bool | None, names: tuple[str, ...]) -> DataFrame:
    """Rows of left with a partner on the right. Repeated signatures on the right are an error, on the left only with a partner."""
    sig = signature(F.col("labels"), on, names)
    counted = right.select("ts", sig.alias("sig"), F.col("v").alias("r")).groupBy("ts", "sig").agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    partners = counted.where(_single(F.col("n"), "right")).drop("n")
    # without rows; Spark may skip the join's right side where the left is empty, but not this
    check = counted.where((F.col("n") > 1) & _single(F.col("n"), "right")).select("ts", no_labels().alias("labels"), F.col("r").alias("v"))
    pairs = left.select("ts", "labels", "v", sig.alias("sig")).join(partners, ["ts", "sig"])
    pairs = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ts", "sig"))).where(_single(F.col("n"), "left"))
    a, b = F.col("v"), F.col("r")
    out = F.col("sig") if on or names else drop_labels(F.col("labels"), [METRIC])
    if op in ARITHMETIC:
        rows = pairs.select("ts", out.alias("labels"), ARITHMETIC[op](a, b).alias("v"))
    elif returns_bool:
        rows = pairs.select("ts", out.alias("labels"), F.when(COMPARE[op](a, b), number(1)).otherwise(number(0)).alias("v"))
    else:
        rows = pairs.where(COMPARE[op](a, b)).select("ts", out.alias("labels"), "v")
    return rows.unionByName(check)


def set_operator(op: str, left: DataFrame, right: DataFrame, on: bool | None, names: tuple[str, ...]) -> DataFrame:
    sig = signature(F.col("labels"), on, names)
    a, b = left.withColumn("sig", sig), right.withColumn("sig", sig)
    keys = lambda x: x.select("ts", "sig").distinct()
    if op == "or":
        return left.select("ts", "labels", "v").unionByName(b.join(keys(a), ["ts", "sig"], "left_anti").select("ts", "labels", "v"))
    return a.join(keys(b), ["ts", "sig"], "left_semi" if op == "and" else "left_anti").select("ts", "labels", "v")
