"""Series from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import METRIC, make_labels


def _samples(rows: DataFrame, metric: str, labels: dict[str, Column], t: Column, v: Column) -> DataFrame:
    return rows.select(F.lit(metric).alias("metric"), make_labels({METRIC: F.lit(metric)} | labels).alias("labels"), t.cast("long").alias("t"), v.cast("double").alias("v"))


def millis(rows: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a time column, with or without zone, whatever the session's zone is; fractions go down."""
    if rows.schema[name].dataType.typeName() == "timestamp_ntz":
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    else:
        micros = F.unix_micros(F.col(name))
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000).cast("long")), F.lit(1000).cast("long"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", "user_id", "event_type", "value", millis(rows, "ts").alias("t"))


def events_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_value{event_type, user_id}: the value of each event; the later of two events of a series in one millisecond counts."""
    e = events(spark, sf_dir).groupBy("event_type", "user_id", "t").agg(F.max_by("value", "event_id").alias("value"))
    return _samples(e, "events_value", {"event_type": F.col("event_type"), "user_id": F.col("user_id")}, F.col("t"), F.col("value"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_value{event_type}: the same without users."""
    e = events(spark, sf_dir).groupBy("event_type", "t").agg(F.max_by("value", "event_id").alias("value"))
    return _samples(e, "events_value", {"event_type": F.col("event_type")}, F.col("t"), F.col("value"))


def _counter(rows: DataFrame, metric: str, resets: list[str]) -> DataFrame:
    """Events so far of each type, from 0 again in each group of resets.

    Counted by day first, so that no task ranks more than a day of a type: rank in the day, plus the days before.
    """
    day = F.col("t") - F.pmod("t", F.lit(86_400_000))
    ranked = rows.withColumn("day", day).withColumn("rank_", F.row_number().over(Window.partitionBy("event_type", "day").orderBy("t", "event_id")))
    if not resets:
        days = ranked.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
        days = days.withColumn("before_", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")) - F.col("n")).drop("n")
        ranked = ranked.join(days, ["event_type", "day"]).withColumn("rank_", F.col("rank_") + F.col("before_"))
    return _samples(ranked.groupBy("event_type", "t").agg(F.max("rank_").alias("rank_")), metric, {"event_type": F.col("event_type")}, F.col("t"), F.col("rank_"))


def events_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_total{event_type}: a counter of events."""
    return _counter(events(spark, sf_dir), "events_total", [])


def events_daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events_daily_total{event_type}: a counter that starts again every day."""
    return _counter(events(spark, sf_dir), "events_daily_total", ["day"])


def _daily(rows: DataFrame, metric: str, time: str, labels: dict[str, str], value: Column) -> DataFrame:
    t = millis(rows, time)
    t = t - F.pmod(t, F.lit(86_400_000).cast("long"))
    each = rows.groupBy(t.alias("t"), *[F.col(c).alias(n) for n, c in labels.items()]).agg(value.alias("v"))
    return _samples(each, metric, {n: F.col(n) for n in labels}, F.col("t"), F.col("v"))


def orders_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_total{priority}: the sum of prices of each day."""
    return _daily(spark.read.parquet(f"{sf_dir}/orders.parquet"), "orders_total", "o_orderdate", {"priority": "o_orderpriority"}, F.sum("o_totalprice"))


def lineitem_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem_qty{returnflag, linestatus}: the sum of quantities shipped each day."""
    return _daily(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "lineitem_qty", "l_shipdate", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, F.sum("l_quantity"))


SERIES = {
    "events_value": events_value,
    "events_type_value": events_by_type,
    "events_total": events_total,
    "events_daily_total": events_daily_total,
    "orders_total": orders_total,
    "lineitem_qty": lineitem_quantity,
}
