"""Functions over range vectors, by mergeable summaries of panes.

A pane's summary is formed with partial aggregation; the summaries of a window's panes are merged, so a sample is read once
however many windows hold it. Functions that compare neighbouring samples do so inside a pane first, and once more where two
panes of a series meet; what the window's first sample has from before the window is taken away again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ieee import COMPARE, INF, largest, number, smallest
from ..model import Matcher
from .grid import Grid
from .selectors import panes, runs, windows_of

NEIGHBOURS = frozenset({"rate", "increase", "irate", "idelta", "resets", "changes"})
SPREAD = frozenset({"stddev_over_time", "stdvar_over_time"})
#: Panes of a window at least, for functions that sort the samples of a pane: an instant query would have one pane otherwise.
NARROW = 16


def window_function(name: str, samples: DataFrame, matchers: Iterable[Matcher], grid: Grid, width: int, offset: int) -> DataFrame:
    """Rows (ts, labels, v) of one function over the windows of width ms, open at their start."""
    if name in SPREAD:
        return _spread(name, runs(samples, matchers, grid, width, offset), grid, width)
    least = NARROW if name in NEIGHBOURS else 1
    rows = panes(samples, matchers, grid, width, offset, least)
    step = windows_of(grid, width, least)
    summaries = _with_neighbours(rows) if name in NEIGHBOURS else _plain(rows)
    window = summaries.select("labels", "p", *[c for c in summaries.columns if c not in ("labels", "p")], step.alias("k"))
    ts = grid.time(F.col("k"))
    if name in ("rate", "increase", "delta"):
        ends = [F.min("t0").alias("t0"), F.min_by("v0", "p").alias("v0"), F.max("t1").alias("t1"), F.max_by("v1", "p").alias("v1"), F.sum("n").alias("n")]
        extra = [] if name == "delta" else [(F.sum("inside") + F.sum("joint") - F.min_by("joint", "p")).alias("added")]
        merged = window.groupBy("labels", "k").agg(*ends, *extra).where("n >= 2")
        change = F.col("v1") - F.col("v0") + (F.lit(0.0) if name == "delta" else F.col("added"))
        v = extrapolated(change, ts, F.col("t0"), F.col("t1"), F.col("n"), width, offset)
        if name == "rate":
            v = v / F.lit(width / 1000)
        return merged.select(ts.alias("ts"), "labels", v.alias("v"))
    if name in ("irate", "idelta"):
        last = [F.max("t1").alias("t1"), *[F.max_by(c, "p").alias(c) for c in ("v1", "bt", "bv")], F.sum("n").alias("n")]
        merged = window.groupBy("labels", "k").agg(*last).where("n >= 2")
        change = F.col("v1") - F.col("bv")
        if name == "idelta":
            return merged.select(ts.alias("ts"), "labels", change.alias("v"))
        gone = F.when(COMPARE["<"](change, number(0)), F.col("v1")).otherwise(change)
        return merged.select(ts.alias("ts"), "labels", (gone / ((F.col("t1") - F.col("bt")) / 1000.0)).alias("v"))
    return window.groupBy("labels", "k").agg(_MERGED[name]().cast("double").alias("v")).select(ts.alias("ts"), "labels", "v")


def _spread(name: str, rows: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Samples that the same windows hold are one summary. The summaries of a series stand in order, and each is met by those before it
    that a window can hold beside it; so no row is kept for a pair of summary and window, and a window's summaries are merged where they stand."""
    each = rows.groupBy("labels", "first", "last").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    order = Window.partitionBy("labels").orderBy("first")
    beside = order.rangeBetween(-min(grid.last, (width - 1) // grid.step), 0)
    # the steps up to the next summary's first; of summaries with the same first, the one that stands last has them
    until = F.least(F.coalesce(F.lead("first").over(order) - 1, F.lit(grid.last).cast("long")), F.max("last").over(beside))
    held = F.collect_list(F.struct("last", "n", "mean", "var")).over(beside)
    met = each.select("labels", "first", until.alias("until"), held.alias("held")).where("first <= until")
    var = lambda k: _merged_variance(F.filter("held", lambda x: (x["last"] >= k) & (x["n"] > 0)))
    steps = F.transform(F.sequence("first", "until"), lambda k: F.struct(k.alias("k"), var(k).alias("var")))
    window = met.select("labels", F.explode(steps).alias("at")).select("labels", "at.k", "at.var")
    v = F.sqrt("var") if name == "stddev_over_time" else F.col("var")
    return window.select(grid.time(F.col("k")).alias("ts"), "labels", v.alias("v"))


def _merged_variance(summaries: Column) -> Column:
    """The variance of all samples of an array of summaries (n, mean, var), merged one by one; null if there are none. None is empty."""
    zero = F.struct(*[number(0).alias(c) for c in ("n", "mean", "m2")])

    def merge(a: Column, x: Column) -> Column:
        n, alone = a["n"] + x["n"], a["n"] == 0
        apart = F.when(alone, 0.0).otherwise(x["mean"] - a["mean"])
        mean = F.when(alone, x["mean"]).otherwise(a["mean"] + apart * (x["n"] / n))
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + x["n"] * x["var"] + apart * apart * (a["n"] * (x["n"] / n))).alias("m2"))

    return F.aggregate(summaries, zero, merge, lambda a: F.when(a["n"] > 0, a["m2"] / a["n"]))


def extrapolated(change: Column, ts: Column, first: Column, last: Column, n: Column, width: int, offset: int) -> Column:
    """The change between first and last sample carried to the window's ends, or half a mean gap where an end is 1.1 mean gaps away or more."""
    span = (last - first).cast("double")
    gap = span / (n - 1)
    to_start = (first - (ts - offset - width)).cast("double")
    to_end = ((ts - offset) - last).cast("double")
    near = lambda d: F.when(d < gap * 1.1, d).otherwise(gap / 2)
    return change * ((span + near(to_start) + near(to_end)) / span)


def _ends() -> list[Column]:
    """Number of samples, first and last sample of a pane. Plain numbers, which Spark aggregates by hashing, without a sort."""
    return [F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.min_by("v", "t").alias("v0"), F.max("t").alias("t1"), F.max_by("v", "t").alias("v1")]


def _plain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("labels", "p").agg(*_ends(), F.sum("v").alias("sum"), smallest(F.col("v")).alias("least"), largest(F.col("v")).alias("most"))


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """Summaries with the sample before the last one (bt, bv), and of falls and changes: `*_in` and `inside` from pairs in the
    pane, `*_at` and `joint` from the pair with the pane before."""
    order = Window.partitionBy("labels", "p").orderBy("t")
    pairs = rows.withColumn("wt", F.lag("t").over(order)).withColumn("wv", F.lag("v").over(order))
    joined = F.col("wt").isNotNull()
    fell, moved = _pair(F.col("wv"), F.col("v"))
    each = pairs.groupBy("labels", "p").agg(
        *_ends(),
        F.max("wt").alias("bt_in"),
        F.max_by("wv", "t").alias("bv_in"),
        F.sum(F.when(joined & fell, F.col("wv")).otherwise(0.0)).alias("inside"),
        F.sum((joined & fell).cast("long")).alias("falls_in"),
        F.sum((joined & moved).cast("long")).alias("moves_in"),
    )
    series = Window.partitionBy("labels").orderBy("p")
    met = each.withColumn("pt", F.lag("t1").over(series)).withColumn("pv", F.lag("v1").over(series))
    fell, moved = _pair(F.col("pv"), F.col("v0"))
    known = F.col("pt").isNotNull()
    return met.select(
        *["labels", "p", "n", "t0", "v0", "t1", "v1", "inside", "falls_in", "moves_in"],
        F.coalesce("bt_in", "pt").alias("bt"),
        F.when(F.col("bt_in").isNotNull(), F.col("bv_in")).otherwise(F.col("pv")).alias("bv"),
        F.when(known & fell, F.col("pv")).otherwise(0.0).alias("joint"),
        (known & fell).cast("long").alias("falls_at"),
        (known & moved).cast("long").alias("moves_at"),
    )


def _pair(was: Column, now: Column) -> tuple[Column, Column]:
    """Whether a value fell, and whether it changed; NaN after NaN is no change."""
    return F.coalesce(COMPARE["<"](now, was), F.lit(False)), F.coalesce(~((now == was) | (F.isnan(now) & F.isnan(was))), F.lit(False))


_MERGED = {
    "avg_over_time": lambda: F.sum("sum") / F.sum("n"),
    "sum_over_time": lambda: F.sum("sum"),
    "count_over_time": lambda: F.sum("n"),
    "min_over_time": lambda: F.coalesce(F.min("least"), number(INF)),
    "max_over_time": lambda: F.coalesce(F.max("most"), number(-INF)),
    "first_over_time": lambda: F.min_by("v0", "p"),
    "last_over_time": lambda: F.max_by("v1", "p"),
    "resets": lambda: F.sum("falls_in") + F.sum("falls_at") - F.min_by("falls_at", "p"),
    "changes": lambda: F.sum("moves_in") + F.sum("moves_at") - F.min_by("moves_at", "p"),
}
