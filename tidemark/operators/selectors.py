"""Selectors: which samples a query reads, and which steps of the grid each serves.

A sample is never joined with the grid. It is turned into the run of step numbers that it serves, and that run is exploded.
Before, samples are reduced to what a step can tell apart: the newest sample between two steps (instant selectors), or a
summary of each pane (windows; a pane is the greatest common divisor of range and step wide). So no task holds more rows of a
series than the grid has steps or panes, however many samples one series has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import METRIC, Matcher, get_label
from .grid import Grid, ceil_div, floor_div


def matching(samples: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """Rows whose series pass all matchers; without matchers none. Tests of the metric's name are on the plain column, and reach the scan."""
    tests = [m.column(F.coalesce(F.col("metric"), F.lit("")) if m.name == METRIC and m.op not in ("=",) else F.col("metric") if m.name == METRIC and m.value else get_label(F.col("labels"), m.name)) for m in matchers]
    if not tests:
        return samples.where(F.lit(False))
    for test in tests:
        samples = samples.where(test)
    return samples


def between(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Samples from first to last, both included; also on the partition column of stored samples."""
    if "block_start" in samples.columns:
        samples = samples.where(F.col("block_start") <= last)
    return samples.where((F.col("t") >= first) & (F.col("t") <= last))


def instant(samples: DataFrame, matchers: Iterable[Matcher], grid: Grid, lookback: int, offset: int) -> DataFrame:
    """Rows (ts, labels, v): at each step the newest sample of each series that is lookback old at most, both ends included."""
    rows = matching(between(samples, grid.start - lookback - offset, grid.end - offset), matchers)
    first = F.greatest(F.lit(0).cast("long"), ceil_div(F.col("t") + F.lit(offset - grid.start).cast("long"), grid.step))
    newest = rows.select("labels", "t", "v", first.alias("k")).groupBy("labels", "k").agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))
    after = F.lead("k").over(Window.partitionBy("labels").orderBy("k"))
    until = floor_div(F.col("t") + F.lit(lookback + offset - grid.start).cast("long"), grid.step)
    until = F.least(until, F.coalesce(after - 1, F.lit(grid.last).cast("long")))
    served = newest.select("labels", "v", "k", until.alias("last")).where("k <= last")
    return served.select("labels", "v", F.explode(F.sequence("k", "last")).alias("k")).select(grid.time(F.col("k")).alias("ts"), "labels", "v")


def pane_width(grid: Grid, width: int, least: int = 1) -> int:
    """A common divisor of step and range, the greatest that gives a window `least` panes or more where there is one."""
    common = math.gcd(grid.step, width) if grid.last else width
    parts = next((n for n in range(1, min(common, 4 * least) + 1) if common % n == 0 and width * n >= least * common), 1)
    return common // parts


def panes(samples: DataFrame, matchers: Iterable[Matcher], grid: Grid, width: int, offset: int, least: int = 1) -> DataFrame:
    """Samples (labels, t, v, p) of a range selector with the pane p of each: (origin + (p-1)*w, origin + p*w], origin the first step less the offset."""
    rows = matching(between(samples, grid.start - offset - width + 1, grid.end - offset), matchers)
    p = ceil_div(F.col("t") - F.lit(grid.start - offset).cast("long"), pane_width(grid, width, least))
    return rows.select("labels", "t", "v", p.alias("p"))


def runs(samples: DataFrame, matchers: Iterable[Matcher], grid: Grid, width: int, offset: int) -> DataFrame:
    """Samples (labels, t, v, first, last) of a range selector with the first and last step whose windows hold each; those of no window are left out."""
    rows = matching(between(samples, grid.start - offset - width + 1, grid.end - offset), matchers)
    since = F.col("t") + F.lit(offset - grid.start).cast("long")
    first = F.greatest(F.lit(0).cast("long"), ceil_div(since, grid.step))
    last = F.least(F.lit(grid.last).cast("long"), ceil_div(since + F.lit(width).cast("long"), grid.step) - 1)
    return rows.select("labels", "t", "v", first.alias("first"), last.alias("last")).where("first <= last")


def windows_of(grid: Grid, width: int, least: int = 1) -> Column:
    """The steps whose window holds pane p, exploded: window k has the panes from k*step - width (open) to k*step."""
    w = pane_width(grid, width, least)
    first = F.greatest(F.lit(0).cast("long"), ceil_div(F.col("p") * F.lit(w).cast("long"), grid.step))
    last = F.least(F.lit(grid.last).cast("long"), floor_div((F.col("p") - 1) * F.lit(w).cast("long") + F.lit(width).cast("long"), grid.step))
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
