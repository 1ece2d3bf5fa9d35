"""The engine: instant and range queries over samples, with limits and statistics, and look-ups of series and labels."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidRangeError, MatchError, ParseError, QueryTimeout, SampleLimitError, TidemarkError
from .functions.registry import FUNCTIONS
from .lang import Call, Node, Selector, ValueType, parse, selectors, walk
from .model import MAX_TIME, MIN_TIME, valid_label_name
from .operators.grid import Grid
from .operators.selectors import between, matching
from .plans.compiler import Compiler

MOST_STEPS = 100_000


@dataclass
class Options:
    """lookback and timeout; max_samples bounds the samples that a query's selectors read, None leaves them uncounted."""

    lookback: int = 300_000
    max_samples: int | None = 50_000_000
    timeout: float = 120.0


@dataclass
class Result:
    """type: scalar, string, instant vector or range vector. rows: a DataFrame, ordered only when collected."""

    type: str
    rows: DataFrame | None
    value: str | None = None
    stats: dict = field(default_factory=dict)
    engine: Engine | None = None
    deadline: float = 0.0

    def collect(self) -> list:
        """Instant vectors: rows (labels, ts, v) in the order of labels. Range vectors: rows in the order of labels and time."""
        if self.rows is None:
            return [self.value]
        began = time.time()
        order = ["labels", "ts", *(["t"] if "t" in self.rows.columns else [])]
        with self.engine.limited(self.deadline):
            out = self.rows.orderBy(*order).collect()
        self.stats["elapsed"] = self.stats.get("elapsed", 0.0) + time.time() - began
        return out


class Engine:
    """samples: (metric, labels, t, v), one row for each series and time.

    known gives, for a range of time, rows (metric, labels, ...) of all series with samples in it, and maybe more; look-ups then read
    samples only where a series' bounds leave open whether it has one in the range.
    """

    def __init__(self, samples: DataFrame, options: Options | None = None, known: Callable[[int, int], DataFrame] | None = None):
        self.samples, self.options, self.known = samples, options or Options(), known
        self.spark = samples.sparkSession

    # queries

    def instant(self, query: str | Node, ts: int) -> Result:
        node = parse(query) if isinstance(query, str) else query
        if node.type is ValueType.STRING:
            inner = node
            while not hasattr(inner, "value"):
                inner = inner.children[0]
            return Result(node.type.value, None, inner.value, {"steps": 1})
        return self._run(node, Grid(ts, ts, 1), node.type.value)

    def range(self, query: str | Node, start: int, end: int, step: int) -> Result:
        node = parse(query) if isinstance(query, str) else query
        if step <= 0:
            raise InvalidRangeError(f"a step of {step} leads nowhere")
        if end < start:
            raise InvalidRangeError(f"end {end} is before start {start}")
        steps = (end - start) // step + 1
        if steps > MOST_STEPS:
            raise InvalidRangeError(f"{steps} steps are more than {MOST_STEPS}; take a longer step")
        if node.type in (ValueType.MATRIX, ValueType.STRING):
            raise InvalidRangeError(f"a range query gives a value at each step, and {node.type.phrase} has none")
        return self._run(node, Grid(start, start + (steps - 1) * step, step), ValueType.MATRIX.value)

    def plan(self, query: str | Node, start: int, end: int, step: int) -> DataFrame:
        """The DataFrame of a range query, without any job: no limit is checked."""
        node = parse(query) if isinstance(query, str) else query
        return Compiler(self.samples, Grid(start, start + (end - start) // step * step, step), self.options.lookback).compile(node)

    def _run(self, node: Node, grid: Grid, kind: str) -> Result:
        for n in walk(node):
            if isinstance(n, Call) and not FUNCTIONS[n.name].implemented:
                Compiler(self.samples, grid, self.options.lookback).call(n)
        began = time.time()
        deadline = began + self.options.timeout
        stats = {"steps": grid.last + 1} | self._count(node, grid, deadline)
        rows = Compiler(self.samples, grid, self.options.lookback).compile(node)
        stats["elapsed"] = time.time() - began
        return Result(kind, rows, None, stats, self, deadline)

    def _count(self, node: Node, grid: Grid, deadline: float) -> dict:
        """Samples and series that the selectors read, each selector once; more than the limit is an error."""
        if self.options.max_samples is None:
            return {}
        parts = [self._selected(s, grid).select("labels", F.lit(k).alias("k")) for k, s in enumerate({str(s): s for s in selectors(node)}.values())]
        if not parts:
            return {"samplesScanned": 0, "seriesSelected": 0}
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        with self.limited(deadline):
            row = every.groupBy("labels", "k").count().agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("series")).first()
        n = row["n"] or 0
        if n > self.options.max_samples:
            raise SampleLimitError(f"loaded {n} samples, limit is {self.options.max_samples}")
        return {"samplesScanned": n, "seriesSelected": row["series"]}

    def _selected(self, s: Selector, grid: Grid) -> DataFrame:
        back = self.options.lookback if s.range is None else s.range - 1
        return matching(between(self.samples, grid.start - back - s.offset, grid.end - s.offset), s.matchers)

    @contextmanager
    def limited(self, deadline: float) -> Iterator[None]:
        """Jobs started inside end at the deadline; errors raised in executors come out as this package's."""
        left = deadline - time.time()
        if left <= 0:
            raise QueryTimeout("query timed out")
        sc = self.spark.sparkContext
        group, late = uuid.uuid4().hex, threading.Event()
        sc.setJobGroup(group, "query", True)

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(left, stop)
        timer.daemon = True
        timer.start()
        try:
            yield
        except (PySparkException, Exception) as e:
            if isinstance(e, TidemarkError):
                raise
            if late.is_set():
                raise QueryTimeout("query timed out") from e
            if "many-to-many matching" in str(e):
                raise MatchError("many-to-many matching not allowed: matching labels must be unique on one side") from e
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    # look-ups

    def series(self, match: list[str], start: int = MIN_TIME, end: int = MAX_TIME) -> DataFrame:
        """Rows (labels), each once, of the series with samples from start to end that any of the selectors takes. Offsets are ignored."""
        if not match:
            raise InvalidRangeError("which series? give match[] once or more")
        found = None
        for text in match:
            node = parse(text)
            if not isinstance(node, Selector) or node.range is not None:
                raise ParseError(f"{text!r} in match[] is no selector of series", 0, text)
            parts = [matching(between(self.samples, start, end), node.matchers).select("labels")]
            if self.known is not None:
                series = matching(self.known(start, end), node.matchers)
                inside = (F.col("first") >= start) | (F.col("last") <= end)  # its first or last sample is in the range
                open_ = series.where(~inside).select("labels").distinct()
                parts = [series.where(inside).select("labels"), parts[0].join(open_, "labels", "left_semi")] if (start, end) != (MIN_TIME, MAX_TIME) else [series.select("labels")]
            for part in parts:
                found = part if found is None else found.unionByName(part)
        return found.distinct()

    def label_names(self) -> DataFrame:
        return self._every_series().select(F.explode("labels.name").alias("name")).distinct().orderBy("name")

    def label_values(self, name: str, match: list[str] | None = None) -> DataFrame:
        if not valid_label_name(name):
            raise InvalidRangeError(f"{name!r} is not a valid label name")
        rows = self.series(match) if match else self._every_series()
        return rows.select(F.explode("labels").alias("l")).where(F.col("l.name") == name).select(F.col("l.value").alias("value")).distinct().orderBy("value")

    def _every_series(self) -> DataFrame:
        return self.samples if self.known is None else self.known(MIN_TIME, MAX_TIME)

    @staticmethod
    def functions() -> list[str]:
        return sorted(FUNCTIONS)
