"""Compiler: from a typed tree to one DataFrame (ts, labels, v), or (ts, v) for scalars, over a grid of timestamps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRangeError, UnimplementedError
from ..functions import ieee
from ..functions.registry import FUNCTIONS
from ..lang import Aggregate, Binary, Call, Node, Number, Paren, Selector, String, Unary, ValueType
from ..model import METRIC, drop_labels, no_labels
from ..operators import aggregates, binary, selectors, windows
from ..operators.grid import Grid


@dataclass
class Scalar:
    """A scalar at each step: a column over ts, or a frame (ts, v) where it comes from a vector."""

    column: Column | None = None
    frame: DataFrame | None = None


class Compiler:
    def __init__(self, samples: DataFrame, grid: Grid, lookback: int):
        self.samples, self.grid, self.lookback = samples, grid, lookback
        self.spark = samples.sparkSession
        self._seen: dict[str, DataFrame] = {}

    def compile(self, node: Node) -> DataFrame:
        """Rows (ts, labels, v) of an expression; a scalar has no labels. Range vectors: (ts, labels, t, v)."""
        if node.type is ValueType.STRING:
            raise InvalidRangeError("a string has no rows")
        if node.type is ValueType.MATRIX:
            return self.matrix(node)
        if node.type is ValueType.SCALAR:
            return self.steps(self.scalar(node)).select("ts", no_labels().alias("labels"), "v")
        return self.vector(node)

    def steps(self, value: Scalar) -> DataFrame:
        if value.frame is not None:
            return value.frame
        return self.grid.frame(self.spark).select("ts", value.column.cast("double").alias("v"))

    def bare(self, node: Node) -> Node:
        while isinstance(node, Paren):
            node = node.inner
        return node

    # scalars

    def scalar(self, node: Node) -> Scalar:
        node = self.bare(node)
        if isinstance(node, Number):
            return Scalar(ieee.number(node.value))
        if isinstance(node, Unary):
            inner = self.scalar(node.inner)
            if inner.frame is None:
                return Scalar(-inner.column)
            return Scalar(frame=inner.frame.select("ts", (-F.col("v")).alias("v")))
        if isinstance(node, Call) and node.name == "time":
            return Scalar(F.col("ts") / F.lit(1000.0))
        if isinstance(node, Call) and node.name == "scalar":
            return Scalar(frame=self.single(self.vector(node.arguments[0])))
        if isinstance(node, Binary):
            return self.scalar_binary(node)
        raise UnimplementedError(f"{node} can't be evaluated as a scalar")

    def single(self, vector: DataFrame) -> DataFrame:
        """The value at steps with one element, else NaN."""
        counted = vector.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        every = self.grid.frame(self.spark).join(counted, "ts", "left")
        return every.select("ts", F.when(F.col("n") == 1, F.col("v")).otherwise(ieee.number(ieee.NAN)).alias("v"))

    def scalar_binary(self, node: Binary) -> Scalar:
        a, b = self.scalar(node.left), self.scalar(node.right)

        def apply(x: Column, y: Column) -> Column:
            if node.op in ieee.ARITHMETIC:
                return ieee.ARITHMETIC[node.op](x, y)
            return F.when(ieee.COMPARE[node.op](x, y), ieee.number(1)).otherwise(ieee.number(0))

        if a.frame is None and b.frame is None:
            return Scalar(apply(a.column, b.column))
        rows = self.steps(a).join(self.steps(b).withColumnRenamed("v", "r"), "ts")
        return Scalar(frame=rows.select("ts", apply(F.col("v"), F.col("r")).alias("v")))

    def beside(self, vector: DataFrame, value: Scalar) -> tuple[DataFrame, Column]:
        """The vector, and a column of it that holds the scalar."""
        if value.frame is None:
            return vector, value.column
        return vector.join(value.frame.withColumnRenamed("v", "scalar_"), "ts"), F.col("scalar_")

    # vectors

    def vector(self, node: Node) -> DataFrame:
        node = self.bare(node)
        if isinstance(node, Selector):
            key = str(node)
            if key not in self._seen:
                self._seen[key] = selectors.instant(self.samples, node.matchers, self.grid, self.lookback, node.offset)
            return self._seen[key]
        if isinstance(node, Unary):
            return self.vector(node.inner).select("ts", self.nameless().alias("labels"), (-F.col("v")).alias("v"))
        if isinstance(node, Aggregate):
            return self.aggregate(node)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Call):
            return self.call(node)
        raise UnimplementedError(f"{node} can't be evaluated as an instant vector")

    def nameless(self) -> Column:
        return drop_labels(F.col("labels"), [METRIC])

    def aggregate(self, node: Aggregate) -> DataFrame:
        inner = self.vector(node.inner)
        if node.param is None:
            return aggregates.aggregate(node.op, inner, node.labels, node.without)
        constant = self.bare(node.param)
        rows, param = self.beside(inner, self.scalar(node.param))
        if node.op == "quantile":
            return aggregates.quantile(rows, param, node.labels, node.without)
        if isinstance(constant, Number):
            k = F.lit(int(min(max(constant.value, 0), 2**31 - 1)))
        else:  # towards zero; NaN gives none
            k = F.when(F.isnan(param), 0).otherwise(F.least(F.greatest(param, F.lit(0.0)), F.lit(2.0**31 - 1)).cast("int"))
        return aggregates.ranked(node.op, rows, k, node.labels, node.without)

    def binary(self, node: Binary) -> DataFrame:
        left_scalar, right_scalar = (x.type is ValueType.SCALAR for x in (node.left, node.right))
        if not left_scalar and not right_scalar:
            a, b = self.vector(node.left), self.vector(node.right)
            if node.op in ("and", "or", "unless"):
                return binary.set_operator(node.op, a, b, node.on, node.labels)
            return binary.one_to_one(node.op, a, b, node.bool_, node.on, node.labels)
        rows, scalar = self.beside(self.vector(node.right if left_scalar else node.left), self.scalar(node.left if left_scalar else node.right))
        a, b = (scalar, F.col("v")) if left_scalar else (F.col("v"), scalar)
        if node.op in ieee.ARITHMETIC:
            return rows.select("ts", self.nameless().alias("labels"), ieee.ARITHMETIC[node.op](a, b).alias("v"))
        test = ieee.COMPARE[node.op](a, b)
        if node.bool_:
            return rows.select("ts", self.nameless().alias("labels"), F.when(test, ieee.number(1)).otherwise(ieee.number(0)).alias("v"))
        return rows.where(test).select("ts", "labels", "v")

    def call(self, node: Call) -> DataFrame:
        function = FUNCTIONS[node.name]
        if not function.implemented:
            raise UnimplementedError(f"{node.name}() is not implemented")
        if function.arguments[:1] == ("range vector",):
            return self.window(node)
        if node.name == "vector":
            return self.steps(self.scalar(node.arguments[0])).select("ts", no_labels().alias("labels"), "v")
        inner = self.vector(node.arguments[0])
        if node.name == "absent":
            empty = self.grid.frame(self.spark).join(inner.select("ts").distinct(), "ts", "left_anti")
            return empty.select("ts", no_labels().alias("labels"), ieee.number(1).alias("v"))
        if node.name == "timestamp":
            return inner.select("ts", self.nameless().alias("labels"), (F.col("ts") / F.lit(1000.0)).alias("v"))
        if node.name in ieee.ELEMENT:
            return inner.select("ts", self.nameless().alias("labels"), ieee.ELEMENT[node.name](F.col("v")).alias("v"))
        second = self.scalar(node.arguments[1]) if len(node.arguments) > 1 else Scalar(ieee.number(1))
        rows, bound = self.beside(inner, second)
        of = {"round": ieee.round_to, "clamp_min": ieee.at_least, "clamp_max": ieee.at_most}[node.name]
        labels = self.nameless() if function.drops_name else F.col("labels")
        return rows.select("ts", labels.alias("labels"), of(F.col("v"), bound).alias("v"))

    def window(self, node: Call) -> DataFrame:
        inner = self.bare(node.arguments[0])
        key = f"{node.name} {inner}"
        if key not in self._seen:
            rows = windows.window_function(node.name, self.samples, inner.matchers, self.grid, inner.range, inner.offset)
            labels = self.nameless() if FUNCTIONS[node.name].drops_name else F.col("labels")
            self._seen[key] = rows.select("ts", labels.alias("labels"), "v")
        return self._seen[key]

    def matrix(self, node: Node) -> DataFrame:
        """Samples (ts, labels, t, v) of each step's window."""
        inner = self.bare(node)
        rows = selectors.panes(self.samples, inner.matchers, self.grid, inner.range, inner.offset)
        k = selectors.windows_of(self.grid, inner.range)
        return rows.select("labels", "t", "v", k.alias("k")).select(self.grid.time(F.col("k")).alias("ts"), "labels", "t", "v")


__all__ = ["Compiler", "Scalar", "String"]
