"""Column arithmetic with IEEE results where Spark's own raises, gives null, or orders NaN as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(value: float) -> Column:
    return F.lit(value).cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, number(-1))).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    plain = F.try_mod(a, b)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), number(NAN)).when(F.abs(b) == INF, a).otherwise(plain)


def power(a: Column, b: Column) -> Column:
    one = (a == 1) | ((a == -1) & (F.abs(b) == INF))
    return F.when(one, number(1)).otherwise(F.pow(a, b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": power}

#: False wherever a side is NaN, but for !=.
COMPARE = {
    "==": lambda a, b: (a == b) & ~F.isnan(a) & ~F.isnan(b),
    "!=": lambda a, b: (a != b) | F.isnan(a) | F.isnan(b),
    ">": lambda a, b: (a > b) & ~F.isnan(a) & ~F.isnan(b),
    "<": lambda a, b: (a < b) & ~F.isnan(a) & ~F.isnan(b),
    ">=": lambda a, b: (a >= b) & ~F.isnan(a) & ~F.isnan(b),
    "<=": lambda a, b: (a <= b) & ~F.isnan(a) & ~F.isnan(b),
}


def whole(v: Column, of) -> Column:
    """floor or ceil as a double of any size, with the sign of zero kept."""
    return F.when((F.abs(v) < float(1 << 52)) & (v != F.lit(0.0)), of(v).cast("double")).otherwise(v)


def logarithm(v: Column, of) -> Column:
    return F.when(F.isnan(v), v).when(v == 0, number(-INF)).when(v < 0, number(NAN)).otherwise(of(v))


def round_to(v: Column, nearest: Column) -> Column:
    """floor(v / nearest + 0.5) * nearest: halves go up, also below zero."""
    return whole(divide(v, nearest) + 0.5, F.floor) * nearest


def at_least(v: Column, bound: Column) -> Column:
    nan = F.isnan(v) | F.isnan(bound)
    return F.when((v == INF) | (bound == INF), number(INF)).when(nan, number(NAN)).otherwise(F.greatest(v, bound))


def at_most(v: Column, bound: Column) -> Column:
    nan = F.isnan(v) | F.isnan(bound)
    return F.when((v == -INF) | (bound == -INF), number(-INF)).when(nan, number(NAN)).otherwise(F.least(v, bound))


ELEMENT = {
    "abs": F.abs,
    "ceil": lambda v: whole(v, F.ceil),
    "floor": lambda v: whole(v, F.floor),
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": lambda v: logarithm(v, F.log),
    "log2": lambda v: logarithm(v, F.log2),
    "log10": lambda v: logarithm(v, F.log10),
    "sgn": F.signum,
}


def smallest(v: Column) -> Column:
    """Least value with NaN losing; null if there is no number."""
    return F.min(F.when(~F.isnan(v), v))


def largest(v: Column) -> Column:
    return F.max(F.when(~F.isnan(v), v))
