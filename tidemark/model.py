"""Labels, matchers and durations: what the language, the storage and the compiler share.

A label set is an array of (name, value) structs sorted by name; Spark compares, groups and joins such arrays as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regex import finite_set, java_pattern

METRIC = "__name__"
LABELS_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
SAMPLES_SCHEMA = T.StructType([T.StructField("metric", T.StringType()), T.StructField("labels", LABELS_TYPE), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
# fixed values: the time bounds leave room for adding a lookback without overflow
MAX_TIME = (1 << 63) - 1 >> 2
MIN_TIME = -MAX_TIME
# fixed values: milliseconds of each unit, days and longer of fixed width
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_LABEL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_DURATION = re.compile(r"(?:\d+(?:ms|[smhdwy]))+")
_DURATION_PART = re.compile(r"(\d+)(ms|[smhdwy])")


def parse_duration(text: str) -> int:
    """Milliseconds of a literal such as 1h30m; ValueError if it is malformed."""
    if not _DURATION.fullmatch(text):
        raise ValueError(f"malformed duration {text!r}")
    return sum(int(n) * UNITS[unit] for n, unit in _DURATION_PART.findall(text))


def format_duration(ms: int) -> str:
    if ms == 0:
        return "0s"
    out, rest = "-" if ms < 0 else "", abs(ms)
    for unit, size in sorted(UNITS.items(), key=lambda x: -x[1]):
        n, rest = divmod(rest, size)
        out += f"{n}{unit}" if n else ""
    return out


def valid_label_name(name: str) -> bool:
    return bool(_LABEL_NAME.fullmatch(name))


@dataclass(frozen=True)
class Matcher:
    """A test of one label; a label that is absent counts as empty. op: =, !=, =~ or !~; patterns match the whole value."""

    name: str
    op: str
    value: str

    def __post_init__(self):
        if self.op in ("=~", "!~"):
            java_pattern(self.value)

    def matches(self, value: str) -> bool:
        if self.op in ("=", "!="):
            return (value == self.value) == (self.op == "=")
        literals = finite_set(self.value)
        hit = value in literals if literals is not None else bool(re.fullmatch(python_pattern(self.value), value))
        return hit == (self.op == "=~")

    def column(self, value: Column) -> Column:
        """The test on a column that is never null. Finite patterns become a list of values, `.*` needs no look."""
        if self.op == "=":
            return value == self.value
        if self.op == "!=":
            return value != self.value
        literals = finite_set(self.value)
        if literals is not None:
            hit = value.isin(*sorted(literals))
        elif self.value == "(?s).*":
            hit = F.lit(True)
        else:
            hit = value.rlike(java_pattern(self.value))
        return hit if self.op == "=~" else ~hit


def python_pattern(pattern: str) -> str:
    """A pattern as Python's re takes it; used for the parser's check against the empty string and in tests."""
    return java_pattern(pattern).removeprefix("(?d)").removeprefix(r"\A(?:").removesuffix(r")\z").replace(r"\z", r"\Z").replace("(?<", "(?P<")


def get_label(labels: Column, name: str) -> Column:
    """The label's value, empty if absent."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def drop_labels(labels: Column, names: Iterable[str]) -> Column:
    """Without the named labels, and without empty values."""
    names = list(names)
    return F.filter(labels, lambda x: ~x["name"].isin(names) & (x["value"] != ""))


def keep_labels(labels: Column, names: Iterable[str]) -> Column:
    """Only the named labels that are present and not empty."""
    names = list(names)
    if not names:
        return no_labels()
    return F.filter(labels, lambda x: x["name"].isin(names) & (x["value"] != ""))


def no_labels() -> Column:
    return F.array().cast(LABELS_TYPE)


def make_labels(pairs: dict[str, Column]) -> Column:
    """Labels from columns, sorted by name; pairs whose value is null are left out."""
    structs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))) for k, v in sorted(pairs.items())]
    return F.array_compact(F.array(*structs)).cast(LABELS_TYPE)


def labels_from_map(column: Column) -> Column:
    entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.array_sort(entries).cast(LABELS_TYPE)


def format_labels(labels: Iterable) -> str:
    """name{a="b", c="d"}, or {} when empty."""
    from .lang.ast import quote

    pairs = [(x["name"], x["value"]) for x in labels]
    name = next((v for k, v in pairs if k == METRIC), "")
    rest = ", ".join(f"{k}={quote(v)}" for k, v in pairs if k != METRIC)
    return f"{name}{{{rest}}}" if rest or not name else name
