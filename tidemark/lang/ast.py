"""Syntax tree. Every node knows its value type and prints itself in the language."""

from __future__ import annotations

import enum
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.registry import AGGREGATIONS, FUNCTIONS
from ..model import METRIC, Matcher, format_duration


class ValueType(enum.Enum):
    SCALAR = "scalar"
    STRING = "string"
    VECTOR = "instant vector"
    MATRIX = "range vector"

    @property
    def phrase(self) -> str:
        return ("an " if self is ValueType.VECTOR else "a ") + self.value


_ESCAPED = {"\\": r"\\", '"': r"\"", "\n": r"\n", "\t": r"\t", "\r": r"\r"}


def quote(text: str) -> str:
    return '"' + "".join(_ESCAPED.get(c) or (c if c.isprintable() else rf"\U{ord(c):08x}") for c in text) + '"'


def format_number(value: float) -> str:
    if math.isfinite(value) and value == int(value) and abs(value) < 1e15:
        return str(int(value)) if value or math.copysign(1, value) > 0 else "-0"
    return repr(value)


@dataclass
class Node:
    position: int = field(default=0, compare=False, kw_only=True)

    type = ValueType.VECTOR

    @property
    def children(self) -> list[Node]:
        return []


@dataclass
class Number(Node):
    value: float
    type = ValueType.SCALAR

    def __str__(self) -> str:
        return format_number(self.value)


@dataclass
class String(Node):
    value: str
    type = ValueType.STRING

    def __str__(self) -> str:
        return quote(self.value)


@dataclass
class Selector(Node):
    """Series by matchers; with a range (ms) a range vector, else the newest samples. offset (ms) shifts back."""

    name: str
    matchers: list[Matcher]
    range: int | None = None
    offset: int = 0

    @property
    def type(self) -> ValueType:
        return ValueType.VECTOR if self.range is None else ValueType.MATRIX

    def __str__(self) -> str:
        rest = [m for m in self.matchers if not (self.name and m == Matcher(METRIC, "=", self.name))]
        out = self.name + ("{" + ", ".join(f"{m.name}{m.op}{quote(m.value)}" for m in rest) + "}" if rest else "")
        if self.range is not None:
            out += f"[{format_duration(self.range)}]"
        return out + (f" offset {format_duration(self.offset)}" if self.offset else "")


@dataclass
class Paren(Node):
    inner: Node

    @property
    def type(self) -> ValueType:
        return self.inner.type

    @property
    def children(self) -> list[Node]:
        return [self.inner]

    def __str__(self) -> str:
        return f"({self.inner})"


@dataclass
class Unary(Node):
    """Negation."""

    inner: Node

    @property
    def type(self) -> ValueType:
        return self.inner.type

    @property
    def children(self) -> list[Node]:
        return [self.inner]

    def __str__(self) -> str:
        return f"-{self.inner}"


@dataclass
class Binary(Node):
    """on: None without matching labels given, True for on(...), False for ignoring(...)."""

    op: str
    left: Node
    right: Node
    bool_: bool = False
    on: bool | None = None
    labels: tuple[str, ...] = ()

    @property
    def type(self) -> ValueType:
        return ValueType.SCALAR if self.left.type is self.right.type is ValueType.SCALAR else ValueType.VECTOR

    @property
    def children(self) -> list[Node]:
        return [self.left, self.right]

    def __str__(self) -> str:
        match = "" if self.on is None else f" {'on' if self.on else 'ignoring'} ({', '.join(self.labels)})"
        return f"{self.left} {self.op}{' bool' * self.bool_}{match} {self.right}"


@dataclass
class Aggregate(Node):
    op: str
    inner: Node
    param: Node | None = None
    without: bool = False
    labels: tuple[str, ...] = ()

    @property
    def children(self) -> list[Node]:
        return [x for x in (self.param, self.inner) if x is not None]

    def __str__(self) -> str:
        out = f"{self.op}({', '.join(map(str, self.children))})"
        return out + (f" {'without' if self.without else 'by'} ({', '.join(self.labels)})" if self.labels or self.without else "")


@dataclass
class Call(Node):
    name: str
    arguments: list[Node]

    @property
    def type(self) -> ValueType:
        return ValueType(FUNCTIONS[self.name].returns)

    @property
    def children(self) -> list[Node]:
        return self.arguments

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.arguments))})"


def walk(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children:
        yield from walk(child)


def selectors(node: Node) -> list[Selector]:
    return [x for x in walk(node) if isinstance(x, Selector)]


__all__ = ["AGGREGATIONS", "Aggregate", "Binary", "Call", "Node", "Number", "Paren", "Selector", "String", "Unary", "ValueType", "quote", "selectors", "walk"]
