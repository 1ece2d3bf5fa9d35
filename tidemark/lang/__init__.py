"""The query language: tokens, syntax tree with value types, parser and printer."""

from .ast import Aggregate, Binary, Call, Node, Number, Paren, Selector, String, Unary, ValueType, selectors, walk
from .parser import parse

__all__ = ["Aggregate", "Binary", "Call", "Node", "Number", "Paren", "Selector", "String", "Unary", "ValueType", "parse", "selectors", "walk"]
