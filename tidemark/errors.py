"""Errors of the engine, with the class and status that an API answer carries."""

from __future__ import annotations


class TidemarkError(Exception):
    kind, status = "internal", 500


class ParseError(TidemarkError):
    """A query that can't be parsed or has wrong types; position counts from 0."""

    kind, status = "bad_data", 400

    def __init__(self, message: str, position: int = 0, query: str = ""):
        super().__init__(f"{message} (at {position})")
        self.message, self.position, self.query = message, position, query

    def pretty(self) -> str:
        """The query's line with a caret under the position."""
        begin = self.query.rfind("\n", 0, self.position) + 1
        line = self.query[begin:].split("\n", 1)[0]
        return f"{line}\n{' ' * (self.position - begin)}^\n{self.message}"


class InvalidRangeError(TidemarkError):
    kind, status = "bad_data", 400


class MatchError(TidemarkError):
    """Series that can't be paired one to one."""

    kind, status = "bad_data", 400


class SampleLimitError(TidemarkError):
    kind, status = "execution", 422


class QueryTimeout(TidemarkError):
    kind, status = "timeout", 503


class UnimplementedError(TidemarkError):
    kind, status = "unimplemented", 501


class ClosedError(TidemarkError):
    kind, status = "unavailable", 503


class WriteError(TidemarkError):
    kind, status = "bad_data", 400
