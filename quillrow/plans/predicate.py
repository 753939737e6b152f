"""Predicates on one column, as values that a scan can push down and Spark can evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import Format


@dataclass(frozen=True)
class Predicate:
    """``column``: a position or a header name (the first of that name; an unknown one matches
    nothing).  An absent field never matches; a NULL reads as empty bytes."""

    kind: str  # equals, contains, starts_with, ends_with
    column: int | str
    literal: bytes

    def matches(self, value: bytes | None) -> bool:
        value = value or b""
        return {
            "equals": value.__eq__,
            "contains": value.__contains__,
            "starts_with": value.startswith,
            "ends_with": value.endswith,
        }[self.kind](self.literal)

    def position(self, names: list[str] | None) -> int | None:
        if isinstance(self.column, int):
            return self.column
        return names.index(self.column) if names and self.column in names else None

    def skippable(self, fmt: Format) -> bool:
        """Whether raw bytes without the literal can't hold a match."""
        structural = fmt.delimiter + fmt.ending + fmt.quote + fmt.escape.byte + b"\r\n" + (fmt.comment or b"")
        return bool(self.literal) and not set(self.literal) & set(structural)

    def condition(self, fields: Column, at: int) -> Column:
        """The same test on an ``array<binary>`` column, evaluated by Spark."""
        value = F.coalesce(F.get(fields, F.lit(at)), F.lit(b""))
        literal = F.lit(self.literal)
        test = {
            "equals": lambda: value == literal,
            "contains": lambda: F.contains(value, literal),
            "starts_with": lambda: F.startswith(value, literal),
            "ends_with": lambda: F.endswith(value, literal),
        }[self.kind]()
        return (F.size(fields) > at) & F.coalesce(test, F.lit(False))


def _raw(literal: bytes | str) -> bytes:
    return literal.encode() if isinstance(literal, str) else literal


def equals(column: int | str, literal: bytes | str) -> Predicate:
    return Predicate("equals", column, _raw(literal))


def contains(column: int | str, literal: bytes | str) -> Predicate:
    return Predicate("contains", column, _raw(literal))


def starts_with(column: int | str, literal: bytes | str) -> Predicate:
    return Predicate("starts_with", column, _raw(literal))


def ends_with(column: int | str, literal: bytes | str) -> Predicate:
    return Predicate("ends_with", column, _raw(literal))
