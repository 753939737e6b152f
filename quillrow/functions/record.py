"""Records as arrays of fields: access, change, comparison and conversion.

A record is an ``array<binary>`` or ``array<string>``; an explicit NULL is a null element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import decoded, utf8


def get(fields: Column, at: int) -> Column:
    """The field at a position, NULL where the record is shorter."""
    return F.get(fields, F.lit(at))


def is_null(fields: Column, at: int) -> Column:
    """Whether the field is there and an explicit NULL."""
    return (F.size(fields) > at) & F.get(fields, F.lit(at)).isNull()


def length(fields: Column) -> Column:
    return F.size(fields)


def project(fields: Column, columns: list[int]) -> Column:
    return F.array(*[get(fields, c) for c in columns])


def push_field(fields: Column, value: Column) -> Column:
    return F.array_append(fields, value)


def push_null(fields: Column) -> Column:
    return F.array_append(fields, F.get(fields, F.lit(-1)))


def set_field(fields: Column, at: int, value: Column) -> Column:
    """The record with one field replaced; as it was where it is shorter."""
    return F.transform(fields, lambda x, i: F.when(i == at, value).otherwise(x))


def set_null(fields: Column, at: int) -> Column:
    return F.transform(fields, lambda x, i: F.when(i != at, x))


def truncate(fields: Column, n: int) -> Column:
    return F.slice(fields, 1, n)


def to_text(fields: Column, on_error: str = "fail") -> Column:
    return F.transform(fields, lambda x: utf8(x, on_error))


def to_bytes(fields: Column) -> Column:
    return F.transform(fields, lambda x: F.encode(x, "UTF-8"))


def same(a: Column, b: Column) -> Column:
    """Equal values and equal NULLs."""
    return a.eqNullSafe(b)


def as_map(fields: Column, names: list[str]) -> Column:
    """Header to field; fields beyond the headers are left out, missing ones are NULL.  Needs headers."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), project(fields, list(range(len(names)))))


def as_struct(fields: Column, names: list[str]) -> Column:
    return F.struct(*[get(fields, i).alias(n) for i, n in enumerate(names)])


def hashed(fields: Column) -> Column:
    """A hash that equal records share; a NULL and an empty field differ."""
    return F.xxhash64(F.transform(fields, lambda x: F.struct(x.isNull().alias("none"), x.alias("value"))))


def joined(fields: Column) -> Column:
    """All fields end to end; NULLs add nothing."""
    return F.array_join(fields, "")


def ranges(fields: Column) -> Column:
    """Where each field stands in ``joined``: an array of (start, end) in characters of text, bytes of bytes."""
    sizes = F.transform(fields, lambda x: F.coalesce(F.length(x), F.lit(0)))
    ends = F.transform(F.sequence(F.lit(1), F.size(fields)), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))
    spans = F.transform(ends, lambda e, i: F.struct((e - F.get(sizes, i)).alias("start"), e.alias("end")))
    return F.when(F.size(fields) > 0, spans).otherwise(F.slice(spans, 1, 0))


def as_tuple(fields: Column, kinds: list[str], on_error: str = "fail") -> Column:
    """Typed fields by position: a struct (_1, _2, ...)."""
    return F.struct(*[decoded(get(fields, i), k, on_error=on_error).alias(f"_{i + 1}") for i, k in enumerate(kinds)])


def as_sequence(fields: Column, kind: str, start: int = 0, on_error: str = "fail") -> Column:
    """All fields from a position on as values of one type."""
    return F.transform(F.slice(fields, start + 1, F.greatest(F.size(fields) - start, F.lit(0))), lambda x: decoded(x, kind, on_error=on_error))


def as_variant(field: Column, variants: tuple[str, ...], on_error: str = "fail") -> Column:
    """A field that must be one of the names."""
    other = F.lit(None).cast("string") if on_error == "null" else F.raise_error(F.concat(F.lit("InvalidValue: no such variant: "), field)).cast("string")
    return F.when(field.isin(*variants), field).otherwise(other)
