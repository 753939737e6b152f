"""Rows through text and back: encode with one format, parse with it, and give the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import encoded
from ..plans.formats import Format
from ..plans.options import ParseOptions
from ..plans.predicate import Predicate
from .scan import parse_column


def through_text(df: DataFrame, fmt: Format, *, columns: list[int | str] | None = None, predicate: Predicate | None = None, field_count: str | int = "match_first") -> DataFrame:
    """All columns as text, by way of records of ``fmt``."""
    lines = encoded(df, fmt)
    return parse_column(lines, "line", fmt, ParseOptions(headers=tuple(df.columns), field_count=field_count), columns=columns, predicate=predicate)


def as_text(df: DataFrame, decimals: dict[str, str] | None = None) -> DataFrame:
    """Columns that a record can hold: those named as decimals first, timestamps as text."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if decimals and f.name in decimals:
            c = c.cast(decimals[f.name])
        elif f.dataType.typeName().startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)
