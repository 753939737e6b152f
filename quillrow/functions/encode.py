"""Rows as delimited records, in column expressions alone.

Text columns give text that is encoded as UTF-8 at the end.  With ``binary=True`` fields are bytes:
they pass through the expressions as ISO-8859-1, byte for byte.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import configuration
from ..plans.formats import BOM, CRLF, NEWLINE, Format, Nulls, Quoting

#: The spelling of floating point numbers, with an optional sign.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\z"


def _char(b: bytes) -> str:
    return b.decode("latin-1")


def _klass(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(chars)) + "]"


def _swap(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def _mark(binary: bool) -> str:
    return BOM.decode("latin-1") if binary else "﻿"


def needs_quotes(value: Column, fmt: Format, first: bool, binary: bool = False) -> Column:
    """Whether a field can't stand bare."""
    chars = _char(fmt.delimiter[:1] + fmt.quote + fmt.lead) + ("\r" if fmt.record_ending in (NEWLINE, CRLF) else "")
    test = value.rlike(_klass(chars))
    if first:
        test = test | value.startswith(F.lit(_mark(binary)))
        if fmt.comment:
            test = test | value.startswith(F.lit(_char(fmt.comment)))
    return test


def quoted(value: Column, fmt: Format) -> Column:
    quote = _char(fmt.quote)
    if fmt.escape.style == "double_quote":
        inner = _swap(value, quote, quote + quote)
    else:
        escape = _char(fmt.escape.byte)
        inner = _swap(_swap(value, escape, escape + escape), quote, escape + quote)
    return F.concat(F.lit(quote), inner, F.lit(quote))


def escaped(value: Column, fmt: Format, first: bool, binary: bool = False) -> Column:
    """A field of a format that escapes outside quotes."""
    escape = _char(fmt.escape.byte)
    out = _swap(value, escape, escape + escape)
    named = {"\0": "0", "\b": "b", "\n": "n", "\r": "r", "\t": "t", "\x1a": "Z"} if fmt.escape.style == "mysql" else {}
    for c, name in named.items():
        out = _swap(out, c, escape + name)
    for c in dict.fromkeys(_char(fmt.delimiter[:1] + fmt.lead + fmt.quote)):
        if c not in named:
            out = _swap(out, c, escape + c)
    if first:
        leads = F.lit(False)
        if binary:  # as text a mark is one character, whose first byte alone can't be escaped
            leads = leads | value.startswith(F.lit(_mark(True)))
        if fmt.comment:
            leads = leads | value.startswith(F.lit(_char(fmt.comment)))
        out = F.when(leads, F.concat(F.lit(escape), out)).otherwise(out)
    return out


def numeric(value: Column) -> Column:
    return value.rlike(_NUMBER)


def _refuse(value: Column, bad: Column, why: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(f"Encode: {why}")).cast("string")).otherwise(value)


def field(value: Column, fmt: Format, first: bool = False, binary: bool = False) -> Column:
    """One field as it stands in a record; NULL as the format's NULL."""
    none = F.lit("\\N" if fmt.nulls is Nulls.MYSQL else "")
    bare = value
    if fmt.escape.anywhere:
        out = escaped(value, fmt, first, binary)
        if fmt.nulls is Nulls.MYSQL:
            out = F.when(value == "\\N", F.lit(_char(fmt.escape.byte) + "\\N")).otherwise(out)
    elif fmt.quoting is Quoting.ALWAYS:
        out = quoted(value, fmt)
    elif fmt.quoting is Quoting.NECESSARY:
        out = F.when(needs_quotes(value, fmt, first, binary), quoted(value, fmt)).otherwise(bare)
    elif fmt.quoting is Quoting.NON_NUMERIC:
        out = F.when(needs_quotes(value, fmt, first, binary) | ~numeric(value), quoted(value, fmt)).otherwise(bare)
    elif fmt.quoting is Quoting.NEVER:
        out = _refuse(value, needs_quotes(value, fmt, first, binary), "a field needs quotes")
    else:
        out = bare
    if not fmt.escape.anywhere:
        if fmt.nulls is Nulls.POSTGRES_CSV:
            out = F.when(value == "", F.lit(_char(fmt.quote) * 2)).otherwise(out)
        elif fmt.nulls is Nulls.MYSQL and fmt.quoting is Quoting.NEVER:
            out = _refuse(out, value == "\\N", "a field that reads as NULL needs quotes")
        elif fmt.nulls is Nulls.MYSQL:
            out = F.when(value == "\\N", quoted(value, fmt)).otherwise(out)
    if fmt.nulls is Nulls.NONE:  # NULL is written as an empty field is
        empty = _char(fmt.quote) * 2 if fmt.quoting in (Quoting.ALWAYS, Quoting.NON_NUMERIC) and not fmt.escape.anywhere else ""
        none = F.lit(empty)
    return F.when(value.isNull(), none).otherwise(out)


#: What the text of numbers, booleans, dates and times is made of.
_TYPED = set("0123456789+-.:eEINfinatyTZruls ")


def bare(kind: T.DataType, fmt: Format) -> bool:
    """Whether no value of a type can need quotes or escapes, so that none has to be looked at."""
    typed = isinstance(kind, (T.IntegralType, T.DecimalType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
    number = isinstance(kind, (T.IntegralType, T.DecimalType, T.FractionalType))
    structural = _char(fmt.delimiter[:1] + fmt.quote + fmt.lead + fmt.escape.byte + fmt.comment)
    policy = fmt.quoting in (Quoting.NECESSARY, Quoting.NEVER, Quoting.RAW) or (number and fmt.quoting is Quoting.NON_NUMERIC)
    return typed and policy and not _TYPED & set(structural)


def record(columns: list[Column], fmt: Format, ending: bool = True, binary: bool = False, plain: tuple[bool, ...] = ()) -> Column:
    """A record of text (or bytes as ISO-8859-1) columns; ``ending``: with its record ending;
    ``plain``: which columns can't need quotes."""
    if not columns:
        return F.lit(_char(fmt.ending) if ending else "")
    own = plain or (False,) * len(columns)
    null = F.lit("\\N" if fmt.nulls is Nulls.MYSQL else "")
    blank = fmt.quoting is Quoting.NON_NUMERIC and fmt.nulls is Nulls.NONE
    parts = [F.coalesce(c, null) if p and not blank else field(c, fmt, first=i == 0, binary=binary) for i, (c, p) in enumerate(zip(columns, own))]
    line = F.concat_ws(_char(fmt.delimiter), *parts) if len(parts) > 1 else parts[0]
    if len(parts) == 1 and fmt.quoting is Quoting.NECESSARY:
        # a lone empty field would be a blank line
        own = columns[0] == "" if fmt.nulls is not Nulls.NONE else F.coalesce(columns[0], F.lit("")) == ""
        line = F.when(own, F.lit(_char(fmt.quote) * 2)).otherwise(line)
    return F.concat(line, F.lit(_char(fmt.ending))) if ending else line


def text_of(column: Column, kind: T.DataType) -> Column:
    """A typed column as the text of its field: numbers in shortest form, booleans in words."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise configuration(f"a field can't hold {kind.simpleString()}")
    if isinstance(kind, T.BinaryType):
        return F.decode(column, "ISO-8859-1")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return shortest(column)
    return column.cast("string")


def shortest(column: Column) -> Column:
    """A floating point number without an exponent, in the fewest digits that read back the same."""
    text = column.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    # Java's exponent form is expanded exactly: decimals of 38 digits hold all of 1e-7 .. 1e21 and
    # beyond that the digits are shifted in text
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"[-.]", "")
    digits = F.regexp_replace(digits, r"^0*([0-9])0$", "$1")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    large = F.when(power + 1 >= F.length(digits), F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    expanded = F.concat(sign, F.when(power > 0, large).otherwise(small))
    return F.when(column.isNull(), None).when(F.isnan(column), "NaN").when(text.endswith("Infinity"), F.regexp_replace(text, "Infinity", "inf")).when(power.isNotNull(), expanded).otherwise(plain)


def encoded(df: DataFrame, fmt: Format, columns: list[str] | None = None, *, name: str = "line", ending: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one record, as bytes in a column ``name``."""
    kinds = {f.name: f.dataType for f in df.schema}
    columns = columns or df.columns
    # a format that escapes outside quotes escapes the first byte of a leading mark, so it needs bytes
    binary = bool(fmt.escape.anywhere) or any(isinstance(kinds[c], T.BinaryType) for c in columns)
    values = []
    for c in columns:
        v = text_of(F.col(f"`{c}`"), kinds[c])
        if binary and not isinstance(kinds[c], T.BinaryType):
            v = F.decode(F.encode(v, "UTF-8"), "ISO-8859-1")
        values.append(v)
    plain = tuple(bare(kinds[c], fmt) for c in columns)
    line = F.encode(record(values, fmt, ending, binary, plain), "ISO-8859-1" if binary else "UTF-8")
    return df.select(*[F.col(f"`{k}`") for k in keep], line.alias(name))


def encoded_arrays(df: DataFrame, column: str, fmt: Format, field_count: str | int = "flexible", *, name: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each ``array<string>`` as one record of as many fields.

    ``field_count``: flexible, or the number that every record must have.  A record of no fields is its ending.
    """
    values = F.col(f"`{column}`")
    binary = bool(fmt.escape.anywhere)
    if binary:
        values = F.transform(values, lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1"))
    delimiter, n = _char(fmt.delimiter), F.size(values)
    first = field(F.get(values, F.lit(0)), fmt, first=True, binary=binary)
    rest = F.transform(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda x: field(x, fmt, binary=binary))
    line = F.when(n == 0, F.lit("")).when(n == 1, record([F.get(values, F.lit(0))], fmt, False, binary)).otherwise(F.concat_ws(delimiter, first, rest))
    line = F.concat(line, F.lit(_char(fmt.ending)))
    if field_count != "flexible":
        line = F.when(n == field_count, line).otherwise(F.raise_error(F.concat(F.lit("FieldCountMismatch: "), n.cast("string"), F.lit(f" fields, {field_count} expected"))).cast("string"))
    return df.select(*[F.col(f"`{k}`") for k in keep], F.encode(line, "ISO-8859-1" if binary else "UTF-8").alias(name))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns, depth first, for records without headers.  Maps and arrays, which
    have no fixed width, are refused."""

    def leaves(path: list[str], kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind for c in leaves([*path, f.name], f.dataType)]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            raise configuration(f"a record can't hold {kind.simpleString()}")
        return [F.col(".".join(f"`{p}`" for p in path)).alias("_".join(path))]

    return df.select(*[c for f in df.schema for c in leaves([f.name], f.dataType)])


def header(names: list[str], fmt: Format) -> bytes:
    """The header record, by the rules for any record."""
    return _record_bytes([n.encode() for n in names], fmt)


def _record_bytes(values: list[bytes | None], fmt: Format) -> bytes:
    """One record on the driver: for headers and appends."""
    if len(values) == 1 and not values[0] and fmt.quoting is Quoting.NECESSARY:
        return fmt.quote * 2 + fmt.ending
    return fmt.delimiter.join(_field_bytes(v, fmt, i == 0) for i, v in enumerate(values)) + fmt.ending


def _field_bytes(value: bytes | None, fmt: Format, first: bool) -> bytes:
    if value is None:
        return b"\\N" if fmt.nulls is Nulls.MYSQL else b""
    escape = fmt.escape.byte
    if fmt.escape.anywhere:
        named = {0: b"0", 8: b"b", 10: b"n", 13: b"r", 9: b"t", 26: b"Z"} if fmt.escape.style == "mysql" else {}
        structural = fmt.delimiter[:1] + fmt.lead + fmt.quote + escape
        out = b"".join(escape + named[b] if b in named else escape + bytes([b]) if b in structural else bytes([b]) for b in value)
        return escape + out if first and (value.startswith(BOM) or (fmt.comment and value.startswith(fmt.comment))) else out
    special = fmt.delimiter[:1] + fmt.quote + fmt.lead + (b"\r" if fmt.record_ending in (NEWLINE, CRLF) else b"")
    needs = any(b in special for b in value) or (first and (value.startswith(BOM) or bool(fmt.comment and value.startswith(fmt.comment))))
    number = re.match(_NUMBER.replace(r"\z", r"\Z").encode(), value)
    if fmt.quoting is Quoting.ALWAYS or (needs and fmt.quoting in (Quoting.NECESSARY, Quoting.NON_NUMERIC)) or (fmt.quoting is Quoting.NON_NUMERIC and not number) or (fmt.nulls is Nulls.POSTGRES_CSV and not value):
        if fmt.escape.style == "double_quote":
            return fmt.quote + value.replace(fmt.quote, fmt.quote * 2) + fmt.quote
        return fmt.quote + value.replace(escape, escape * 2).replace(fmt.quote, escape + fmt.quote) + fmt.quote
    if needs and fmt.quoting is Quoting.NEVER:
        raise configuration("a field needs quotes")
    return value
