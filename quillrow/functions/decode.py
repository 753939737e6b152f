"""Strict conversions of text fields to types, as column expressions.

Unlike ``cast`` they take no blanks, no type suffixes and no words but ``true`` and ``false``.
``on_error``: ``fail`` raises, ``null`` gives NULL.  ``empty``: what an empty field of an optional
column means, ``null`` or, as the text-preserving mode has it, ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGNED = {"byte": ("tinyint", 8), "short": ("smallint", 16), "int": ("int", 32), "long": ("bigint", 64)}
_UNSIGNED = {"u8": ("smallint", 8), "u16": ("int", 16), "u32": ("bigint", 32), "u64": ("decimal(20,0)", 64)}
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"


def _checked(ok: Column, value: Column, text: Column, kind: str, on_error: str) -> Column:
    bad = F.lit(None) if on_error == "null" else F.raise_error(F.concat(F.lit(f"{kind}: "), text))
    return F.when(text.isNull(), None).when(ok, value).otherwise(bad)


def integer(text: Column, kind: str = "long", on_error: str = "fail") -> Column:
    """``byte short int long`` with an optional sign, ``u8 u16 u32 u64`` with an optional plus.

    Unsigned types come as the next wider signed one, u64 as DECIMAL(20,0).
    """
    unsigned = kind in _UNSIGNED
    spark, bits = (_UNSIGNED if unsigned else _SIGNED)[kind]
    # digits that can't leave the range are cast at once; the rest is looked at more closely
    few = len(str(2 ** (bits - 1))) - 1
    return F.when(text.rlike(rf"^[0-9]{{1,{few}}}\z"), text.try_cast(spark)).otherwise(_wide_integer(text, unsigned, spark, bits, on_error))


def _wide_integer(text: Column, unsigned: bool, spark: str, bits: int, on_error: str) -> Column:
    form = text.rlike(r"^\+?[0-9]+\z" if unsigned else r"^[+-]?[0-9]+\z")
    # leading zeros don't count towards the range
    short = F.regexp_replace(text, r"^([+-]?)0+([0-9])", "$1$2")
    wide = F.when(form & (F.length(short) <= 21), short).try_cast("decimal(38,0)")
    low, high = (0, 2**bits - 1) if unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    fits = wide.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    value = F.when(fits, wide).cast(spark)
    if on_error == "null":
        return F.when(form & F.coalesce(fits, F.lit(False)), value)
    why = F.when(text == "", F.lit("EmptyField")).when(~form, F.lit("InvalidDigit")).otherwise(F.lit("OutOfRange"))
    return F.when(text.isNull(), None).when(form & F.coalesce(fits, F.lit(False)), value).otherwise(F.raise_error(F.concat(why, F.lit(": "), text)).cast(spark))


def floating(text: Column, kind: str = "double", on_error: str = "fail") -> Column:
    """The grammar of decimal floating point numbers, with inf, infinity and nan in either case."""
    low = F.lower(text)
    spelt = F.regexp_replace(F.regexp_replace(low, "^([+-]?)inf(inity)?$", "$1Infinity"), "^[+-]?nan$", "NaN")
    return _checked(text.rlike(FLOAT), F.when(text.rlike(FLOAT), spelt).try_cast(kind), text, "InvalidValue", on_error)


def boolean(text: Column, on_error: str = "fail") -> Column:
    """Exactly true, false, 1 or 0."""
    return _checked(text.isin("true", "false", "1", "0"), text.isin("true", "1"), text, "InvalidValue", on_error)


def character(text: Column, on_error: str = "fail") -> Column:
    return _checked(F.char_length(text) == 1, text, text, "InvalidValue", on_error)


def big_integer(text: Column, bits: int = 128, unsigned: bool = False, on_error: str = "fail") -> Column:
    """Integers that no Spark type holds: the validated digits as text, without sign or zeros in front."""
    form = text.rlike(r"^\+?[0-9]+\z" if unsigned else r"^[+-]?[0-9]+\z")
    negative = text.startswith("-")
    digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]", ""), r"^0+(?=[0-9])", "")
    high, low = (2**bits - 1, 0) if unsigned else (2 ** (bits - 1) - 1, 2 ** (bits - 1))
    within = lambda top: (F.length(digits) < len(str(top))) | ((F.length(digits) == len(str(top))) & (digits <= str(top)))
    ok = form & F.when(negative, within(low)).otherwise(within(high))
    return _checked(ok, F.concat(F.when(negative & (digits != "0"), "-").otherwise(""), digits), text, "OutOfRange", on_error)


def utf8(raw: Column, on_error: str = "fail") -> Column:
    """Bytes as text: validated, or NULL, or (``lossy``) with replacement characters."""
    if on_error == "lossy":
        return F.make_valid_utf8(raw.cast("string"))
    ok = F.is_valid_utf8(raw.cast("string"))
    if on_error == "null":
        return F.when(ok, raw.cast("string"))
    return F.when(raw.isNull() | ok, raw.cast("string")).otherwise(F.raise_error(F.lit("InvalidUtf8")).cast("string"))


def address(text: Column, on_error: str = "fail") -> Column:
    """An IPv4 address: four decimal parts up to 255 without zeros in front."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return _checked(text.rlike(rf"^{part}(\.{part}){{3}}\z"), text, text, "InvalidValue", on_error)


def decoded(text: Column, kind: str | T.DataType, *, optional: bool = False, empty: str = "null", default: object = None, on_error: str = "fail") -> Column:
    """A field by the name of its type.  ``default``: the value of an empty or absent field."""
    name = kind if isinstance(kind, str) else {"tinyint": "byte", "smallint": "short", "bigint": "long"}.get(kind.simpleString(), kind.simpleString())
    name = {"bigint": "long", "smallint": "short", "tinyint": "byte", "integer": "int"}.get(name, name)
    given = F.when(text != "", text) if (default is not None or (optional and empty == "null" and name != "binary")) else text
    if name in _SIGNED or name in _UNSIGNED:
        out = integer(given, name, on_error)
    elif name in ("float", "double"):
        out = floating(given, name, on_error)
    elif name == "boolean":
        out = boolean(given, on_error)
    elif name == "char":
        out = character(given, on_error)
    elif name in ("i128", "u128"):
        out = big_integer(given, 128, name[0] == "u", on_error)
    elif name == "ip":
        out = address(given, on_error)
    elif name == "string":
        out = given
    else:
        out = given.cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default))
