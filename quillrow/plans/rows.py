"""Row schemas: dataclasses whose fields say how columns are named, decoded and encoded.

    @row(rename_all="kebab-case")
    @dataclass
    class City:
        name: str
        population: int = column(kind="u32", alias=("inhabitants",), default=0)
"""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import decoded
from .errors import Kind, QuillError, configuration

_KINDS = {int: "long", float: "double", bool: "boolean", str: "string", bytes: "binary"}
_MARK = "quillrow"


def column(*, rename: str | None = None, alias: tuple[str, ...] = (), kind: str | None = None, default: Any = dataclasses.MISSING, skip: bool = False, parse: Callable[[Column], Column] | None = None, format: Callable[[Column], Column] | None = None) -> Any:
    """``rename``: its header; ``alias``: other headers it may have; ``kind``: a name that ``decoded``
    knows; ``default``: the value of empty or absent fields; ``skip``: not read or written;
    ``parse``/``format``: column functions of one's own."""
    if skip and (rename or alias or parse or format):
        raise configuration("a skipped field can't be renamed, aliased, parsed or formatted")
    if default is not dataclasses.MISSING and parse:
        raise configuration("a field with a parser of its own has no default")
    if len(set(alias)) != len(alias):
        raise configuration("an alias is given twice")
    own = {"rename": rename, "alias": alias, "kind": kind, "default": default, "skip": skip, "parse": parse, "format": format}
    return dataclasses.field(default=None if default is dataclasses.MISSING else default, metadata={_MARK: own})


def _words(name: str) -> list[str]:
    return [w for w in name.split("_") if w]


RULES: dict[str, Callable[[str], str]] = {
    "lowercase": str.lower,
    "UPPERCASE": str.upper,
    "snake_case": lambda n: n,
    "SCREAMING_SNAKE_CASE": str.upper,
    "kebab-case": lambda n: n.replace("_", "-"),
    "SCREAMING-KEBAB-CASE": lambda n: n.upper().replace("_", "-"),
    "PascalCase": lambda n: "".join(w[:1].upper() + w[1:] for w in _words(n)),
    "camelCase": lambda n: (lambda p: p[:1].lower() + p[1:])("".join(w[:1].upper() + w[1:] for w in _words(n))),
}


@dataclasses.dataclass(frozen=True)
class FieldPlan:
    name: str
    header: str
    aliases: tuple[str, ...]
    kind: str
    optional: bool
    default: Any
    parse: Callable[[Column], Column] | None
    format: Callable[[Column], Column] | None


@dataclasses.dataclass(frozen=True)
class RowSchema:
    fields: tuple[FieldPlan, ...]

    @property
    def headers(self) -> list[str]:
        return [f.header for f in self.fields]

    def positions(self, names: list[str] | None) -> list[int | None]:
        """Where each field stands: by name or alias, which must match one column; without headers by order."""
        if names is None:
            return list(range(len(self.fields)))
        found: list[int | None] = []
        for f in self.fields:
            at = [i for i, n in enumerate(names) if n == f.header or n in f.aliases]
            if len(at) > 1:
                raise QuillError(Kind.DECODE, "several columns match", name=f.header)
            if not at and f.default is dataclasses.MISSING and not f.optional:
                raise QuillError(Kind.DECODE, "no column matches", name=f.header)
            found.append(at[0] if at else None)
        return found

    def decode(self, df: DataFrame, fields: str = "fields", names: list[str] | None = None, *, empty: str = "null", on_error: str = "fail", keep: tuple[str, ...] = ()) -> DataFrame:
        """Typed columns from an array of text fields."""
        out = []
        for f, at in zip(self.fields, self.positions(names)):
            text = F.get(F.col(fields), F.lit(at)) if at is not None else F.lit(None).cast("string")
            if f.parse:
                value = f.parse(text)
            else:
                default = None if f.default is dataclasses.MISSING else f.default
                value = decoded(text, f.kind, optional=f.optional, empty=empty, default=default, on_error=on_error)
            out.append(value.alias(f.name))
        return df.select(*keep, *out)

    def encode(self, df: DataFrame) -> DataFrame:
        """Columns under their headers, in order, ready to be written."""
        return df.select(*[(f.format(F.col(f.name)) if f.format else F.col(f.name)).alias(f.header) for f in self.fields])


def schema_of(cls: type, rename_all: str | None = None) -> RowSchema:
    rule = RULES[rename_all] if rename_all else (lambda n: n)
    hints = typing.get_type_hints(cls)
    plans = []
    for f in dataclasses.fields(cls):
        own = f.metadata.get(_MARK, {})
        if own.get("skip"):
            continue
        kind, optional = hints[f.name], False
        args = [a for a in typing.get_args(kind) if a is not type(None)]
        if type(None) in typing.get_args(kind):
            kind, optional = args[0], True
        default = own.get("default", dataclasses.MISSING)
        plans.append(FieldPlan(f.name, own.get("rename") or rule(f.name), tuple(own.get("alias", ())), own.get("kind") or _KINDS.get(kind, "string"), optional, default, own.get("parse"), own.get("format")))
    claimed: dict[str, str] = {}
    for p in plans:
        for n in {p.header, *p.aliases}:
            if n in claimed:
                raise configuration(f"fields {claimed[n]} and {p.name} both claim column {n}")
            claimed[n] = p.name
    return RowSchema(tuple(plans))


def row(cls: type | None = None, *, rename_all: str | None = None):
    """Class decorator: adds ``quill_schema`` to a dataclass."""

    def mark(c: type) -> type:
        c = c if dataclasses.is_dataclass(c) else dataclasses.dataclass(c)
        c.quill_schema = schema_of(c, rename_all)
        return c

    return mark if cls is None else mark(cls)
