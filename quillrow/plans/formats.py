"""Dialects of delimited text: what separates, quotes, escapes and ends, and what stands for NULL."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from .errors import configuration

BOM = b"\xef\xbb\xbf"


class Quoting(Enum):
    NECESSARY = "necessary"
    ALWAYS = "always"
    NEVER = "never"
    NON_NUMERIC = "non_numeric"
    RAW = "raw"


class Nulls(Enum):
    NONE = "none"
    POSTGRES_CSV = "postgres_csv"
    MYSQL = "mysql"


class ReadBom(Enum):
    DETECT = "detect"
    PRESERVE = "preserve"
    REJECT = "reject"


@dataclass(frozen=True)
class Escape:
    """``style``: double_quote, backslash (within quotes), mysql, or unquoted (anywhere)."""

    style: str = "double_quote"
    byte: bytes = b""

    @property
    def anywhere(self) -> bytes:
        """The escape byte, where it also works outside quotes."""
        return self.byte if self.style in ("mysql", "unquoted") else b""


DOUBLE_QUOTE = Escape()
MYSQL_ESCAPE = Escape("mysql", b"\\")


def backslash(byte: bytes = b"\\") -> Escape:
    return Escape("backslash", byte)


def unquoted(byte: bytes = b"\\") -> Escape:
    return Escape("unquoted", byte)


@dataclass(frozen=True)
class Recovery:
    """Relaxations of the strict syntax.  ``Recovery()`` turns quoting off altogether."""

    quoting: bool = False
    unquoted_quotes: bool = False
    any_backslash_escape: bool = False
    trailing_whitespace_after_quote: bool = False


STRICT = Recovery(quoting=True)
#: Record endings: a newline (LF, or CRLF), strictly CRLF, or any sequence of one to four bytes.
NEWLINE, CRLF = "newline", "crlf"


@dataclass(frozen=True)
class Whitespace:
    """Which fields are trimmed of ASCII whitespace."""

    fields: bool = False
    headers: bool = False
    quoted: bool = True

    def unquoted_only(self) -> Whitespace:
        return replace(self, quoted=False)

    def applies(self, header: bool, quoted: bool) -> bool:
        return (self.headers if header else self.fields) and (self.quoted or not quoted)


TRIM_NONE, TRIM_FIELDS, TRIM_HEADERS, TRIM_ALL = Whitespace(), Whitespace(fields=True), Whitespace(headers=True), Whitespace(True, True)


@dataclass(frozen=True)
class Format:
    delimiter: bytes = b","
    quote: bytes = b'"'
    record_ending: str | bytes = NEWLINE
    escape: Escape = DOUBLE_QUOTE
    comment: bytes = b""
    trim: Whitespace = TRIM_NONE
    skip_blank_records: bool = False
    read_bom: ReadBom = ReadBom.DETECT
    write_bom: bool = False
    syntax: Recovery = STRICT
    nulls: Nulls = Nulls.NONE
    quoting: Quoting = Quoting.NECESSARY
    skip_initial_space: bool = False

    def __post_init__(self) -> None:
        if reason := self.invalidity():
            raise configuration(reason)

    def but(self, **changes) -> Format:
        return replace(self, **changes)

    @property
    def ending(self) -> bytes:
        """The bytes that end a written record."""
        return {NEWLINE: b"\n", CRLF: b"\r\n"}.get(self.record_ending, self.record_ending)

    @property
    def lead(self) -> bytes:
        """The byte by which a reader finds a record's end."""
        return b"\n" if self.record_ending in (NEWLINE, CRLF) else self.record_ending[:1]

    def invalidity(self) -> str | None:
        single = {"quote": self.quote, "delimiter": self.delimiter[:1], "ending": self.lead}
        if len(self.quote) != 1:
            return "quote must be one byte"
        if not 1 <= len(self.delimiter) <= 4 or not 1 <= len(self.ending) <= 4:
            return "a delimiter or record ending must be one to four bytes"
        if self.delimiter[:1] == self.quote:
            return "delimiter and quote must differ"
        if self.lead in (self.delimiter[:1], self.quote) or (self.record_ending == CRLF and b"\r" in (self.delimiter[:1], self.quote)):
            return "record ending must differ from delimiter and quote"
        if self.escape.byte and self.escape.byte in single.values():
            return "escape must differ from structural bytes"
        if self.comment and (self.comment in (*single.values(), self.escape.anywhere) or (self.record_ending == CRLF and self.comment == b"\r")):
            return "comment must differ from structural bytes"
        own = self.escape.byte or self.quote
        tails = self.delimiter[1:] + (self.record_ending[1:] if isinstance(self.record_ending, bytes) else b"")
        if self.quote in tails or own in tails:
            return "a separator must hold neither quote nor escape"
        if self.escape.anywhere and self.quoting is not Quoting.NEVER:
            return "escaping outside quotes needs Quoting.NEVER"
        if not self.syntax.quoting and self.quoting in (Quoting.NECESSARY, Quoting.ALWAYS, Quoting.NON_NUMERIC):
            return "output with quotes needs a syntax with quotes"
        if self.nulls is Nulls.POSTGRES_CSV and (self.escape.anywhere or not self.syntax.quoting or self.quoting in (Quoting.NEVER, Quoting.RAW)):
            return "PostgreSQL NULLs need quotes that protect empty fields"
        if self.nulls is Nulls.MYSQL and (self.quoting is Quoting.RAW or (self.quoting is Quoting.NEVER and not self.escape.anywhere)):
            return "MySQL NULLs need quoting or escaping outside quotes"
        return None

    def unsplittable(self) -> str | None:
        """Why a document can't be cut by counting quotes (or, where nothing is quoted, escapes), if so."""
        for bad, why in (
            (self.comment, "comments"),
            (self.escape.style != "double_quote" and self.syntax.quoting, "quotes and an escape other than doubled quotes"),
            (len(self.delimiter) > 1 or (isinstance(self.record_ending, bytes) and len(self.record_ending) > 1), "separators of several bytes"),
            (self.syntax.unquoted_quotes, "bare quotes in unquoted fields"),
            (self.skip_blank_records, "blank records skipped"),
        ):
            if bad:
                return f"a format with {why} can't be split"
        return None


CSV = Format()
TSV = Format(delimiter=b"\t")
SEMICOLON = Format(delimiter=b";")
PIPE = Format(delimiter=b"|")
BACKSLASH_CSV = Format(escape=backslash())
BACKSLASH_TSV = Format(delimiter=b"\t", escape=backslash())
COMMENTED_CSV = Format(comment=b"#", skip_blank_records=True)
TRIMMED_CSV = Format(trim=TRIM_ALL)
PYTHON_CSV = Format(skip_initial_space=True)
PYTHON_ESCAPED = Format(escape=unquoted(), quoting=Quoting.NEVER)
RFC4180 = Format(record_ending=CRLF, read_bom=ReadBom.REJECT)
EXCEL = Format(record_ending=CRLF, write_bom=True)
POSTGRES_COPY_CSV = Format(nulls=Nulls.POSTGRES_CSV)
MYSQL = Format(delimiter=b"\t", escape=MYSQL_ESCAPE, syntax=Recovery(), nulls=Nulls.MYSQL, quoting=Quoting.NEVER)

PRESETS: dict[str, Format] = {
    "csv": CSV,
    "tsv": TSV,
    "semicolon": SEMICOLON,
    "pipe": PIPE,
    "backslash_csv": BACKSLASH_CSV,
    "backslash_tsv": BACKSLASH_TSV,
    "commented_csv": COMMENTED_CSV,
    "trimmed_csv": TRIMMED_CSV,
    "python_csv": PYTHON_CSV,
    "python_escaped": PYTHON_ESCAPED,
    "rfc4180": RFC4180,
    "excel": EXCEL,
    "postgres_copy_csv": POSTGRES_COPY_CSV,
    "mysql": MYSQL,
}


def register_format(name: str, fmt: Format) -> Format:
    """Give a format of one's own a name for ``format(name)`` options."""
    PRESETS[name] = fmt
    return fmt
