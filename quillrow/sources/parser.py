"""The record parser: every rule of a format, one field at a time.

It is the reference for the vectorised scan in ``vector`` and takes over where that one can't decide:
formats with escapes, comments or separators of several bytes, and documents with errors, whose kind
and place it names exactly.  It jumps between structural bytes with compiled searches, so plain
stretches cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..plans.errors import Kind, Location, QuillError
from ..plans.formats import BOM, CRLF, NEWLINE, Format, Nulls, ReadBom
from ..plans.options import MATCH_FIRST, ParseOptions

_MYSQL = {ord("0"): 0, ord("b"): 8, ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("Z"): 26}
_TRIM = b" \t\n\x0c\r"


@dataclass(slots=True)
class Record:
    fields: list[bytes | None]
    start: int
    end: int
    index: int
    line: int


class Parser:
    """Reads ``data`` from ``start``; offsets, lines and record numbers go on from those given."""

    def __init__(self, data: bytes, fmt: Format, options: ParseOptions, *, start: int = 0, stop: int | None = None, offset: int = 0, line: int = 1, record: int = 0, expected: int | None = None, first: bool = True, final: bool = True) -> None:
        self.data, self.fmt, self.options = data, fmt, options
        self.at = start
        #: Records that begin before ``stop`` are read, to their end.
        self.stop = len(data) if stop is None else stop
        self.offset, self.line, self.record = offset, line, record
        self._counted = start
        self.final = final
        self.failed = False
        self.expected = expected if expected is not None else options.expected()
        self.terminated = True
        escape = fmt.escape.anywhere
        stops = [fmt.delimiter[:1], fmt.lead]
        if fmt.record_ending == CRLF:
            stops.append(b"\r")
        if escape:
            stops.append(escape)
        self.reject_quotes = fmt.syntax.quoting and not fmt.syntax.unquoted_quotes
        if self.reject_quotes:
            stops.append(fmt.quote)
        self._stop = re.compile(b"[" + b"".join(map(re.escape, stops)) + b"]").search
        inner = fmt.quote + (fmt.escape.byte if fmt.escape.style != "double_quote" else b"")
        self._inner = re.compile(b"[" + b"".join(re.escape(inner[i : i + 1]) for i in range(len(inner))) + b"]").search
        if first:
            if fmt.read_bom is ReadBom.REJECT and data.startswith(BOM, start):
                raise self._error(Kind.REJECTED_BOM, start, 0)
            if fmt.read_bom is ReadBom.DETECT and data.startswith(BOM, start):
                self.at += 3

    # -- places ---------------------------------------------------------------------------------

    def _line_at(self, at: int) -> int:
        at = min(at, len(self.data))
        if at >= self._counted:
            self.line += self.data.count(b"\n", self._counted, at)
            self._counted = at
            return self.line
        return self.line - self.data.count(b"\n", at, self._counted)

    def _error(self, kind: str, at: int, field: int, detail: str = "") -> QuillError:
        self.failed = True
        return QuillError(kind, detail, Location(self.offset + at, self._line_at(at), self.record, field))

    # -- records --------------------------------------------------------------------------------

    def _ending_width(self, at: int) -> int:
        """The width of a record ending at this place, 0 if there is none."""
        data, ending = self.data, self.fmt.record_ending
        if ending == CRLF:
            return 2 if data.startswith(b"\r\n", at) else 0
        if ending == NEWLINE:
            return 1 if data.startswith(b"\n", at) else 2 if data.startswith(b"\r\n", at) else 0
        return len(ending) if data.startswith(ending, at) else 0

    def _skip_ignored(self) -> None:
        fmt, data = self.fmt, self.data
        moved = True
        while moved and self.at < len(data):
            moved = False
            while fmt.comment and data.startswith(fmt.comment, self.at):
                moved = True
                end = data.find(fmt.ending, self.at)
                self.at = len(data) if end < 0 else end + len(fmt.ending)
            while fmt.skip_blank_records and (width := self._ending_width(self.at)):
                moved = True
                self.at += width

    def next(self, header: bool = False) -> Record | None:
        """The next record, None at the end.  After an error every call raises ParserFailed."""
        if self.failed:
            raise QuillError(Kind.PARSER_FAILED, "", Location(self.offset + self.at, self._line_at(self.at), self.record, 0))
        if self.fmt.comment or self.fmt.skip_blank_records:
            self._skip_ignored()
        if self.at >= min(len(self.data), self.stop):
            return None
        start = self.at
        line = self._line_at(start)
        fields = self._fields(start, header)
        out = Record(fields, self.offset + start, self.offset + self.at, self.record, line)
        if self.options.field_count == MATCH_FIRST and self.expected is None:
            self.expected = len(fields)
        elif self.expected is not None and len(fields) != self.expected:
            raise self._error(Kind.FIELD_COUNT_MISMATCH, self.at, len(fields), f"{self.expected} fields are required, there are {len(fields)}")
        self.record += 1
        return out

    def __iter__(self) -> Iterator[Record]:
        while (r := self.next()) is not None:
            yield r

    def _fields(self, start: int, header: bool) -> list[bytes | None]:
        fmt, data, limits = self.fmt, self.data, self.options.limits
        fields: list[bytes | None] = []
        done = False
        while not done:
            if len(fields) >= limits.fields:
                raise self._error(Kind.TOO_MANY_FIELDS, self.at, len(fields), f"at most {limits.fields}")
            if fmt.skip_initial_space and self.at != start:
                while data.startswith(b" ", self.at):
                    self.at += 1
            quoted = fmt.syntax.quoting and data.startswith(fmt.quote, self.at)
            value, done = self._quoted(start, len(fields)) if quoted else self._unquoted(start, len(fields), header)
            if value is not None and fmt.trim.applies(header, quoted):
                value = value.strip(_TRIM)
            fields.append(value)
            if self.at - start > limits.record_bytes:
                raise self._error(Kind.RECORD_TOO_LARGE, start + limits.record_bytes, len(fields) - 1, f"at most {limits.record_bytes} bytes")
        return fields

    def _check(self, start: int, field_start: int, at: int, field: int) -> None:
        limits = self.options.limits
        record, own = start + limits.record_bytes, field_start + limits.field_bytes
        if at > min(record, own):
            kind, limit = (Kind.RECORD_TOO_LARGE, limits.record_bytes) if record <= own else (Kind.FIELD_TOO_LARGE, limits.field_bytes)
            raise self._error(kind, min(record, own), field, f"at most {limit} bytes")

    def _unquoted(self, start: int, field: int, header: bool) -> tuple[bytes | None, bool]:
        fmt, data, begin = self.fmt, self.data, self.at
        escape = fmt.escape.anywhere
        at, n = begin, len(data)
        while True:
            found = self._stop(data, at)
            if found is None:
                self._check(start, begin, n, field)
                self.at = n
                self.terminated = False
                return self._plain(data[begin:n], header), True
            at = found.start()
            self._check(start, begin, at, field)
            byte = data[at : at + 1]
            if byte == escape:
                at += 2
                if at > n:
                    at = n
                continue
            if self.reject_quotes and byte == fmt.quote:
                raise self._error(Kind.UNEXPECTED_QUOTE, at, field)
            if fmt.record_ending == CRLF and byte == b"\r":
                if not data.startswith(b"\n", at + 1):
                    if at + 1 == n and not self.final:
                        raise NeedMore
                    raise self._error(Kind.INVALID_RECORD_ENDING, at, field, "a bare carriage return")
                self.at = at + 2
                self.terminated = True
                return self._plain(data[begin:at], header), True
            if byte == fmt.lead:
                if fmt.record_ending == CRLF:
                    raise self._error(Kind.INVALID_RECORD_ENDING, at, field, "a bare line feed")
                if not data.startswith(fmt.ending, at):
                    at += 1
                    continue
                end = at - 1 if fmt.record_ending == NEWLINE and at > begin and data[at - 1] == 13 else at
                self.at = at + len(fmt.ending)
                self.terminated = True
                return self._plain(data[begin:end], header), True
            if not data.startswith(fmt.delimiter, at):
                at += 1
                continue
            self.at = at + len(fmt.delimiter)
            return self._plain(data[begin:at], header), False

    def _plain(self, raw: bytes, header: bool) -> bytes | None:
        fmt = self.fmt
        if not header and ((fmt.nulls is Nulls.MYSQL and raw == b"\\N") or (fmt.nulls is Nulls.POSTGRES_CSV and not raw)):
            return None
        escape = fmt.escape.anywhere
        if not escape or escape not in raw:
            return raw
        mysql = fmt.escape.style == "mysql"
        out, at = bytearray(), 0
        while (next_ := raw.find(escape, at)) >= 0:
            out += raw[at:next_]
            if next_ + 1 < len(raw):
                b = raw[next_ + 1]
                out.append(_MYSQL.get(b, b) if mysql else b)
                at = next_ + 2
            else:  # an escape with nothing after it is an ordinary byte
                out += escape
                at = next_ + 1
        return bytes(out + raw[at:])

    def _quoted(self, start: int, field: int) -> tuple[bytes, bool]:
        fmt, data = self.fmt, self.data
        quote, style, escape = fmt.quote, fmt.escape.style, fmt.escape.byte
        begin = at = segment = self.at + 1
        out = bytearray()
        while True:
            found = self._inner(data, at)
            if found is None:
                self._check(start, begin, len(data), field)
                raise self._error(Kind.UNTERMINATED_QUOTED_FIELD, len(data), field)
            at = found.start()
            self._check(start, begin, at, field)
            byte = data[at : at + 1]
            after = data[at + 1 : at + 2]
            if style == "double_quote" and after == quote:
                out += data[segment : at + 1]
            elif style != "double_quote" and byte == escape:
                if style == "backslash":
                    if not after:
                        raise self._error(Kind.INVALID_ESCAPE, at, field)
                    if after not in (quote, escape) and not fmt.syntax.any_backslash_escape:
                        raise self._error(Kind.INVALID_ESCAPE, at + 1, field)
                elif not after:
                    raise self._error(Kind.UNTERMINATED_QUOTED_FIELD, len(data), field)
                out += data[segment:at]
                out.append(_MYSQL.get(after[0], after[0]) if style == "mysql" else after[0])
            else:
                out += data[segment:at]
                return bytes(out), self._after_quote(start, at + 1, field)
            at += 2
            segment = at

    def _after_quote(self, start: int, at: int, field: int) -> bool:
        fmt, data = self.fmt, self.data
        if fmt.syntax.trailing_whitespace_after_quote:
            while at < len(data) and data[at] in b" \t" and not data.startswith(fmt.delimiter, at):
                at += 1
        if at >= len(data):
            self.at = at
            self.terminated = False
            return True
        if data.startswith(fmt.delimiter, at):
            self.at = at + len(fmt.delimiter)
            return False
        if fmt.record_ending != CRLF and data.startswith(fmt.ending, at):
            self.at = at + len(fmt.ending)
            self.terminated = True
            return True
        if fmt.record_ending in (NEWLINE, CRLF) and data.startswith(b"\r\n", at):
            self.at = at + 2
            self.terminated = True
            return True
        raise self._error(Kind.UNEXPECTED_BYTE_AFTER_QUOTE, at, field + 1, repr(data[at : at + 1]))


class NeedMore(Exception):
    """What is there could go on in more ways than one; more bytes will tell."""
