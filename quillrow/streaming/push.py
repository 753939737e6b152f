"""A parser that is given bytes as they come and returns the records that are complete.

However the bytes are cut, the records, their places and the first error are those of the whole.
"""

from __future__ import annotations

from ..plans.errors import Kind, Location, QuillError
from ..plans.formats import BOM, CSV, Format
from ..plans.options import MATCH_FIRST, ParseOptions
from ..sources.parser import NeedMore, Parser, Record


class PushParser:
    def __init__(self, fmt: Format = CSV, options: ParseOptions | None = None) -> None:
        self.fmt, self.options = fmt, options or ParseOptions(headers=False)
        self.reset()

    def reset(self) -> None:
        """Ready for another document."""
        self.rest = b""
        self.offset, self.line, self.record = 0, 1, 0
        self.expected = self.options.expected()
        self.begun = self.done = False
        self.error: QuillError | None = None

    def state(self) -> tuple:
        """What the next chunk needs to know, as plain values."""
        return self.rest, self.offset, self.line, self.record, self.expected, self.begun, self.error is not None

    def restore(self, state: tuple) -> PushParser:
        self.rest, self.offset, self.line, self.record, self.expected, self.begun, failed = state
        self.error = QuillError(Kind.PARSER_FAILED) if failed else None
        return self

    def chunk(self, data: bytes) -> list[Record]:
        """The records that ``data`` completes; raises the first error once those before it are out."""
        return self._read(data, final=False)

    def finish(self) -> list[Record]:
        """The unterminated record at the end, if there is one."""
        records = self._read(b"", final=True)
        self.done = True
        return records

    @property
    def is_done(self) -> bool:
        """Whether the document's end has been read, or an error after which nothing is."""
        return self.done or self.error is not None

    def _read(self, data: bytes, final: bool) -> list[Record]:
        if self.error is not None:
            raise QuillError(Kind.PARSER_FAILED, "", Location(self.offset, self.line, self.record, 0))
        body = self.rest + data
        if not self.begun and not final and len(body) < 3 and BOM.startswith(body):
            self.rest = body
            return []
        out: list[Record] = []
        try:
            parser = Parser(body, self.fmt, self.options, offset=self.offset, line=self.line, record=self.record, expected=self.expected, first=not self.begun, final=final)
        except QuillError as error:
            self.error = error
            raise
        self.begun = True
        good = parser.at
        try:
            while True:
                before = parser.at
                record = parser.next()
                if record is None:
                    # a comment or blank line at the end may still go on
                    good = before if not final and parser.at >= len(body) and parser.at > before else parser.at
                    break
                if not final and (not parser.terminated or parser.at > len(body) - self._ahead()):
                    break
                out.append(record)
                good = parser.at
        except NeedMore:
            pass
        except QuillError as error:
            # an error at the very end may be an unfinished record; one before it is certain
            if final or not self._open(error, body):
                self.error = error
                if out:
                    self.pending = error
                else:
                    raise
        self._keep(body, good)
        self.record = out[-1].index + 1 if out else self.record
        if self.options.field_count == MATCH_FIRST and self.expected is None and out:
            self.expected = len(out[0].fields)
        return out

    def _ahead(self) -> int:
        return 0

    def _open(self, error: QuillError, body: bytes) -> bool:
        """Whether more bytes could still make the record whole."""
        if error.kind == Kind.UNTERMINATED_QUOTED_FIELD:
            return True
        at = error.location.byte - self.offset
        tail = len(body) - at
        if error.kind in (Kind.UNEXPECTED_BYTE_AFTER_QUOTE, Kind.INVALID_RECORD_ENDING, Kind.INVALID_ESCAPE):
            longest = max(len(self.fmt.delimiter), len(self.fmt.ending), 2)
            return tail < longest and any(s.startswith(body[at:]) for s in (self.fmt.delimiter, self.fmt.ending, b"\r\n")) or at >= len(body) - 1 and error.kind == Kind.INVALID_ESCAPE
        return error.kind == Kind.FIELD_COUNT_MISMATCH and at >= len(body) and not body.endswith(self.fmt.ending)

    def _keep(self, body: bytes, good: int) -> None:
        self.line += body.count(b"\n", 0, good)
        self.offset += good
        self.rest = body[good:]
        limit = self.options.limits.record_bytes
        if len(self.rest) > limit + 1 and self.error is None:
            self.error = QuillError(Kind.RECORD_TOO_LARGE, f"at most {limit} bytes", Location(self.offset + limit, self.line, self.record, 0))
            raise self.error
