"""Records written one at a time, with the pending bytes in hand: for drivers, tasks and sinks of one's own.

DataFrames are better written through ``functions.encode``, which needs no Python; this is the same
text for callers that have values and not rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.encode import _field_bytes, _record_bytes
from ..plans.errors import Kind, QuillError
from ..plans.formats import BOM, CSV, Format, Quoting
from ..plans.options import FLEXIBLE, MATCH_FIRST, EmitOptions


class Emitter:
    """Collects encoded records until they are taken.  After a failed write it refuses all others, since
    what went out before can't be taken back; a record that is cancelled leaves nothing."""

    def __init__(self, fmt: Format = CSV, options: EmitOptions | None = None) -> None:
        self.fmt, self.options = fmt, options or EmitOptions()
        self._out = bytearray(BOM if fmt.write_bom else b"")
        self._record: list[bytes | None] | None = None
        own = self.options.field_count
        self._width = own if isinstance(own, int) else None
        self.failed = False
        self.records = 0

    def _alive(self) -> None:
        if self.failed:
            raise QuillError(Kind.EMITTER_FAILED)

    def begin_record(self) -> None:
        self._alive()
        if self._record is not None:
            raise QuillError(Kind.ENCODE, "a record is open")
        self._record = []

    def write_field(self, value: bytes | str | None) -> None:
        """A field of the open record; None is NULL.  A field that can't be written fails the record alone."""
        self._alive()
        if self._record is None:
            raise QuillError(Kind.ENCODE, "no record is open")
        raw = value.encode() if isinstance(value, str) else value
        if self.fmt.quoting is Quoting.NEVER:
            _field_bytes(raw, self.fmt, not self._record)
        self._record.append(raw)

    def write_null(self) -> None:
        self.write_field(None)

    def cancel(self) -> None:
        self._alive()
        self._record = None

    def finish_record(self) -> int:
        """The record's length in bytes, once it is among the pending ones."""
        self._alive()
        if self._record is None:
            raise QuillError(Kind.ENCODE, "no record is open")
        fields, self._record = self._record, None
        if self._width is None and self.options.field_count == MATCH_FIRST:
            self._width = len(fields)
        if self._width is not None and self.options.field_count != FLEXIBLE and len(fields) != self._width:
            raise QuillError(Kind.FIELD_COUNT_MISMATCH, f"{len(fields)} fields, {self._width} expected")
        line = _record_bytes(fields, self.fmt) if fields else self.fmt.ending
        self._out += line
        self.records += 1
        return len(line)

    def emit(self, values: Iterable[bytes | str | None]) -> int:
        self.begin_record()
        try:
            for v in values:
                self.write_field(v)
        except QuillError:
            self._record = None
            raise
        return self.finish_record()

    @property
    def pending(self) -> int:
        return len(self._out)

    def take(self) -> bytes:
        """The pending bytes, which are then no longer pending."""
        self._alive()
        out, self._out = bytes(self._out), bytearray()
        return out

    def flush_to(self, sink) -> int:
        """Write the pending bytes to an object with ``write``; an error there poisons the emitter."""
        body = self.take()
        try:
            sink.write(body)
        except Exception as error:
            self.failed = True
            raise QuillError(Kind.IO, str(error)) from error
        return len(body)
