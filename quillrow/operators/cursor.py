"""One document read record by record on the driver: to look at it, not to process it."""

from __future__ import annotations

from ..plans.errors import Kind, Location, QuillError
from ..plans.formats import CSV, Format
from ..plans.options import ParseOptions
from ..sources import files
from ..sources.parser import Record
from ..streaming.push import PushParser

_WINDOW = 1 << 16


class Cursor:
    """Reads a file in windows.  ``headers`` are taken off the front unless the options say otherwise."""

    def __init__(self, path: str, fmt: Format = CSV, options: ParseOptions | None = None, window: int = _WINDOW) -> None:
        self.path, self.fmt, self.options, self.window = path, fmt, options or ParseOptions(), window
        self.size = files.size(path)
        own = self.options.headers
        self._names: list[str] | None = list(own) if isinstance(own, tuple) else None
        self.rewind()

    def rewind(self) -> None:
        """To the first record; what an error stopped can be read again up to it."""
        self._start(Location())
        if self.options.headers is True:
            first = self._next()
            if first is not None and self._names is None:
                self._names = [(v or b"").decode() for v in first.fields]

    def _start(self, at: Location) -> None:
        self._push = PushParser(self.fmt, ParseOptions(headers=False, field_count=self.options.field_count, limits=self.options.limits))
        self._push.offset, self._push.line, self._push.record = at.byte, at.line, at.record
        self._push.begun = at.byte > 0
        self._at, self._held, self._ended, self._error = at.byte, [], False, None
        self._place = at

    @property
    def headers(self) -> list[str] | None:
        return self._names

    def has_headers(self) -> bool:
        return self._names is not None

    def set_headers(self, names: list[str]) -> None:
        """Other names for the columns; none of the records is taken for them."""
        self._names = list(names)

    def header_index(self, name: str) -> int | None:
        return self._names.index(name) if self._names and name in self._names else None

    def _next(self) -> Record | None:
        while not self._held and not self._ended and self._error is None:
            body = files.read(self.path, self._at, min(self.window, self.size - self._at)) if self._at < self.size else b""
            self._at += len(body)
            try:
                self._held = self._push.chunk(body) if body else self._push.finish()
                self._error = self._push.error
            except QuillError as error:
                self._error = error
            self._ended = not body
        if self._held:
            record = self._held.pop(0)
            self._place = Location(record.start, record.line, record.index)
            return record
        if self._error is not None:
            raise self._error
        return None

    def next(self) -> Record | None:
        """The next record, None at the end; an error is raised once the records before it are out."""
        return self._next()

    def __iter__(self):
        while (record := self._next()) is not None:
            yield record

    @property
    def location(self) -> Location:
        """Where the last record began."""
        return self._place

    def is_done(self) -> bool:
        """Whether there is no other record; reads on to know it."""
        if self._held or self._error is not None:
            return False
        record = None
        place = self._place
        try:
            record = self._next()
        except QuillError:
            return False
        if record is not None:
            self._held.insert(0, record)
            self._place = place
        return record is None

    def seek(self, index, record: int) -> None:
        """To a record by an index of the document, which must be of these bytes."""
        index.validate(self.path)
        self.seek_raw(Location(index.record_offset(record), index.record_line(record), record))

    def seek_raw(self, at: Location) -> None:
        """To where a record begins, by the caller's word."""
        if not 0 <= at.byte <= self.size:
            raise QuillError(Kind.RECORD_OUT_OF_RANGE, f"byte {at.byte} of {self.size}")
        self._start(at)
