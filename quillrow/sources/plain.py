"""Blocks in which every separator is structural, split by Arrow's own reader.

A block without quotes and escapes, with one kind of record ending and no blank lines, needs no rule
but the separators'.  Arrow splits it and makes the wanted columns alone.  Whatever this can't vouch
for (ragged or overlong records, text that isn't UTF-8) gives ``None``, and the block is read by
``vector`` or ``parser``, which know every rule and name every error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv

from ..plans.formats import CRLF, NEWLINE, Format, Nulls
from ..plans.options import MATCH_FIRST, ParseOptions
from .blocks import LOCATION, Wanted, matches
from .vector import supported

#: A predicate's literal is looked for in whole blocks until so many of the last blocks had it.
_PATIENCE = 4


@dataclass
class Plain:
    """A reader for the blocks of one part.  ``expected``: the width that records must have, if any."""

    fmt: Format
    options: ParseOptions
    wanted: Wanted
    expected: int | None = None

    def __post_init__(self) -> None:
        self.able = supported(self.fmt) and self.fmt.record_ending in (NEWLINE, CRLF) and self.wanted.columns is not None
        self.misses = 0
        self.readers: dict[int, tuple] = {}
        self.kept: np.ndarray | None = None  # which records the last rows are, None: all

    def _reader(self, width: int) -> tuple:
        if width not in self.readers:
            w = self.wanted
            names = [str(i) for i in range(width)]
            used = sorted({*w.columns, *([w.at] if w.at is not None else [])}) or [0]
            kinds = {str(i): pa.string() if w.text and i in w.columns else pa.binary() for i in used}
            null = self.fmt.nulls is Nulls.POSTGRES_CSV
            self.readers[width] = (
                csv.ReadOptions(use_threads=False, column_names=names, block_size=1 << 30),
                csv.ParseOptions(delimiter=self.fmt.delimiter.decode("latin-1"), quote_char=False, double_quote=False, newlines_in_values=False, ignore_empty_lines=False),
                csv.ConvertOptions(column_types=kinds, include_columns=[str(i) for i in used], strings_can_be_null=null, null_values=[""] if null else []),
                used,
            )
        return self.readers[width]

    def read(self, data: bytes, offset: int, line: int, record: int) -> tuple[pa.RecordBatch | None, int] | None:
        """(the wanted rows, or None without any; the number of records), or None if the block isn't plain."""
        fmt, limits, w = self.fmt, self.options.limits, self.wanted
        if not self.able or not data or (fmt.syntax.quoting and fmt.quote in data) or (fmt.escape.style != "double_quote" and fmt.escape.byte in data):
            return None
        returns = data.count(b"\r")
        if returns and returns != data.count(b"\r\n") or data[:1] in b"\r\n" or b"\n\n" in data or returns and b"\n\r" in data:
            return None
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if fmt.record_ending == CRLF and returns != len(ends):
            return None
        n = len(ends) + (not data.endswith(b"\n"))
        start = np.concatenate([[0], ends[: n - 1] + 1])
        if np.diff(np.append(start, len(data))).max() > min(limits.record_bytes, limits.field_bytes):
            return None
        width = data.count(fmt.delimiter, 0, int(ends[0]) if len(ends) else len(data)) + 1
        if width > limits.fields or max([*w.columns, w.at or 0], default=0) >= width:
            return None
        if self.expected is not None and width != self.expected:
            return None
        free = self.expected is None and self.options.field_count != MATCH_FIRST
        self.kept = np.zeros(0, np.int64)
        if w.predicate is not None and free and w.predicate.literal and self.misses < _PATIENCE:
            if w.at is None or w.predicate.literal not in data:
                self.misses = 0
                return None, n
            self.misses += 1
        read, parse, convert, used = self._reader(width)
        try:
            table = csv.read_csv(pa.BufferReader(data), read, parse, convert)
        except pa.ArrowInvalid:
            return None
        if table.num_rows != n:
            return None
        columns = dict(zip(used, (c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns)))
        keep = None
        if w.predicate is not None:
            if w.at is None:
                return None, n
            hit = matches(w.predicate, pc.fill_null(columns[w.at].cast(pa.binary()), b""))
            keep = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if not len(keep):
                return None, n
            keep = None if len(keep) == n else keep
        self.kept = keep
        out = [columns[c] if keep is None else columns[c].take(pa.array(keep)) for c in w.columns]
        if w.location:
            rows = np.arange(n) if keep is None else keep
            out.append(pa.StructArray.from_arrays([pa.array(start[rows] + offset), pa.array(rows + line), pa.array(rows + record), pa.array(np.zeros(len(rows), np.int64))], fields=list(LOCATION)))
        if not out:  # a scan of no columns still has its rows
            return None
        return pa.RecordBatch.from_arrays(out, schema=w.schema()), n
