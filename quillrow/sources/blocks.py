"""Parsed blocks as Arrow batches: raw fields, or chosen columns, with predicate and location."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..plans.errors import Kind, Location, QuillError
from ..plans.formats import BOM, Format, ReadBom
from ..plans.options import ParseOptions
from ..plans.predicate import Predicate
from . import vector
from .parser import Parser

LOCATION = pa.struct([("byte", pa.int64()), ("line", pa.int64()), ("record", pa.int64()), ("field", pa.int64())])


@dataclass(frozen=True)
class Wanted:
    """What a scan returns.  ``columns``: positions (None: all fields as one array)."""

    columns: tuple[int, ...] | None = None
    names: tuple[str, ...] = ()
    predicate: Predicate | None = None
    at: int | None = None  # the predicate's column; None: an unknown header, which matches nothing
    text: bool = True  # fields as validated UTF-8 text, else as bytes
    location: bool = False
    extra: tuple[str, ...] = field(default=())

    def schema(self) -> pa.Schema:
        kind = pa.string() if self.text else pa.binary()
        fields = [pa.field("fields", pa.list_(kind))] if self.columns is None else [pa.field(n, kind) for n in self.names]
        return pa.schema(fields + ([pa.field("_loc", LOCATION)] if self.location else []))


@dataclass
class Fields:
    """Values of all fields of some records, as one Arrow array."""

    values: pa.Array  # binary
    records: np.ndarray
    start: np.ndarray
    line: np.ndarray
    first_record: int


def read_block(data: bytes | np.ndarray, fmt: Format, options: ParseOptions, *, offset: int = 0, line: int = 1, record: int = 0, expected: int | None = None, first: bool = False) -> tuple[Fields, QuillError | None]:
    """All records of a block up to its first error, if any."""
    array = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
    skip = 0
    if first and fmt.read_bom is not ReadBom.PRESERVE and array[:3].tobytes() == BOM:
        if fmt.read_bom is ReadBom.REJECT:
            return _gathered([], 0), QuillError(Kind.REJECTED_BOM, "", Location(offset, line, record, 0))
        skip = 3
    expected = options.expected() if expected is None else expected
    block = vector.parse(array[skip:], fmt, options, expected)
    if block is not None:
        if len(block.values) < 1 << 31:
            values = pa.Array.from_buffers(pa.binary(), len(block.offsets) - 1, [_bitmap(block.null), pa.py_buffer(block.offsets.astype(np.int32)), pa.py_buffer(block.values)])
            return Fields(values, block.records, block.start + offset + skip, block.line + line, record), None
    parser = Parser(bytes(data) if not isinstance(data, bytes) else data, fmt, options, offset=offset, line=line, record=record, expected=expected, first=first)
    rows = []
    try:
        rows.extend(parser)
    except QuillError as error:
        return _gathered(rows, record), error
    return _gathered(rows, record), None


def _bitmap(null: np.ndarray | None) -> pa.Buffer | None:
    return None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))


def _gathered(rows: list, record: int) -> Fields:
    return Fields(
        pa.array([v for r in rows for v in r.fields], pa.binary()),
        np.concatenate([[0], np.cumsum([len(r.fields) for r in rows], dtype=np.int64)]).astype(np.int64),
        np.array([r.start for r in rows], np.int64),
        np.array([r.line for r in rows], np.int64),
        record,
    )


def _column(f: Fields, at: int) -> pa.Array:
    """The field at a position of every record, null where a record is shorter."""
    place = f.records[:-1] + at
    short = place >= f.records[1:]
    return f.values.take(pa.array(np.where(short, 0, place), mask=short) if short.any() else pa.array(place))


def matches(p: Predicate, value: pa.Array) -> pa.Array:
    """The predicate on a column of bytes."""
    import pyarrow.compute as pc

    return {
        "equals": lambda: pc.equal(value, p.literal),
        "contains": lambda: pc.match_substring(value, p.literal),
        "starts_with": lambda: pc.starts_with(value, p.literal),
        "ends_with": lambda: pc.ends_with(value, p.literal),
    }[p.kind]()


def _matching(f: Fields, p: Predicate, at: int | None) -> np.ndarray:
    import pyarrow.compute as pc

    n = len(f.records) - 1
    if at is None:
        return np.zeros(n, bool)
    test = matches(p, pc.fill_null(_column(f, at), b""))
    return test.to_numpy(zero_copy_only=False).astype(bool) & (np.diff(f.records) > at)


def text_of(values: pa.Array, f: Fields | None = None) -> pa.Array:
    """Bytes as text; the first field that isn't UTF-8 is an error."""
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        for i, v in enumerate(values.to_pylist()):
            try:
                (v or b"").decode()
            except UnicodeDecodeError as error:
                raise QuillError(Kind.INVALID_UTF8, f"value {i}: {error.reason} at byte {error.start}") from None
        raise


def batch(f: Fields, wanted: Wanted) -> tuple[pa.RecordBatch, np.ndarray]:
    """The chosen rows and columns, and which records they are."""
    n = len(f.records) - 1
    keep = np.arange(n)
    if wanted.predicate is not None:
        keep = np.flatnonzero(_matching(f, wanted.predicate, wanted.at))
    rows = None if len(keep) == n else pa.array(keep)
    columns = []
    if wanted.columns is None:
        values = text_of(f.values, f) if wanted.text else f.values
        whole = pa.ListArray.from_arrays(pa.array(f.records, pa.int32()), values)
        columns.append(whole if rows is None else whole.take(rows))
    else:
        for at in wanted.columns:
            c = _column(f, at)
            c = c if rows is None else c.take(rows)
            columns.append(text_of(c) if wanted.text else c)
    if wanted.location:
        columns.append(pa.StructArray.from_arrays([pa.array(f.start[keep]), pa.array(f.line[keep]), pa.array(keep + f.first_record), pa.array(np.zeros(len(keep), np.int64))], fields=list(LOCATION)))
    return pa.RecordBatch.from_arrays(columns, schema=wanted.schema()), keep
