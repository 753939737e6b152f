"""Scans: delimited text, in files or in a column, as rows.

Predicate and columns are given to the scan itself, which applies them before any row leaves the
parser.  Every record is parsed and validated, those that the predicate drops too.

``on_error``: ``fail`` raises the first error of a part; ``prefix`` gives the rows before the
document's first error (see ``errors`` for the error itself).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import ERROR_TYPE, LOCATION_TYPE, Kind, QuillError
from ..plans.formats import BOM, CSV, Format
from ..plans.options import MATCH_FIRST, ParseOptions
from ..plans.predicate import Predicate
from ..plans.projection import resolve
from ..sources import files
from ..sources.blocks import Wanted, batch, read_block
from ..sources.parser import Parser
from ..sources.plain import Plain
from ..sources.split import HERE, Part, chunk_bytes, plan, record_ends

#: Bytes read at once within a part, and bytes parsed at once, which a core's cache should hold.
READ, BLOCK = 8 << 20, 1 << 20
#: Up to so many tasks carry their parts with them; the parts of more are a table.
CARRIED = 4096
#: Headers of up to so many files are read by the driver itself.
FEW = 64


def ddl(wanted: Wanted) -> str:
    kind = "string" if wanted.text else "binary"
    own = [f"fields array<{kind}>"] if wanted.columns is None else [f"`{n}` {kind}" for n in wanted.names]
    return ", ".join(own + ([f"_loc {LOCATION_TYPE}"] if wanted.location else []))


def wanted_of(names: list[str] | None, columns: list[int | str] | None, predicate: Predicate | None, text: bool, location: bool) -> Wanted:
    if columns is None and names is not None:
        at, labels = list(range(len(names))), _distinct(names)
    elif columns is not None:
        at = resolve(columns, names)
        labels = _distinct([c if isinstance(c, str) else (names[c] if names and c < len(names) else f"_c{c}") for c in columns])
    else:
        at = labels = None
    return Wanted(tuple(at) if at is not None else None, tuple(labels or ()), predicate, predicate.position(names) if predicate else None, text, location)


def _distinct(names: list[str]) -> list[str]:
    """Column names of duplicate headers get their position, as a DataFrame needs."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names):
        n = n if n not in seen else f"{n}_{i}"
        seen.add(n)
        out.append(n)
    return out


def read_headers(path: str, fmt: Format, options: ParseOptions) -> tuple[list[str] | None, int | None]:
    """The header names of a file (None: no headers, or none there), and its first record's width."""
    n = files.size(path)
    size = min(n, 1 << 16)
    while True:
        body = files.read(path, 0, size)
        try:
            parser = Parser(body, fmt, options)
            first = parser.next(header=options.headers is True)
            settled = first is None or size >= n or parser.terminated and parser.at < len(body)
        except QuillError:
            if size >= n:
                raise
            settled = False
        if settled:
            break
        size = min(n, size * 4)
    if first is None:
        return (list(options.headers) if isinstance(options.headers, tuple) else None), None
    if options.headers is True:
        return [(v or b"").decode() for v in first.fields], len(first.fields)
    return (list(options.headers) if isinstance(options.headers, tuple) else None), len(first.fields)


def parsed_part(part: Part, fmt: Format, options: ParseOptions, expected: int | None, read: int = READ, block: int = BLOCK) -> Iterator[tuple]:
    """(fields, error) of the blocks of a part, up to its first error; the header record included.

    Blocks are cut at the last record end that quote parity allows; a format that can't be cut so
    is parsed as one block.
    """
    begin, record, line, first = part.start, part.record, part.line, part.first
    for data in _blocks(part, fmt, read, block):
        fields, error = read_block(data, fmt, options, offset=begin, line=line, record=record, expected=expected, first=first)
        yield fields, error
        if error is not None:
            return
        if expected is None and options.field_count == MATCH_FIRST and len(fields.records) > 1:
            expected = int(fields.records[1] - fields.records[0])
        begin += len(data)
        record += len(fields.records) - 1
        line += data.count(b"\n")
        first = False


def part_batches(part: Part, fmt: Format, options: ParseOptions, expected: int | None, wanted: Wanted, header: bool = False, stop: int | None = None) -> Iterator[tuple[pa.RecordBatch | None, QuillError | None]]:
    """The wanted rows of a part, block by block, up to its first error or to records from ``stop`` on.

    ``header``: the part's first record, if it is the file's, isn't a row.
    """
    begin, record, line, first = part.start, part.record, part.line, part.first
    drop = header and first
    plain = Plain(fmt, options, wanted, expected)
    for data in _blocks(part, fmt, READ, BLOCK):
        if stop is not None and begin >= stop:
            return
        skip = data.find(b"\n") + 1 if drop else 0
        result = None
        if plain.able and not (first and data[:3] == BOM) and not (drop and not skip) and (stop is None or begin + len(data) <= stop):
            result = plain.read(data[skip:] if skip else data, begin + skip, line + drop, record + drop) if skip < len(data) else (None, 0)
            if result is not None and skip and (fmt.quote in data[:skip] or skip > options.limits.field_bytes):
                result = None
        if result is not None:
            rows, n = result
            n += drop
            if rows is not None:
                yield rows, None
        else:
            fields, error = read_block(data, fmt, options, offset=begin, line=line, record=record, expected=plain.expected, first=first)
            n = len(fields.records) - 1
            if plain.expected is None and options.field_count == MATCH_FIRST and n:
                plain.expected = int(fields.records[1] - fields.records[0])
            fields = _without_header(fields, drop)
            if stop is not None:
                fields = _before(fields, stop)
            if len(fields.records) > 1:
                yield batch(fields, wanted)[0], None
            if error is not None:
                yield None, error
                return
        begin += len(data)
        record += n
        line += data.count(b"\n")
        first = drop = False


def _blocks(part: Part, fmt: Format, read: int, block: int) -> Iterator[bytes]:
    """The part's bytes, cut at record ends."""
    if fmt.unsplittable():
        yield files.read(part.path, part.start, part.end - part.start)
        return
    at, held = part.start, b""
    while at < part.end or held:
        held += files.read(part.path, at, min(read, part.end - at))
        at = min(part.end, at + read)
        done, size = 0, block
        while done < len(held):
            last = at == part.end and done + size >= len(held)
            cut = len(held) - done if last else _last_end(held[done : done + size], fmt)
            if cut:
                yield held[done : done + cut]
                done, size = done + cut, block
            elif done + size >= len(held):
                break  # the record goes on in what is still to be read
            else:
                size *= 2
        held = held[done:]


def _last_end(data: bytes, fmt: Format) -> int:
    """Just after the last record end, 0 if there is none."""
    at = record_ends(data, fmt)[0]
    return int(at[-1]) + 1 if len(at) else 0


def _without_header(fields, drop: bool):
    """The block without its first record."""
    if not drop or len(fields.records) < 2:
        return fields
    n = int(fields.records[1])
    return replace(fields, values=fields.values.slice(n), records=fields.records[1:] - n, start=fields.start[1:], line=fields.line[1:], first_record=fields.first_record + 1)


@dataclass
class Document:
    """Files of one format with what the driver found out about them."""

    spark: SparkSession
    fmt: Format
    options: ParseOptions
    parts: list[Part]
    names: list[str] | None
    widths: dict[str, int | None]  # of the first record, for files that are cut

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str], fmt: Format = CSV, options: ParseOptions | None = None, small: int | None = None, chunk: int | None = None, here: int = HERE) -> Document:
        options = options or ParseOptions()
        parts = plan(spark, paths, fmt, small, chunk, here)
        if not parts:
            return cls(spark, fmt, options, [], None, {})
        names, width = read_headers(parts[0].path, fmt, options)
        widths = {parts[0].path: width}
        own = list(dict.fromkeys(p.path for p in parts))[1:]
        if own and (options.headers is True or options.field_count == MATCH_FIRST):
            cut = {p.path for p in parts if not p.first}
            for path, differs, wide in _other_headers(spark, own, cut, names, fmt, options):
                if differs:
                    raise QuillError(Kind.DECODE, f"headers of {path} differ")
                widths[path] = wide
        return cls(spark, fmt, options, parts, names, widths)

    def tasks(self) -> list[list[Part]]:
        """Parts in order, small ones together."""
        room = max(1, chunk_bytes(self.spark, sum(p.end - p.start for p in self.parts)))
        out: list[list[Part]] = []
        held = 0
        for p in self.parts:
            n = p.end - p.start
            if not out or held + n > room:
                out.append([])
                held = 0
            out[-1].append(p)
            held += n
        return out

    def _over_parts(self, each, schema: str) -> DataFrame:
        """``each(part)`` gives the batches of a part; tasks go in the order of the parts."""
        tasks = self.tasks()
        if len(tasks) <= CARRIED:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for ids in batches:
                    for i in ids.column(0).to_pylist():
                        for part in tasks[i]:
                            yield from each(part)

            return self.spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, schema)

        def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for r in rows.to_pylist():
                    yield from each(Part(r["path"], r["start"], r["end"], r["record"], r["line"], r["first"]))

        rows = [(i, k, p.path, p.start, p.end, p.record, p.line, p.first) for i, ps in enumerate(tasks) for k, p in enumerate(ps)]
        table = self.spark.createDataFrame(rows, "task bigint, k bigint, path string, start bigint, end bigint, record bigint, line bigint, first boolean")
        return table.repartitionByRange(len(tasks), "task").sortWithinPartitions("task", "k").mapInArrow(run_rows, schema)

    def _expected_of(self):
        """The width that a part's records must have, where its own first record doesn't say."""
        own, widths = self.options.expected(), self.widths
        if own is not None or self.options.field_count != MATCH_FIRST:
            return lambda part: own
        if self.options.headers is True:
            width = widths.get(self.parts[0].path) if self.parts else None
            return lambda part: width
        return lambda part: widths.get(part.path)

    def scan(self, columns: list[int | str] | None = None, predicate: Predicate | None = None, *, text: bool = True, location: bool = False, on_error: str = "fail") -> DataFrame:
        """Rows of all parts: named columns where there are headers or columns, else ``fields``."""
        fmt, options, expected = self.fmt, self.options, self._expected_of()
        wanted = wanted_of(self.names, columns, predicate, text, location)
        header = options.headers is True
        cut = {r.path: r.byte for r in self.errors().collect()} if on_error == "prefix" else {}

        def each(part: Part) -> Iterator[pa.RecordBatch]:
            for rows, error in part_batches(part, fmt, options, expected(part), wanted, header, cut.get(part.path)):
                if error is not None and on_error == "fail":
                    raise error
                if rows is not None:
                    yield rows

        return self._over_parts(each, ddl(wanted))

    def errors(self) -> DataFrame:
        """The first error of each file: path, kind, byte, line, record, field.  At most one row a file."""
        fmt, options, expected = self.fmt, self.options, self._expected_of()

        def each(part: Part) -> Iterator[pa.RecordBatch]:
            for _, error in parsed_part(part, fmt, options, expected(part)):
                if error is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part.path]), _error_value(error)], ["path", "error"])

        found = self._over_parts(each, f"path string, error {ERROR_TYPE}")
        return found.groupBy("path").agg(F.min_by("error", F.col("error.byte")).alias("error")).select("path", "error.*")

    def locations(self) -> DataFrame:
        """Record offsets alone: the scan that an index is made of."""
        return self.scan(columns=[], text=False, location=True).select("_loc.*")


def _other_headers(spark: SparkSession, paths: list[str], cut: set[str], names: list[str] | None, fmt: Format, options: ParseOptions) -> list[tuple[str, bool, int | None]]:
    """(path, whether its header differs, its first record's width) of the files that tell something.

    The first records of many files are read by tasks; what comes back is one row for each file that is
    cut, and the first that differs.
    """
    if len(paths) <= FEW:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(16) as pool:
            own = [(p, options.headers is True and h is not None and h != names, w) for p, (h, w) in zip(paths, pool.map(lambda p: read_headers(p, fmt, options), paths))]
        return [o for o in own if o[1]][:1] or [o for o in own if o[0] in cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for path, own in zip(rows.column("path").to_pylist(), rows.column("cut").to_pylist()):
                header, width = read_headers(path, fmt, options)
                differs = options.headers is True and header is not None and header != names
                if own or differs:
                    out.append((path, differs, width))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.int32())], ["path", "differs", "width"])

    many = max(1, min(len(paths), 2 * spark.sparkContext.defaultParallelism, len(paths) // 64 + 1))
    table = spark.createDataFrame([(p, p in cut) for p in paths], "path string, cut boolean").repartition(many)
    found = table.mapInArrow(run, "path string, differs boolean, width int")
    differing = found.where("differs").limit(1).collect() if options.headers is True else []
    return [tuple(r) for r in differing] or ([tuple(r) for r in found.where("NOT differs").collect()] if cut & set(paths) else [])


_ERROR = pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("byte", "line", "record", "field"))])


def _error_value(error: QuillError) -> pa.Array:
    at = error.location
    return pa.array([{"kind": error.kind, "byte": at.byte, "line": at.line, "record": at.record, "field": at.field}], _ERROR)


def _before(fields, byte: int):
    """The records that begin before a byte."""
    n = int(np.searchsorted(fields.start, byte, "left"))
    if n and n == len(fields.start):
        return fields
    return replace(fields, records=fields.records[: n + 1], values=fields.values.slice(0, int(fields.records[n])), start=fields.start[:n], line=fields.line[:n])


def parse_column(df: DataFrame, column: str, fmt: Format = CSV, options: ParseOptions | None = None, *, columns: list[int | str] | None = None, predicate: Predicate | None = None, text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each value of a binary or string column is one record; its fields become columns.

    Records of a batch are parsed together, a block of bytes at a time, since the parser's arrays are many times
    the block; a longer record is a block of its own.  ``keep``: other columns that go along.  ``options.headers``
    gives the names (a tuple), or False for fields by position.
    """
    options = options or ParseOptions(headers=False)
    names = list(options.headers) if isinstance(options.headers, tuple) else None
    wanted = wanted_of(names, columns, predicate, text, False)
    schema = ddl(wanted)
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {own[k]}" for k in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Plain(fmt, options, wanted, options.expected())
        for rows in batches:
            values = rows.column(column)
            values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
            values = values.fill_null(b"")
            whole = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            for at, end in _runs(whole, BLOCK):
                offsets = whole[at : end + 1]
                body = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] is not None else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
                own = plain.able and len(body) and offsets[1] > 0 and (np.diff(offsets) > 0).all() and (body[offsets[1:] - 1] == 10).all()
                result = plain.read(body.tobytes(), 0, 1, 0) if own else None
                if result is not None and result[1] == end - at:
                    out, kept = result[0], np.arange(end - at) if plain.kept is None else plain.kept
                    if out is None:
                        continue
                else:
                    out, kept = batch(_one_each(body, offsets, fmt, options, at), wanted)
                if keep:
                    also = rows.select(list(keep)).slice(at, end - at)
                    also = also if len(kept) == end - at else also.take(pa.array(kept))
                    out = pa.RecordBatch.from_arrays([*also.columns, *out.columns], [*keep, *out.schema.names])
                yield out

    return df.select(column, *[k for k in keep if k != column]).mapInArrow(run, schema)


def _runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of values of up to ``limit`` bytes together, one at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def _one_each(body: np.ndarray, offsets: np.ndarray, fmt: Format, options: ParseOptions, at: int = 0):
    """The records of values, which must begin where those do; ``at``: the first value's number."""
    fields, error = read_block(body, fmt, options)
    if error is None and len(fields.start) == len(offsets) - 1 and (fields.start == offsets[:-1]).all():
        return fields
    # values without record endings, or with errors: one at a time, to say which
    from ..sources.blocks import _gathered
    from ..sources.parser import Record

    raw, rows = body.tobytes(), []
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), at):
        parser = Parser(raw[s:e], fmt, options, record=i, first=False)
        r = parser.next()
        if r is not None and (more := parser.next()) is not None:
            raise QuillError(Kind.INVALID_VALUE, f"value {i} holds more than one record, the next {more.fields[:1]!r}")
        rows.append(r or Record([], s, e, i, 1))
    return _gathered(rows, 0)


def parse_documents(df: DataFrame, column: str, fmt: Format = CSV, options: ParseOptions | None = None, *, keep: tuple[str, ...] = (), text: bool = True, on_error: str = "fail") -> DataFrame:
    """Each value of a column is a whole document; one row a record: the kept columns, fields, _loc, _error.

    ``on_error`` ``prefix``: a document's rows before its first error, then one row with ``_error``.
    Headers, if the options have them, are the first record and aren't returned.
    """
    options = options or ParseOptions(headers=False)
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    kind = "string" if text else "binary"
    schema = ", ".join([*(f"`{k}` {own[k]}" for k in keep), f"fields array<{kind}>, _loc {LOCATION_TYPE}, _error {ERROR_TYPE}"])
    wanted = Wanted(None, (), None, None, text, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, document in enumerate(rows.column(column)):
                raw = document.as_py()
                raw = raw.encode() if isinstance(raw, str) else (raw or b"")
                fields, error = read_block(raw, fmt, options, first=True)
                if error is not None and on_error == "fail":
                    raise error
                fields = _without_header(fields, options.headers is True)
                out, kept = batch(fields, wanted)
                n = len(kept)
                columns = [*out.columns, pa.nulls(n, _ERROR)]
                if error is not None:
                    extra = [*(pa.nulls(1, c.type) for c in out.columns), _error_value(error)]
                    columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, extra)]
                    n += 1
                same = [pa.concat_arrays([rows.column(k).slice(i, 1)] * n) if n else rows.column(k).slice(0, 0) for k in keep]
                yield pa.RecordBatch.from_arrays([*same, *columns], [*keep, "fields", "_loc", "_error"])

    return df.select(column, *[k for k in keep if k != column]).mapInArrow(run, schema)
