"""``spark.read.format("quillrow")`` and ``df.write.format("quillrow")``.

Options: ``path``, ``format`` (a preset's name), ``headers`` (true, false), ``columns`` (comma
separated names), ``predicate`` (kind:column:literal), ``field_count``, ``split_bytes`` (the size of the
partitions that large files are cut in).  Cuts are exact; the reader counts quotes for them by itself, so
where files hold more than 16 GB in all they are better read through ``api.read``, whose count is a job
of the cluster; the source then has one partition a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..plans import predicate as predicates
from ..plans.formats import BOM, PRESETS
from ..plans.options import MATCH_FIRST, ParseOptions
from . import files
from .split import CHUNK, Part, plan_here


def _options(options: dict) -> tuple:
    fmt = PRESETS[options.get("format", "csv")]
    headers = options.get("headers", "true").lower() == "true"
    count = options.get("field_count", "flexible")
    return fmt, ParseOptions(headers=headers, field_count=int(count) if count.isdigit() else count)


class QuillrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillrow"

    def schema(self):
        from ..operators.scan import ddl

        return ddl(_Reader(self.options, None).wanted)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


class _Parts(InputPartition):
    """Neighbouring parts, small files together."""

    def __init__(self, parts: list[Part]) -> None:
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        from ..operators.scan import read_headers, wanted_of

        self.fmt, self.parse = _options(options)
        self.chunk = int(options.get("split_bytes", CHUNK))
        self.found = list(files.listed(options["path"]))
        names, self.width = read_headers(self.found[0][0], self.fmt, self.parse) if self.found else (None, None)
        self.names = names
        columns = options["columns"].split(",") if options.get("columns") else None
        test = None
        if options.get("predicate"):
            kind, column, literal = options["predicate"].split(":", 2)
            test = getattr(predicates, kind)(int(column) if column.isdigit() else column, literal)
        self.wanted = wanted_of(names, columns, test, True, False)

    def partitions(self):
        out: list[_Parts] = []
        held = 0
        for p in plan_here(self.found, self.fmt, self.chunk, 2 * self.chunk):
            if not out or held + p.end - p.start > self.chunk:
                out.append(_Parts([]))
                held = 0
            out[-1].parts.append(p)
            held += p.end - p.start
        return out

    def read(self, partition: _Parts) -> Iterator[pa.RecordBatch]:
        from ..operators.scan import part_batches, read_headers
        from ..plans.errors import Kind, QuillError

        expected = self.parse.expected()
        for part in partition.parts:
            width = expected
            if part.first and self.parse.headers is True:
                own = read_headers(part.path, self.fmt, self.parse)[0]
                if own is not None and own != self.names:
                    raise QuillError(Kind.DECODE, f"headers of {part.path} differ")
            if width is None and self.parse.field_count == MATCH_FIRST:
                width = self.width if self.parse.headers is True else None if part.first else read_headers(part.path, self.fmt, self.parse)[1]
            for rows, error in part_batches(part, self.fmt, self.parse, width, self.wanted, self.parse.headers is True):
                if error is not None:
                    raise error
                if rows is not None:
                    yield rows


class _Message(WriterCommitMessage):
    def __init__(self, file: str | None) -> None:
        self.file = file


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.fmt, parse = _options(options)
        self.headers = parse.headers

    def write(self, iterator) -> _Message:
        import uuid

        from ..functions.encode import _record_bytes, header

        system, own = files.opened(self.path)
        system.create_dir(own, recursive=True)
        name = f".{uuid.uuid4().hex}.txt"
        with system.open_output_stream(f"{own}/{name}") as out:
            out.write((BOM if self.fmt.write_bom else b"") + (header(self.schema.names, self.fmt) if self.headers else b""))
            for rows in iterator:
                columns = [[_text(v) for v in c.to_pylist()] for c in rows.columns]
                out.write(b"".join(_record_bytes(list(r), self.fmt) for r in zip(*columns)))
        return _Message(name)

    def commit(self, messages) -> None:
        system, own = files.opened(self.path)
        done = {m.file for m in messages if m is not None}
        if self.overwrite:
            for path, _ in list(files.listed(self.path)):
                system.delete_file(files.opened(path)[1])
        for i, name in enumerate(sorted(done)):
            system.move(f"{own}/{name}", f"{own}/part-{i:05d}-{name[1:]}")

    def abort(self, messages) -> None:
        system, own = files.opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{own}/{m.file}")


def _text(v) -> bytes | None:
    if v is None or isinstance(v, bytes):
        return v
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, float):
        return (repr(int(v)) if v.is_integer() and abs(v) < 1e16 else repr(v)).encode()
    return str(v).encode()
