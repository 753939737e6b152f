"""Documents to files: a folder of parts, one file, an append, and segments of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import encoded, header
from ..plans.errors import Kind, QuillError
from ..plans.formats import BOM, CSV, Format
from ..plans.options import EmitOptions, ParseOptions
from . import files
from .parser import Parser


def write(df: DataFrame, folder: str, fmt: Format = CSV, options: EmitOptions | None = None, *, segment_bytes: int | None = None, mode: str = "error") -> list[str]:
    """Each partition as one file, or as files of at most ``segment_bytes``, every one with its own
    mark and header.  Files appear under a hidden name and are renamed when the job has succeeded,
    so a lost task leaves nothing behind.  Returns the files in order.
    """
    options = options or EmitOptions()
    system, own = files.opened(folder)
    from pyarrow import fs

    there = system.get_file_info(own)
    if there.type != fs.FileType.NotFound and mode == "error":
        raise QuillError(Kind.IO, f"{folder} exists")
    system.create_dir(own, recursive=True)
    if mode == "overwrite":
        system.delete_dir_contents(own)
    job = uuid.uuid4().hex[:12]
    head = (BOM if fmt.write_bom else b"") + (header(df.columns, fmt) if options.headers else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, own = files.opened(folder)
        stem = f"part-{context.partitionId():05d}"
        out, held, n = None, 0, 0
        names: list[str] = []
        for lines in batches:
            for line in lines.column("line"):
                body = line.as_buffer()
                if out is None or (segment_bytes and held > len(head) and held + len(body) > segment_bytes):
                    if out is not None:
                        out.close()
                    name = f".{job}-{context.taskAttemptId()}-{stem}-{n:05d}"
                    out = system.open_output_stream(f"{own}/{name}")
                    names.append(name)
                    out.write(head)
                    held, n = len(head), n + 1
                out.write(body)
                held += len(body)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": names}, schema=pa.schema([("file", pa.string())]))

    written = [r.file for r in encoded(df, fmt).mapInArrow(run, "file string").collect()]
    if not written and options.headers:  # an empty table still has its header
        written = [f".{job}-0-part-00000-00000"]
        files.write(f"{folder}/{written[0]}", head)
    final = []
    for name in written:
        final.append(f"{folder}/{name.split('-', 2)[2]}" + f"-{job}.txt")
        system.move(f"{own}/{name}", files.opened(final[-1])[1])
    for left in system.get_file_info(fs.FileSelector(own)):  # of attempts that failed
        if left.base_name.startswith(f".{job}"):
            system.delete_file(left.path)
    return sorted(final)


#: Bytes copied at once where parts become one file.
_COPY = 8 << 20


def place(lines: DataFrame, path: str, head: bytes = b"", after: int | None = None) -> int:
    """One file of a column of records, in the DataFrame's order; returns its length.

    Tasks write a part each beside the file.  On a shared file system with random access, tasks then copy
    the parts to their places in it; elsewhere (object stores) the parts' bytes are streamed into it.
    ``after``: the length of the file that the records are appended to.
    """
    from pyarrow import fs

    spark = lines.sparkSession
    system, own = files.opened(path)
    folder = f"{own}.{uuid.uuid4().hex[:12]}.parts"
    system.create_dir(folder, recursive=True)
    stem = path[: len(path) - len(own)] + folder

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{stem}/{context.partitionId():08d}-{context.taskAttemptId()}"
        there, own = files.opened(name)
        n = 0
        with there.open_output_stream(own) as out:
            for rows in batches:
                column = rows.column(0).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                if len(column):
                    out.write(memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]])
                    n += int(offsets[-1] - offsets[0])
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "bytes": [n]})

    try:
        parts = sorted((r.part, r.name, r.bytes) for r in lines.mapInArrow(write_part, "part bigint, name string, bytes bigint").collect())
        at = (after or 0) + len(head)
        spans = []
        for _, name, n in parts:
            spans.append((name, at, n))
            at += n
        if isinstance(system, fs.LocalFileSystem):
            with open(own, "r+b" if after else "wb") as out:
                out.seek(after or 0)
                out.write(head)
                out.truncate(at)

            def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for rows in batches:
                    for r in rows.to_pylist():
                        with open(own, "r+b") as out:
                            out.seek(r["at"])
                            for k in range(0, r["bytes"], _COPY):
                                out.write(files.read(r["name"], k, min(_COPY, r["bytes"] - k)))
                yield pa.RecordBatch.from_pydict({"done": [1]})

            if spans:
                spark.createDataFrame(spans, "name string, at bigint, bytes bigint").repartition(len(spans)).mapInArrow(copy, "done bigint").collect()
        else:
            with system.open_append_stream(own) if after else system.open_output_stream(own) as out:
                out.write(head)
                for name, _, n in spans:
                    for k in range(0, n, _COPY):
                        out.write(files.read(name, k, min(_COPY, n - k)))
        return at
    finally:
        system.delete_dir(folder)


def write_one(df: DataFrame, path: str, fmt: Format = CSV, options: EmitOptions | None = None) -> None:
    """One file, in the DataFrame's order."""
    options = options or EmitOptions()
    place(encoded(df, fmt), path, (BOM if fmt.write_bom else b"") + (header(df.columns, fmt) if options.headers else b""))


def append(df: DataFrame, path: str, fmt: Format = CSV, options: EmitOptions | None = None) -> None:
    """More records at a file's end.  The header is written only if the file has no records; the file
    must end with a record ending, and its records must be as wide as the new ones."""
    options = options or EmitOptions()
    n = files.size(path) if _exists(path) else 0
    mark = files.read(path, 0, 3) == BOM if n >= 3 else False
    head = b""
    if n == 0 or (n == 3 and mark):
        head = (BOM if fmt.write_bom and not mark else b"") + (header(df.columns, fmt) if options.headers else b"")
    else:
        if files.read(path, n - len(fmt.ending), len(fmt.ending)) != fmt.ending:
            raise QuillError(Kind.UNTERMINATED_RECORD, path)
        first = Parser(files.read(path, 0, 1 << 20), fmt, ParseOptions(headers=False)).next()
        if options.field_count != "flexible" and first is not None and len(first.fields) != len(df.columns):
            raise QuillError(Kind.FIELD_COUNT_MISMATCH, f"{len(first.fields)} fields in {path}, {len(df.columns)} given")
    place(encoded(df, fmt), path, head, n or None)


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, own = files.opened(path)
    return system.get_file_info(own).type == fs.FileType.File


def document(df: DataFrame, fmt: Format = CSV, options: EmitOptions | None = None) -> bytes:
    """The whole DataFrame as one document in memory, for small results."""
    options = options or EmitOptions()
    head = (BOM if fmt.write_bom else b"") + (header(df.columns, fmt) if options.headers else b"")
    return head + b"".join(bytes(r.line) for r in encoded(df, fmt).collect())


def ordered(df: DataFrame, order: str, fmt: Format, folder: str) -> DataFrame:
    """(order, line, _at, _size, _feeds): the records, written to ``folder`` by range of the order.

    ``_at`` grows with the order; its high bits are the range.  Ranges are cut once: cut again, as for a plan that
    stands twice in a query, they can be others, and their number too.
    """
    lines = encoded(df, fmt, keep=(order,)).repartitionByRange(F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{order}`"))
    text = F.decode("line", "ISO-8859-1")
    feeds = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
    lines.select("*", F.monotonically_increasing_id().alias("_at"), F.octet_length("line").cast("long").alias("_size"), feeds.alias("_feeds")).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def before(records: DataFrame, *columns: str) -> DataFrame:
    """Records of ``ordered`` with the number of records, as ``_n``, and the sums of columns over all before each.

    Ranges are summed first, then the records within each; no task sees all rows.
    """
    from pyspark.sql import Window

    part, ahead = F.shiftright("_at", 33), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = records.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in columns))
    base = sums.select(F.col("_part").alias("_of"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_base{c}") for c in ("_n", *columns)))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("_base_n") + F.col("_at") - F.shiftleft("_part", 33)
    own = [F.col(f"_base{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns]
    kept = [c for c in records.columns if c not in columns]
    return records.withColumn("_part", part).join(base, F.col("_part") == F.col("_of")).select(*(F.col(f"`{c}`") for c in kept), n.alias("_n"), *(v.alias(c) for v, c in zip(own, columns)))


def with_offsets(df: DataFrame, order: str, fmt: Format = CSV) -> DataFrame:
    """(order, line, byte): each record with its place in the one document, by a distributed sum over
    records that are written first."""
    head = len(header(df.columns, fmt)) + (3 if fmt.write_bom else 0)
    records = ordered(df, order, fmt, files.temporary(df.sparkSession, "ordered"))
    return before(records.select(F.col(f"`{order}`"), "line", "_at", "_size"), "_size").select(F.col(f"`{order}`"), "line", (F.lit(head) + F.col("_size")).alias("byte"))
