"""A persistent index of record places, for random access to delimited files.

The index is a Parquet table with one row a record (record, byte, line; the header is record 0), and
a small description beside it: the source's length and digest, the format and the limits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import Kind, QuillError
from ..plans.formats import BOM, CSV, Format
from ..plans.options import ParseOptions
from ..plans.predicate import Predicate
from ..sources import files
from ..sources.blocks import batch, read_block
from .scan import Document, ddl, read_headers, wanted_of

#: Bytes of a source that one digest is of; the source's is the digest of those.
_LEAF = 64 << 20


def identity(spark: SparkSession, path: str) -> dict:
    """Length and digest of a source: SHA-256 of the digests of its leaves, which tasks read."""
    n = files.size(path)
    starts = range(0, n, _LEAF)
    if len(starts) <= 1:
        leaves = [hashlib.sha256(files.read(path, 0, n)).digest()]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_pylist()
                digests = [hashlib.sha256(files.read(path, i * _LEAF, _LEAF)).digest() for i in at]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["id", "digest"])

        rows = spark.range(0, len(starts), 1, len(starts)).mapInArrow(run, "id bigint, digest binary").orderBy("id").collect()
        leaves = [bytes(r.digest) for r in rows]
    return {"bytes": n, "sha256": hashlib.sha256(b"".join(leaves)).hexdigest()}


class RecordIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        try:
            self.about = json.loads(files.read(f"{folder}/about.json", 0, files.size(f"{folder}/about.json")))
            self.table = spark.read.parquet(f"{folder}/records")
        except Exception as error:
            raise QuillError(Kind.INVALID_INDEX, str(error)) from None
        self._bound = False

    @classmethod
    def build(cls, spark: SparkSession, source: str, folder: str, fmt: Format = CSV, options: ParseOptions | None = None) -> RecordIndex:
        """Scan the source in parallel and write its records' places."""
        options = options or ParseOptions()
        document = Document.open(spark, source, fmt, ParseOptions(headers=False, field_count=options.field_count, limits=options.limits))
        places = document.locations().select("record", "byte", "line")
        places.repartitionByRange(max(1, len(document.parts)), "record").sortWithinPartitions("record").write.mode("overwrite").parquet(f"{folder}/records")
        about = identity(spark, source) | {"format": repr(fmt), "source": source, "records": spark.read.parquet(f"{folder}/records").count()}
        files.write(f"{folder}/about.json", json.dumps(about).encode())
        return cls(spark, folder)

    @classmethod
    def generate(cls, df: DataFrame, order: str, source: str, folder: str, fmt: Format = CSV) -> RecordIndex:
        """Write the rows in order as one file with a header, and its index, from one pass of encoding."""
        from ..functions.encode import header
        from ..sources.writer import before, ordered, place

        spark = df.sparkSession
        head = (BOM if fmt.write_bom else b"") + header(df.columns, fmt)
        written = ordered(df, order, fmt, f"{folder}/encoded")
        place(written.orderBy("_at").select("line"), source, head)
        rows = before(written.select("_at", "_size", "_feeds"), "_size", "_feeds").select(
            (F.col("_n") + 1).alias("record"),
            (F.lit(len(head)) + F.col("_size")).alias("byte"),
            (F.lit(1 + head.count(b"\n")) + F.col("_feeds")).alias("line"),
        )
        first = spark.createDataFrame([(0, 3 if fmt.write_bom else 0, 1)], "record bigint, byte bigint, line bigint")
        first.union(rows).repartitionByRange("record").sortWithinPartitions("record").write.mode("overwrite").parquet(f"{folder}/records")
        about = identity(spark, source) | {"format": repr(fmt), "source": source, "records": spark.read.parquet(f"{folder}/records").count()}
        files.write(f"{folder}/about.json", json.dumps(about).encode())
        return cls(spark, folder)

    def __len__(self) -> int:
        return self.about["records"]

    def record_offset(self, record: int) -> int:
        return self._place(record).byte

    def record_line(self, record: int) -> int:
        return self._place(record).line

    def _place(self, record: int):
        row = self.table.where(F.col("record") == record).first()
        if row is None:
            raise QuillError(Kind.RECORD_OUT_OF_RANGE, f"record {record} of {len(self)}")
        return row

    def validate(self, source: str | None = None) -> RecordIndex:
        """The source must be the bytes the index was made of."""
        source = source or self.about["source"]
        now = identity(self.spark, source)
        if {k: self.about[k] for k in now} != now:
            raise QuillError(Kind.SOURCE_MISMATCH, source)
        self._bound = True
        return self

    #: Validate once, then read without validating again.
    bind = validate

    def read(self, first: int, last: int | None = None, fmt: Format = CSV, options: ParseOptions | None = None, *, columns: list[int | str] | None = None, predicate: Predicate | None = None, text: bool = True, location: bool = False, per_task: int = 100_000) -> DataFrame:
        """Records ``first`` .. ``last`` (exclusive, None: to the end), read from their places alone."""
        if not self._bound:
            self.validate()
        options = options or ParseOptions()
        if not 0 <= first <= len(self):
            raise QuillError(Kind.RECORD_OUT_OF_RANGE, f"record {first} of {len(self)}")
        source = self.about["source"]
        names = read_headers(source, fmt, options)[0]
        wanted = wanted_of(names, columns, predicate, text, location)
        limit = "" if last is None else f" AND record < {int(last)}"
        marks = self.table.where(f"record >= {int(first)}{limit}").withColumn("task", F.floor((F.col("record") - first) / per_task))
        stop = None if last is None or last >= len(self) else self.record_offset(last)
        spans = (
            marks.groupBy("task")
            .agg(F.min_by(F.struct("byte", "line", "record"), "record").alias("from"))
            .select("task", "from.byte", "from.line", "from.record")
        )
        after = spans.select((F.col("task") - 1).alias("task"), F.col("byte").alias("end"))
        total = self.about["bytes"] if stop is None else stop
        spans = spans.join(after, "task", "left").withColumn("end", F.coalesce("end", F.lit(total))).repartition("task")
        plain = ParseOptions(headers=False, field_count=options.field_count, limits=options.limits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for r in rows.to_pylist():
                    body = files.read(source, r["byte"], r["end"] - r["byte"])
                    fields, error = read_block(body, fmt, plain, offset=r["byte"], line=r["line"], record=r["record"], first=r["byte"] == 0)
                    if error is not None:
                        raise error
                    if len(fields.records) > 1:
                        yield batch(fields, wanted)[0]

        return spans.select("byte", "line", "record", "end").mapInArrow(run, ddl(wanted))
