"""Units: documents packed in compressed blocks of bounded size, one row a block.

Operators that exchange statistics with the whole corpus work by unit: a unit emits each of its
distinct keys once, the keys meet elsewhere, and answers come back by unit.  What is shuffled is
then bounded by a unit's distinct keys, however often one key stands in it, and texts travel
compressed.  A text longer than a unit makes a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import SLICE_BYTES, Texts
from .workspace import fresh_path

UNIT_BYTES = 1 << 24
#: Compressed units are read in splits of about this size.
_ROW_GROUP = 8 << 20


@dataclass
class Unit:
    unit: int
    ids: pa.Array
    data: np.ndarray
    offsets: np.ndarray

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[Texts]:
        at, n = 0, len(self.ids)
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + limit, "right")) - 1)
            yield Texts(at, self.data[self.offsets[at] : self.offsets[end]], self.offsets[at : end + 1] - self.offsets[at])
            at = end


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        ids: list[pa.Array] = []
        lengths: list[pa.Array] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            sizes = pa.concat_arrays(lengths)
            one = pa.array([0, len(own)], pa.int32())
            columns = [pa.ListArray.from_arrays(one, own), pa.ListArray.from_arrays(one, sizes), pa.array([pack(b"".join(parts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "body"])

        for batch in batches:
            text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            body = memoryview(text.buffers()[2] or b"")
            size = np.diff(offsets)
            at = 0
            while at < len(text):
                room = limit - held
                end = max(at + (not held), int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1)
                if end > at:
                    ids.append(batch.column("doc_id").slice(at, end - at))
                    lengths.append(pa.array(size[at:end], pa.int64()))
                    parts.append(bytes(body[offsets[at] : offsets[end]]))
                    held += int(offsets[end] - offsets[at])
                    at = end
                if at < len(text):
                    yield flush()
                    ids, lengths, parts, held = [], [], [], 0
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, label: str, limit: int = UNIT_BYTES) -> DataFrame:
    """Write (doc_id, text) as units in the shared folder: unit, ids, lengths, body."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = (
        docs.select("doc_id", "text")
        .mapInArrow(_packed(limit), f"ids array<{kind}>, lengths array<long>, body binary")
        .select(F.monotonically_increasing_id().alias("unit"), "ids", "lengths", "body")
    )
    path = fresh_path(spark, label)
    units.write.option("compression", "uncompressed").option("parquet.block.size", _ROW_GROUP).parquet(path)
    return spark.read.schema(units.schema).parquet(path)


def together(units: DataFrame, answers: DataFrame):
    """Units and answers grouped by unit, about two units a task however large the corpus is.

    Without a number of its own the exchange would have the session's, and its tasks would grow
    with the input.  Both sides are exchanged the same way, so the cogroup needs no other exchange.
    """
    tasks = max(1, -(-units.count() // 2))
    return units.repartition(tasks, "unit").groupBy("unit").cogroup(answers.repartition(tasks, "unit").groupBy("unit"))


def unpack(batch: pa.RecordBatch | pa.Table) -> Iterator[Unit]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for i in range(batch.num_rows):
        body = expand(batch.column("body")[i].as_buffer())
        lengths = batch.column("lengths")[i].values.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        yield Unit(batch.column("unit")[i].as_py(), batch.column("ids")[i].values, np.frombuffer(body, np.uint8), offsets)
