"""Output in segments of bounded size, each a document of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import encoded, header
from ..plans.formats import CSV, Format


def rollover(sizes: np.ndarray, room: int, held: int = 0, segment: int = 0) -> tuple[np.ndarray, int, int]:
    """The segment of each record, given the open one and its bytes; and both after the last.

    One step a segment: the next one begins with the first record that doesn't fit.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(len(sizes), np.int64)
    at, before = 0, -held  # bytes before the open segment, as the sums see it
    while at < len(sizes):
        stop = int(np.searchsorted(ends, before + room, "right"))
        if stop <= at and (ends[at - 1] if at else 0) == before:
            stop = at + 1  # a record too large for any segment stands alone
        out[at:stop] = segment
        if stop >= len(sizes):
            break
        at, before, segment = max(at, stop), int(ends[stop - 1]) if stop else 0, segment + 1
    total = int(ends[-1]) if len(sizes) else 0
    return out, total - before, segment


def segments(df: DataFrame, order: str, limit: int, fmt: Format = CSV, columns: list[str] | None = None, group: str | None = None, headers: bool = True) -> DataFrame:
    """Number the segment of each record: (group, order, line, segment).

    Records go in ``order`` and a segment is closed before the record that would take it past
    ``limit`` bytes, header included; a record larger than that stands alone.  Rolling over depends
    on all records before, so a group (by default: a range of the order, one a partition) is read by
    one task, in order, holding a batch of records and the open segment's size; groups go in parallel.
    """
    names = columns or [c for c in df.columns if c != group]
    room = limit - (len(header(names, fmt)) if headers else 0)
    lines = encoded(df, fmt, names, keep=tuple(c for c in (group, order) if c))
    if group is None:
        key = "_group"
        lines = lines.repartitionByRange(F.col(order)).withColumn(key, F.spark_partition_id()).select(key, order, "line")
    else:
        key = group
        lines = lines.repartition(F.col(key))
    lines = lines.sortWithinPartitions(key, order)
    own = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join([*(f"`{c}` {own[c]}" for c in lines.columns), "segment bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, segment = None, 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = rows.column(key)
            sizes = np.diff(np.frombuffer(rows.column("line").cast(pa.large_binary()).buffers()[1], np.int64)[: rows.num_rows + 1])
            codes = pa.array(keys).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
            out = np.empty(len(codes), np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                value = (keys[a].as_py(),)
                if value != open_:
                    open_, held, segment = value, 0, 0
                out[a:b], held, segment = rollover(sizes[a:b], room, held, segment)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], [*rows.schema.names, "segment"])

    return lines.mapInArrow(run, schema)
