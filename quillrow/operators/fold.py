"""Folds over records in parallel: one accumulator a part, merged in pairs or left apart."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import Document


def fold(rows: DataFrame, init: Callable[[], Any], step: Callable[[Any, Any], Any], by_batch: bool = False) -> list[Any]:
    """One accumulator a partition, in no order: ``step(accumulator, row)`` returns the next one.

    ``by_batch``: the step takes whole Arrow batches instead, for arithmetic on columns.
    Accumulators come to the driver; keep them small.  Ordinary aggregates are better left to
    ``DataFrame.agg``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_ = init(), False
        for batch in batches:
            for part in [batch] if by_batch else batch.to_pylist():
                any_ = True
                state = step(state, part)
        if any_:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]})

    return [pickle.loads(bytes(r.state)) for r in rows.mapInArrow(run, "state binary").collect()]


def for_each_record(rows: DataFrame, action: Callable[[dict], None]) -> None:
    """Side effects on the executors, in no order."""
    rows.foreachPartition(lambda part: [action(r.asDict()) for r in part] and None)


def for_each_batch(document: Document, action: Callable[[list[dict]], None], size: int = 8192) -> None:
    """Batches of rows on the driver, in document order, one partition held at a time."""
    rows = document.scan(location=True).orderBy("_loc.record") if len({p.path for p in document.parts}) == 1 else document.scan(location=True)
    held: list[dict] = []
    for row in rows.toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == size:
            action(held)
            held = []
    if held:
        action(held)
