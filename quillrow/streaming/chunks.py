"""Chunks of many documents as a stream: records come out as soon as they are complete.

Rows are (stream, seq, chunk, last).  Chunks of one stream are taken in the order of ``seq``; those
that come early wait in the state until the ones before them are there.  The state of a stream is its
unfinished record, its place, and the chunks that wait.  The row with ``last`` ends the stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.errors import ERROR_TYPE, LOCATION_TYPE, QuillError
from ..plans.formats import CSV, Format
from ..operators.scan import _ERROR, _error_value
from ..plans.options import ParseOptions
from ..sources.blocks import Wanted, batch, read_block
from .push import PushParser

OUTPUT = f"stream string, fields array<binary>, _loc {LOCATION_TYPE}, _error {ERROR_TYPE}"
_STATE = "state binary"
_WHOLE = Wanted(None, (), None, None, False, True)


def _advance(parser: PushParser, stream: str, chunk: bytes, last: bool) -> Iterator[dict]:
    if parser.error is not None:  # what follows an error isn't read
        return
    error = None
    try:
        records = parser.chunk(chunk)
        yield from (_row(stream, r) for r in records)
        error = parser.error
        if last and error is None:
            yield from (_row(stream, r) for r in parser.finish())
            error = parser.error
    except QuillError as e:
        error = e
    if error is not None and error.location is not None:
        at = error.location
        yield {"stream": stream, "fields": None, "_loc": None, "_error": {"kind": error.kind, "byte": at.byte, "line": at.line, "record": at.record, "field": at.field}}


def _row(stream: str, r) -> dict:
    return {"stream": stream, "fields": r.fields, "_loc": {"byte": r.start, "line": r.line, "record": r.index, "field": 0}, "_error": None}


def _step(fmt: Format, options: ParseOptions):
    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream = key[0]
        parser = PushParser(fmt, options)
        due, waiting = 0, {}
        if state.exists:
            saved, due, waiting = pickle.loads(state.get[0])
            parser.restore(saved)
        for frame in frames:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["last"]):
                if int(seq) >= due:  # a chunk that was taken before is a repeat
                    waiting[int(seq)] = (bytes(chunk or b""), bool(last))
        rows: list[dict] = []
        ended = False
        while due in waiting:
            chunk, last = waiting.pop(due)
            rows += _advance(parser, stream, chunk, last)
            due += 1
            ended = ended or last
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((parser.state(), due, waiting)),))
        if rows:
            yield pd.DataFrame(rows, columns=["stream", "fields", "_loc", "_error"])

    return run


def records(chunks: DataFrame, fmt: Format = CSV, options: ParseOptions | None = None) -> DataFrame:
    """A streaming DataFrame of chunks as a streaming DataFrame of records."""
    options = options or ParseOptions(headers=False)
    rows = chunks.selectExpr("cast(stream as string) stream", "cast(seq as bigint) seq", "cast(chunk as binary) chunk", "cast(last as boolean) last")
    return rows.groupBy("stream").applyInPandasWithState(_step(fmt, options), OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def records_of(chunks: DataFrame, fmt: Format = CSV, options: ParseOptions | None = None) -> DataFrame:
    """The same over a finished table of chunks.

    A stream's chunks come together in order of ``seq``, repeats once, and are parsed as one block.
    """
    options = options or ParseOptions(headers=False)
    names = ["stream", "fields", "_loc", "_error"]

    def parsed(stream: str | None, body: bytes, ended: bool) -> Iterator[pa.RecordBatch]:
        fields, error = read_block(body, fmt, options, first=True)
        if not ended:  # what isn't complete isn't a record yet
            parser = PushParser(fmt, options)
            rows = list(_advance(parser, stream or "", body, False))
            good = sum(r["_error"] is None for r in rows)
            error = parser.error
            fields = replace(fields, values=fields.values.slice(0, int(fields.records[good])), records=fields.records[: good + 1], start=fields.start[:good], line=fields.line[:good])
        out, kept = batch(fields, _WHOLE)
        n = len(kept)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([stream] * n, pa.string()), *out.columns, pa.nulls(n, _ERROR)], names)
        if error is not None and error.location is not None:
            yield pa.RecordBatch.from_arrays([pa.array([stream], pa.string()), *(pa.nulls(1, c.type) for c in out.columns), _error_value(error)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: str | None = None
        held: list[bytes] = []
        due, ended, any_ = None, False, False
        for rows in batches:
            for stream, seq, chunk, last in zip(*(rows.column(c).to_pylist() for c in ("stream", "seq", "chunk", "last"))):
                if any_ and stream != key:
                    yield from parsed(key, b"".join(held), ended)
                    any_ = False
                if not any_:
                    key, held, due, ended, any_ = stream, [], None, False, True
                if seq != due and not ended:
                    held.append(chunk or b"")
                    ended = bool(last)
                due = seq
        if any_:
            yield from parsed(key, b"".join(held), ended)

    rows = chunks.selectExpr("cast(stream as string) stream", "cast(seq as bigint) seq", "cast(chunk as binary) chunk", "cast(last as boolean) last")
    return rows.repartition("stream").sortWithinPartitions("stream", "seq").mapInArrow(run, OUTPUT)
