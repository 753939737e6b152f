"""Exact cuts of documents: where each part's first record begins, and its number and line.

A first pass over fixed chunks, in parallel, counts for either state at the chunk's start: record ends
and line feeds, the first record end, and the state at its end.  The state is whether quotes are open or,
in a format without quotes, whether the first byte is escaped.  The driver then folds the few numbers of each chunk from
left to right, so every part knows its state without any part having read another's bytes.  Parity is
exact up to the first error of a document, and what follows an error isn't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..plans.formats import Format
from . import files

#: Parts are of this many bytes, or of fewer where the input is small beside the cluster, but of no
#: fewer than LEAST; files of up to two parts' size are left whole.
CHUNK, LEAST = 64 << 20, 1 << 20
#: Bytes that a process probes by itself, where it has no cluster to do so.
LOCAL = 16 << 30
#: Bytes whose probe by threads of the driver takes less time than a job.
HERE = 128 << 20
_NUMBERS = ("lf", "ends0", "first0", "head0", "next0", "ends1", "first1", "head1", "next1")
_PROBE = "path string, start bigint, " + ", ".join(f"{n} bigint" for n in _NUMBERS)


@dataclass(frozen=True)
class Part:
    """Bytes ``start`` .. ``end`` of a file, which begin and end at records."""

    path: str
    start: int
    end: int
    record: int
    line: int
    first: bool


def probe(data: bytes, fmt: Format) -> tuple[int, ...]:
    """Line feeds, and for either state: record ends, where the first one is and the line feeds up to it,
    and the state after."""
    out = [data.count(b"\n")]
    for state in (0, 1):
        at, after = record_ends(data, fmt, state)
        first = int(at[0]) + 1 if len(at) else -1
        out += [len(at), first, data.count(b"\n", 0, max(first, 0)), after]
    return tuple(out)


def record_ends(data: bytes, fmt: Format, state: int = 0) -> tuple[np.ndarray, int]:
    """Places of the bytes that end records, and the state after the data."""
    array = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(array == fmt.lead[0])
    if fmt.syntax.quoting:
        quotes = np.flatnonzero(array == fmt.quote[0])
        if len(quotes):
            at = at[(np.searchsorted(quotes, at) + state) % 2 == 0]
        elif state:
            at = at[:0]
        return at, (len(quotes) + state) % 2
    if not fmt.escape.anywhere:
        return at, 0
    # a byte is escaped if an odd number of escapes, neighbours all, stand before it
    other = np.flatnonzero(array != fmt.escape.anywhere[0])
    places = np.append(at, len(array))
    k = np.searchsorted(other, places) - 1
    last = np.where(k >= 0, other[np.maximum(k, 0)] if len(other) else -1, -1)
    odd = (places - 1 - last + np.where(last < 0, state, 0)) % 2 == 1
    return at[~odd[:-1]], int(odd[-1])


def chunk_bytes(spark: SparkSession, total: int) -> int:
    """The size of parts for so many bytes: two parts a core, within bounds."""
    return min(CHUNK, max(LEAST, total // (2 * spark.sparkContext.defaultParallelism)))


def plan(spark: SparkSession, paths: str | list[str], fmt: Format, small: int | None = None, chunk: int | None = None, here: int = HERE) -> list[Part]:
    """Parts of all files.  Files of formats that can't be split are one part each."""
    found = list(files.listed(paths))
    if chunk is None:
        chunk = chunk_bytes(spark, sum(n for _, n in found))
    small = 2 * chunk if small is None else small
    whole = [(p, n) for p, n in found if n <= small or fmt.unsplittable()]
    parts = [Part(p, 0, n, 0, 1, True) for p, n in whole]
    large = [(p, n) for p, n in found if n > small and not fmt.unsplittable()]
    if large and sum(n for _, n in large) <= here:
        parts += plan_here(large, fmt, chunk, small)
    elif large:
        chunks = [(p, at, min(chunk, n - at)) for p, n in large for at in range(0, n, chunk)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    numbers = probe(files.read(row["path"], row["start"], row["size"]), fmt)
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["start"]]), *(pa.array([x], pa.int64()) for x in numbers)], ["path", "start", *_NUMBERS])

        table = spark.createDataFrame(chunks, "path string, start bigint, size bigint").repartition(len(chunks))
        rows = {(r.path, r.start): r for r in table.mapInArrow(run, _PROBE).collect()}
        for path, n in large:
            parts += fold([rows[path, at] for at in range(0, n, chunk)], path, n)
    order = {p: i for i, (p, _) in enumerate(found)}
    return sorted(parts, key=lambda p: (order[p.path], p.start))


def plan_here(found: list[tuple[str, int]], fmt: Format, chunk: int = CHUNK, small: int = 2 * CHUNK, most: int = LOCAL) -> list[Part]:
    """Parts of files without a session, probed by threads of this process.

    For files of up to ``most`` bytes in all; of more, every file is one part.
    """
    from concurrent.futures import ThreadPoolExecutor
    from types import SimpleNamespace

    parts: list[Part] = []
    if fmt.unsplittable() or sum(n for _, n in found if n > small) > most:
        return [Part(p, 0, n, 0, 1, True) for p, n in found]
    with ThreadPoolExecutor(8) as pool:
        for path, n in found:
            if n <= small:
                parts.append(Part(path, 0, n, 0, 1, True))
                continue
            starts = range(0, n, chunk)
            numbers = pool.map(lambda at, path=path: probe(files.read(path, at, chunk), fmt), starts)
            parts += fold([SimpleNamespace(path=path, start=at, **dict(zip(_NUMBERS, x))) for at, x in zip(starts, numbers)], path, n)
    return parts


def fold(rows: list, path: str, n: int) -> list[Part]:
    """From the chunks' numbers to parts: a part begins after the first record end of its chunk."""
    parts, state, record, line, begin = [], 0, 0, 1, (0, 0, 1)
    for k, r in enumerate(rows):
        first, head = ((r.first0, r.head0), (r.first1, r.head1))[state]
        if k and first >= 0:
            start = r.start + first
            parts.append(Part(path, begin[0], start, begin[1], begin[2], not parts))
            begin = (start, record + 1, line + head)
        record += (r.ends0, r.ends1)[state]
        line += r.lf
        state = (r.next0, r.next1)[state]
    parts.append(Part(path, begin[0], n, begin[1], begin[2], not parts))
    return [p for p in parts if p.end > p.start or p.first]
