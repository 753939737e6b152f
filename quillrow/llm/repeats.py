"""Exact removal of repeated passages by suffix arrays, sharded by content.

Every byte that a string of ``length`` bytes covers goes, if that string also starts earlier (in a
text of a lesser doc_id, or earlier in the same text).  Strings are judged on the input.

1.  Texts are packed in units.  Each window of ``length`` bytes is given the least hash of the
    ``GRAM``-byte strings within it, its anchor.  Equal windows have equal anchors, and runs of
    neighbouring windows with one anchor at one place (about one in 31 bytes begins one) form a
    strip; no two windows of a strip are equal.
2.  Units send their distinct anchors with the number of their distinct strips; anchors with one
    strip in all can't hold a repeat between units.  Equal strips of a unit are settled within it.
3.  The first of each unit's equal strips of the other anchors go to shards by anchor.  A shard
    settles equal strips at once; over the rest it builds a suffix array (Larsson-Sadakane) with
    Kasai's common prefixes, in which equal windows are neighbours, and keeps the earliest.
4.  An anchor with more than ``CROWD`` strips is split over several shards.  What each of them keeps
    is merged with the others by binary search among sorted windows, spread by window.
5.  Verdicts go back to the units, which cut the texts.

Bytes are compared by the suffix arrays.  Strips and windows that are settled elsewhere are told apart by two
64-bit hashes, that of their bytes and that of the anchor in them.

Defined results: null or empty text has nothing removed; a null doc_id comes after all others; rows
that repeat a doc_id are ordered as they are read; doc_ids must be integers; an empty table gives an empty result; extra
columns are ignored.  A text is held whole by its task.

Scale: no step compares shards pairwise.  What is shuffled is one row an anchor and unit (about 3%
of the bytes), the strips of repeated anchors, and the units' compressed texts twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import common_prefixes, suffix_array
from .textbatch import Texts, _power, mix, span_hashes
from .textbatch import _MIX as MIX
from .units import UNIT_BYTES, Unit, pack, together, unpack
from .workspace import materialize, release

LENGTH, GRAM = 100, 40
CROWD = 12_000
SHARD_BYTES = 2 << 20
_PLACE = np.uint64((1 << 22) - 1)
_PART = 1 << 19
#: Bytes that are hashed, copied or sorted at once; texts and anchors with more are taken whole.
_PIECE = 1 << 19


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Strips:
    """Strips of one unit: anchor, hash of the bytes, text, first window, number of windows."""

    anchor: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    many: np.ndarray

    def take(self, index: np.ndarray) -> Strips:
        return Strips(*(getattr(self, f)[index] for f in ("anchor", "hash", "text", "start", "many")))


def _strips(texts: Texts, length: int, gram: int) -> Strips:
    data, offsets = texts.data, texts.offsets
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Strips(none.view(np.uint64), none.view(np.uint64), none, none, none)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(MIX[data] * up[:n], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * down[: n + 1 - gram])
    # the least hash by its high bits, the leftmost of equals: equal windows choose the same gram, and
    # no two equal windows choose one and the same place
    least = np.empty(n - length + 1, np.int64)
    for at in range(0, len(least), _PART):
        part = hashes[at : at + _PART + length - gram]
        key = _least((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), length - gram + 1)
        least[at : at + len(key)] = (key & _PLACE).astype(np.int64) + at
    last = offsets[1:] - length  # the last window of each text
    own = np.flatnonzero(last >= offsets[:-1])
    step = np.zeros(len(least) + 1, dtype=np.int8)
    step[offsets[own]] += 1
    step[last[own] + 1] -= 1
    valid = np.cumsum(step[:-1]).astype(bool)
    new = np.append(True, least[1:] != least[:-1])
    new[offsets[own]] = True
    start = np.flatnonzero(valid & new)
    text = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(least)), last[text] + 1)
    bytes_ = span_hashes(data, start, end + length - 1)
    return Strips(hashes[least[start]], bytes_, text + texts.first, start - offsets[text], end - start)


def unit_strips(unit: Unit, length: int, gram: int) -> Strips:
    parts = [_strips(t, length, gram) for t in unit.slices(_PIECE)]
    return Strips(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "hash", "text", "start", "many")))


def _ids(unit: Unit) -> np.ndarray:
    """doc_ids as integers, nulls last."""
    if not pa.types.is_integer(unit.ids.type):
        raise TypeError("the order of texts needs integer doc_ids")
    return unit.ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def _firsts(strips: Strips, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strips in order of anchor, bytes and place; and which are the first of their equals."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((strips.start, rank[strips.text], strips.hash, strips.anchor))
    a, h = strips.anchor[order], strips.hash[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (h[1:] != h[:-1]))[: len(order)]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in unpack(batch):
                s = unit_strips(unit, length, gram)
                anchor, n = np.unique(_distinct_anchors(s), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), unit.unit)), pa.array(anchor.view(np.int64)), pa.array(n, pa.int32())], ["unit", "anchor", "n"])

    return run


def _distinct_anchors(s: Strips) -> np.ndarray:
    """The anchor of every distinct strip."""
    order = np.argsort(s.hash)
    h, a = s.hash[order], s.anchor[order]
    return a[np.append(True, (h[1:] != h[:-1]) | (a[1:] != a[:-1]))[: len(a)]]


def _shared_anchors(crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor: (unit, anchor, parts, n) of those with more than one strip."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def found(anchor: np.ndarray, unit: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            size = np.diff(np.append(cut, len(anchor)))
            total = np.repeat(np.add.reduceat(n.astype(np.int64), cut), size)
            keep = total > 1
            parts = -(-total[keep] // crowd)
            return pa.RecordBatch.from_arrays([pa.array(unit[keep]), pa.array(anchor[keep]), pa.array(parts, pa.int32()), pa.array(n[keep], pa.int32())], ["unit", "anchor", "parts", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, unit, n = (np.concatenate([h, batch.column(k).to_numpy()]) for h, k in zip(held, ("anchor", "unit", "n")))
            last = int(np.searchsorted(anchor, anchor[-1]))
            held = [anchor[last:], unit[last:], n[last:]]
            if last:
                yield found(anchor[:last], unit[:last], n[:last])
        if len(held[0]):
            yield found(*held)

    return run


def _copied(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``size`` bytes from ``place`` end to end, and their cuts; indexes are made for a piece at a time."""
    cuts = np.concatenate([[0], np.cumsum(size)])
    body = np.empty(cuts[-1], data.dtype)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _PIECE, "right")) - 1)
        own = np.arange(cuts[at], cuts[end])
        own += np.repeat(place[at:end] - cuts[at:end], size[at:end])
        body[cuts[at] : cuts[end]] = data[own]
        at = end
    return body, cuts


_STRIP = "shard long, anchor long, parts int, doc_id long, unit long, text int, start long, bytes binary"


def _strip_rows(length: int, gram: int, shards: int):
    names = [f.split()[0] for f in _STRIP.split(", ")]

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        """The first of each unit's equal strips, for the anchors that other strips share."""
        asked = answers.column("anchor").to_numpy().view(np.uint64)
        order = np.argsort(asked)
        asked, parts = asked[order], answers.column("parts").to_numpy()[order]
        out = []
        for unit in unpack(units.combine_chunks()):
            s = unit_strips(unit, length, gram)
            ids = _ids(unit)
            by, first = _firsts(s, ids)
            s = s.take(by[first])
            at = np.minimum(np.searchsorted(asked, s.anchor), max(len(asked) - 1, 0))
            hit = asked[at] == s.anchor if len(asked) else np.zeros(len(at), bool)
            s, at = s.take(hit), at[hit]
            split = parts[at].astype(np.uint64)
            shard = (mix(s.anchor + mix(s.hash % split)) % np.uint64(shards)).view(np.int64)
            place = unit.offsets[s.text] + s.start
            size = s.many + length - 1
            body, cuts = _copied(unit.data, place, size)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(body)])
            out.append(
                pa.Table.from_arrays(
                    [pa.array(shard), pa.array(s.anchor.view(np.int64)), pa.array(parts[at], pa.int32()), pa.array(ids[s.text]), pa.array(np.full(len(size), unit.unit)), pa.array(s.text, pa.int32()), pa.array(s.start), bytes_], names
                )
            )
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], pa.schema([(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]))

    return run


#: Verdicts: ``many`` windows from ``start`` go (window null), or, of a split anchor, the one window
#: with this hash is the shard's first and is still to be merged.
_VERDICT = "unit long, text int, start long, many int, anchor long, window long, doc_id long, shard long"


def _runs(flag: np.ndarray, strip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of maximal runs of flagged windows within strips."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) != 1) | (strip[at][1:] != strip[at][:-1]))
    cut = np.flatnonzero(new)
    return at[cut], np.diff(np.append(cut, len(at)))


def equal_windows(data: np.ndarray, length: int) -> np.ndarray:
    """For every place: the number of its class of places with equal windows of ``length`` bytes."""
    array = suffix_array(data, length)
    prefix = common_prefixes(data, array)
    out = np.empty(len(data), np.int64)
    out[array] = np.cumsum(prefix < length)
    return out


def settle(table: pa.Table, length: int) -> pa.Table:
    """One shard: which windows of its strips have an equal before them.

    Equal windows have equal anchors, so anchors are settled apart, some at a time.
    """
    table = table.combine_chunks()
    anchor = table.column("anchor").to_numpy()
    order = np.argsort(anchor, kind="stable")
    ends = np.cumsum(pc.binary_length(table.column("bytes")).to_numpy()[order])
    anchor = anchor[order]
    heads = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))[: len(anchor)], len(anchor))
    out, at = [], 0
    while not out or at < len(heads) - 1:
        done = ends[heads[at] - 1] if heads[at] else 0
        end = max(at + 1, int(np.searchsorted(ends[heads[1:] - 1], done + _PIECE, "right"))) if len(anchor) else at
        out.append(_settled(table.take(pa.array(order[heads[at] : heads[end]])), length))
        at = end
    return pa.concat_tables(out)


def _settled(table: pa.Table, length: int) -> pa.Table:
    """The verdicts on the strips of some anchors."""
    table = table.combine_chunks()
    column = lambda n: table.column(n).to_numpy()
    order = np.lexsort((column("start"), column("text"), column("unit"), column("doc_id")))
    table = table.take(pa.array(order)).combine_chunks()
    anchor, parts = column("anchor"), column("parts")
    blob = table.column("bytes").combine_chunks() if table.num_rows else pa.array([], pa.binary())
    blob = blob if isinstance(blob, pa.Array) else blob.chunk(0)
    cuts = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
    data = np.frombuffer(blob.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    size = np.diff(cuts)
    many = size - length + 1
    # equal strips: all but the earliest go whole
    hashes = span_hashes(data, cuts[:-1], cuts[1:])
    by = np.lexsort((np.arange(len(size)), hashes, anchor))
    new = np.append(True, (anchor[by][1:] != anchor[by][:-1]) | (hashes[by][1:] != hashes[by][:-1]))
    first = np.zeros(len(size), bool)
    first[by[new]] = True
    out = [_verdicts(table, np.flatnonzero(~first), np.zeros((~first).sum(), np.int64), many[~first])]
    # the rest, where an anchor has several strips
    own = np.flatnonzero(first)
    ordered = np.argsort(anchor[own], kind="stable")
    a = anchor[own][ordered]
    alone = np.append(True, a[1:] != a[:-1]) & np.append(a[1:] != a[:-1], True)
    several = np.zeros(len(own), bool)
    several[ordered] = ~alone
    rest = own[several | (parts[own] > 1)]
    if not len(rest):
        return pa.concat_tables(out)
    n = size[rest]
    begin = np.concatenate([[0], np.cumsum(n)])
    body = data[np.arange(begin[-1]) + np.repeat(cuts[:-1][rest] - begin[:-1], n)]
    kind = equal_windows(body, length)
    w = many[rest]
    edges = np.concatenate([[0], np.cumsum(w)])
    strip = np.repeat(np.arange(len(rest)), w)
    within = np.arange(edges[-1]) - edges[:-1][strip]
    place = begin[:-1][strip] + within
    by = np.argsort(kind[place], kind="stable")  # strips are in order, so the first of a class is the earliest
    k = kind[place][by]
    earliest = np.zeros(len(place), bool)
    earliest[by[np.append(True, k[1:] != k[:-1])]] = True
    at, run = _runs(~earliest, strip)
    out.append(_verdicts(table, rest[strip[at]], within[at], run))
    # of split anchors, what stays is still to be merged with the other shards
    open_ = np.flatnonzero(earliest & (parts[rest][strip] > 1))
    if len(open_):
        window = span_hashes(body, place[open_], place[open_] + length)
        out.append(_verdicts(table, rest[strip[open_]], within[open_], np.ones(len(open_), np.int64), window.view(np.int64)))
    return pa.concat_tables(out)


def _verdicts(table: pa.Table, strip: np.ndarray, within: np.ndarray, many: np.ndarray, window: np.ndarray | None = None) -> pa.Table:
    rows = table.select(["unit", "text", "start", "anchor", "doc_id", "shard"]).take(pa.array(strip, pa.int64()))
    start = rows.column("start").to_numpy() + within
    return pa.Table.from_arrays(
        [rows.column("unit"), rows.column("text"), pa.array(start, pa.int64()), pa.array(many, pa.int32()), rows.column("anchor"), pa.array(window, pa.int64()) if window is not None else pa.nulls(len(strip), pa.int64()), rows.column("doc_id"), rows.column("shard")],
        [f.split()[0] for f in _VERDICT.split(", ")],
    )


def merge(table: pa.Table) -> pa.Table:
    """Windows that several shards keep: shard by shard, found among those before by binary search."""
    table = table.combine_chunks()
    column = lambda n: table.column(n).to_numpy()
    # both hashes, so that sixteen bytes tell windows apart
    key = np.stack([column("anchor"), column("window")], 1).astype(">i8").view("S16").ravel()
    place = np.empty(table.num_rows, np.int64)
    place[np.lexsort((column("start"), column("text"), column("unit"), column("doc_id")))] = np.arange(table.num_rows)
    shard = column("shard")
    goes = np.zeros(table.num_rows, bool)
    kept_key, kept_row = np.zeros(0, "S16"), np.zeros(0, np.int64)
    by = np.argsort(key, kind="stable")
    by = by[np.argsort(shard[by], kind="stable")]
    for part in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
        at = np.searchsorted(kept_key, key[part])
        found = np.zeros(len(part), bool)
        inside = at < len(kept_key)
        found[inside] = kept_key[at[inside]] == key[part][inside]
        other = kept_row[at[found]]
        mine = part[found]
        later = place[mine] > place[other]
        goes[mine[later]] = True
        goes[other[~later]] = True
        kept_row[at[found]] = np.where(later, other, mine)
        new = part[~found]
        kept_row = np.insert(kept_row, at[~found], new)
        kept_key = np.insert(kept_key, at[~found], key[new])
    return table.filter(pa.array(goes)).select(["unit", "text", "start", "many"])


def _cut(length: int, gram: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(units: pa.Table, verdicts: pa.Table) -> pa.Table:
        text, start, many = (verdicts.column(n).to_numpy() for n in ("text", "start", "many"))
        out = []
        for unit in unpack(units.combine_chunks()):
            s = unit_strips(unit, length, gram)
            by, first = _firsts(s, _ids(unit))
            again = by[~first]
            t = np.concatenate([text, s.text[again]])
            a = np.concatenate([start, s.start[again]])
            b = a + np.concatenate([many, s.many[again]]) + length - 1
            order = np.argsort(t, kind="stable")
            t, a, b = t[order], a[order], b[order]
            for texts in unit.slices(_PIECE):
                lo, hi = np.searchsorted(t, [texts.first, texts.first + texts.n])
                base = texts.offsets[t[lo:hi] - texts.first]
                edge = np.bincount(base + a[lo:hi], minlength=len(texts.data) + 1) - np.bincount(base + b[lo:hi], minlength=len(texts.data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                count = np.concatenate([[0], np.cumsum(gone)])
                removed = count[texts.offsets[1:]] - count[texts.offsets[:-1]]
                begins = gone & ~np.append(False, gone[:-1])
                heads = texts.offsets[:-1][np.diff(texts.offsets) > 0]
                begins[heads] = gone[heads]
                spans = np.diff(np.searchsorted(np.flatnonzero(begins), texts.offsets))
                digests = []
                for i in range(texts.n):
                    s_, e_ = int(texts.offsets[i]), int(texts.offsets[i + 1])
                    body = texts.data[s_:e_]
                    digests.append(hashlib.sha256((body[~gone[s_:e_]] if removed[i] else body).tobytes()).hexdigest())
                out.append(pa.Table.from_arrays([unit.ids.slice(texts.first, texts.n), pa.array(np.diff(texts.offsets)), pa.array(removed), pa.array(spans), pa.array(digests)], names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    units = pack(docs, "repeat-units", unit_bytes)
    anchors = units.mapInArrow(_anchor_rows(length, gram), "unit long, anchor long, n int")
    shared = materialize(anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared_anchors(crowd), "unit long, anchor long, parts int, n int"), "anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    shards = max(1, int(total) * (length + (length - gram) // 2) // shard_bytes)
    del anchors
    release(spark)
    asked = shared.select("unit", "anchor", "parts")
    strips = together(units, asked).applyInArrow(_strip_rows(length, gram, shards), _STRIP)
    verdicts = materialize(strips.groupBy("shard").applyInArrow(lambda table: settle(table, length), _VERDICT), "verdicts")
    del strips, asked
    release(spark)
    settled = verdicts.where("window IS NULL").select("unit", "text", "start", "many")
    spread = F.pmod(F.xxhash64("anchor", "window"), F.lit(max(1, shards)))
    merged = verdicts.where("window IS NOT NULL").withColumn("to", spread).groupBy("to").applyInArrow(lambda table: merge(table.drop_columns(["to"])), "unit long, text int, start long, many int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return together(units, settled.union(merged)).applyInArrow(_cut(length, gram), schema)
