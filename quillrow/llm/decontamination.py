"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a folded form: lower case, and one blank for each run of characters that are
neither letters nor digits; q-grams and edits are of its UTF-8 bytes.  A passage of m bytes matches a
region within an edit budget of e = floor(``budget`` * m).  Such a region shares at least
t = m + 1 - q - q * e of the passage's q-grams, on diagonals no more than e apart; so shared q-grams are
counted in diagonal bands of 2 * (e + 1) that overlap by half, and only bands that reach t are aligned
(within the band, with free ends in the text).  Every region within the budget is found, and none
outside it; of regions that overlap, the one of the fewest edits stays, the leftmost of equals.
Passages of less than ``q`` bytes have a budget of 0 and are found where they stand as whole words.

Defined results: null or empty texts never match; passages that are null or have no letter or digit
identify nothing; for passages of few more than ``q`` bytes the budget is lowered until t is at least 1;
each region is a row; repeated documents or passages each give rows; an empty table gives an empty
result; extra columns are ignored.  Whole texts are searched whatever their length.

Scale: a map over the documents without a shuffle.  The benchmark is cut in blocks so that an index,
whose size is checked before it is broadcast, has at most ``INDEX_BYTES`` (some 20 bytes for each of the
passages, equal ones once).  A larger benchmark is searched block by block, each in a pass of its own
whose result is written, so that executors hold one index at a time.  Hits of q-grams that many
passages share are counted in turns of at most ``HITS``, by ranges of passages and then of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .spans import ALNUM, CodePoints
from .textbatch import LOWER, slices
from .workspace import materialize

Q, BUDGET = 8, 0.1
#: Bytes of an index that is broadcast, and of the passages in a block for each of its bytes.
INDEX_BYTES, PER_BYTE = 128 << 20, 24
#: Shared q-grams that are counted at once.
HITS = 1 << 22
_FOLD = np.where(ALNUM[LOWER] | (np.arange(256) >= 128), LOWER, 0x20).astype(np.uint8)
_FILTER_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 29


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, where each stood, and the texts' offsets among them."""
    b = _FOLD[data]
    if len(b) > 1:  # capital letters of the Latin-1 block, in UTF-8
        capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        b[1:][capital] += 0x20
    keep = b != 0x20
    keep[1:] |= b[:-1] != 0x20
    first = offsets[:-1]
    first = first[first < len(b)]
    keep[first] = b[first] != 0x20  # no blank begins a text
    origin = np.flatnonzero(keep)
    return b[origin], origin, np.searchsorted(origin, offsets)


def fold_text(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return fold(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place, as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def align(passage: bytes, region: np.ndarray, low: int, high: int, free_start: bool = True) -> tuple[int, int]:
    """Least edits between the passage and a part of the region, and where that part ends.

    Only cells whose place in the region less that in the passage is within low .. high are filled.
    """
    k = np.arange(low, high + 1)
    n = len(region)
    row = np.where((k >= 0) & (k <= n), 0 if free_start else k, _FAR)
    padded = np.concatenate([region, [0]])
    for i, c in enumerate(passage, 1):
        j = i + k
        differ = padded[np.clip(j - 1, 0, n)] != c
        new = row + differ
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((j >= 1) & (j <= n), new, np.where(j == 0, i, _FAR))
        row = np.minimum.accumulate(new - k) + k
        row = np.where((j >= 0) & (j <= n), row, _FAR)
    best = int(row.argmin())
    return int(row[best]), len(passage) + int(k[best])


class Index:
    """The q-grams of a block of passages, as flat arrays; equal passages are held once."""

    def __init__(self, ids: list, texts: list[str | None], budget: float) -> None:
        by: dict[bytes, list] = {}
        for i, t in zip(ids, texts):
            if t is not None and (f := fold_text(t)):
                by.setdefault(f, []).append(i)
        self.texts = sorted((f for f in by if len(f) >= Q), key=lambda f: (len(f), f))
        self.ids = [by[f] for f in self.texts]
        self.short: dict[int, dict[bytes, list]] = {}
        for f, own in by.items():
            if len(f) < Q:
                self.short.setdefault(len(f), {})[f] = own
        size = np.array([len(f) for f in self.texts], dtype=np.int64)
        self.edits = np.minimum((budget * size + 1e-9).astype(np.int64), np.maximum(size - Q, 0) // Q)
        self.least = size + 1 - Q - Q * self.edits
        self.size = size
        own = [grams(np.frombuffer(f, np.uint8)) for f in self.texts]
        gram = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own), dtype=np.int32), [len(g) for g in own]) if own else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in own]) if own else np.zeros(0, np.int32)
        order = np.argsort(gram, kind="stable")  # of one gram, passages are in order
        self.item, self.place = item[order], place[order]
        self.gram, start = np.unique(gram[order], return_index=True)
        self.start = np.append(start, len(gram)).astype(np.int32)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self._slot(self.gram)] = True

    @property
    def nbytes(self) -> int:
        """What the broadcast holds, about: arrays, passages and ids."""
        arrays = (self.item, self.place, self.gram, self.start, self.filter, self.size, self.least, self.edits)
        held = [*self.texts, *(f for own in self.short.values() for f in own)]
        ids = [i for own in (*self.ids, *(x for s in self.short.values() for x in s.values())) for i in own]
        return sum(a.nbytes for a in arrays) + sum(len(f) + 64 for f in held) + sum(len(str(i)) + 16 for i in ids)

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * _SPREAD) >> np.uint64(64 - _FILTER_BITS)

    def bands(self, data: np.ndarray, hits: int = HITS) -> tuple[np.ndarray, np.ndarray]:
        """(passage, band) of every band with enough shared q-grams."""
        g = grams(data)
        at = np.flatnonzero(self.filter[self._slot(g)])
        if len(at):
            found = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
            hit = self.gram[found] == g[at]
            at, found = at[hit], found[hit]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [*self._turns(at, self.start[found].astype(np.int64), self.start[found + 1].astype(np.int64), 0, len(self.texts), hits)]
        item, band = (np.concatenate(x) for x in zip(*parts))
        return item, band

    def _turns(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int, last: int, hits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bands of the passages first .. last: hits of the place ``at`` are the entries lo .. hi."""
        total = int((hi - lo).sum())
        if total <= hits or not len(at):
            yield self._count(at, lo, hi)
        elif last - first > 1:
            middle = (first + last) // 2
            cut = lo.copy()  # the first entry of each place that belongs to a passage from the middle on
            wide = hi - lo
            step = 1 << int(wide.max()).bit_length()
            while step:
                ok = (cut + step <= hi) & (self.item[np.minimum(cut + step, hi) - 1] < middle)
                cut[ok] += step
                step >>= 1
            for a, b, f, l in ((lo, cut, first, middle), (cut, hi, middle, last)):
                keep = b > a
                yield from self._turns(at[keep], a[keep], b[keep], f, l, hits)
        else:
            # one passage: parts of the text that overlap by all that a region and its band can span
            reach = int(self.size[first]) + 4 * (int(self.edits[first]) + 1)
            middle = int(at[0] + at[-1]) // 2
            if at[-1] - at[0] <= 4 * reach:
                yield self._count(at, lo, hi)
                return
            for keep in (at <= middle + reach, at >= middle - reach):
                yield from self._turns(at[keep], lo[keep], hi[keep], first, last, hits)

    def _count(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = hi - lo
        if not many.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item = self.item[where].astype(np.int64)
        place = self.place[where].astype(np.int64)
        band = (np.repeat(at, many) - place) // (self.edits[item] + 1)
        # how many hits each narrow band has; a wide band is a narrow one and the next
        own = (item << 40) + band + (1 << 38)
        order = np.argsort(own)
        narrow = own[order]
        cut = np.flatnonzero(np.append(True, narrow[1:] != narrow[:-1]))
        count = np.diff(np.append(cut, len(narrow)))
        first = narrow[cut]
        # a wide band whose lower half is empty is the next one's lower half alone
        follows = np.append(first[1:] == first[:-1] + 1, False)
        full = count + np.where(follows, np.append(count[1:], 0), 0) >= self.least[first >> 40]
        if not full.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = first[full]
        # hits of those bands and of the next ones
        needed = full | np.append(False, (full & follows)[:-1])
        part = order[np.repeat(needed, count)]
        own, place = own[part], place[part]
        # of bands with enough hits, those with enough distinct places of the passage
        keys, places = [], []
        for k in (own, own - 1):
            held = np.isin(k, wide)
            keys.append(k[held])
            places.append(place[held])
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        key = key[np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(cut, len(key)))
        key = key[cut]
        full = count >= self.least[key >> 40]
        return key[full] >> 40, (key[full] & ((1 << 40) - 1)) - (1 << 38)

    def _short_matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
        """Short passages that stand in a text as whole words."""
        if not self.short or not len(data):
            return
        blank = np.append(data == 0x20, np.ones(8, bool))
        edge = np.zeros(len(data) + 9, bool)
        edge[offsets] = True
        begins = np.flatnonzero(~blank[: len(data)] & (np.append(True, blank[: len(data) - 1]) | edge[: len(data)]))
        stop = offsets[np.searchsorted(offsets, begins, "right")]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for length, passages in self.short.items():
            end = begins + length
            ok = (end <= stop) & (blank[np.minimum(end, len(data))] | (end == stop))
            at = begins[ok]
            key = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at] & np.uint64((1 << 8 * length) - 1)
            known = {int.from_bytes(f, "little"): own for f, own in passages.items()}
            hit = np.isin(key, np.fromiter(known, np.uint64, len(known)))
            texts = np.searchsorted(offsets, at[hit], "right") - 1
            for t, a, k in zip(texts.tolist(), at[hit].tolist(), key[hit].tolist()):
                for own in known[k]:
                    yield t, own, 0, a, a + length

    def matches(self, data: np.ndarray, offsets: np.ndarray, hits: int = HITS) -> list[tuple[int, object, int, int, int]]:
        """(text, passage's id, edits, start, end) of every matching region."""
        met: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for item, band in zip(*(x.tolist() for x in self.bands(data, hits))):
            passage, m, e = self.texts[item], int(self.size[item]), int(self.edits[item])
            w = e + 1
            lo, hi = max(0, band * w), min(len(data), band * w + 2 * w + m + e)
            for text in range(max(0, int(np.searchsorted(offsets, lo, "right")) - 1), int(np.searchsorted(offsets, hi, "left"))):
                s, t = max(lo, int(offsets[text])), min(hi, int(offsets[text + 1]))
                if t - s < m - e:
                    continue
                region = data[s:t]
                own = met.setdefault((text, item), set())
                at = region.tobytes().find(passage)
                if at >= 0:
                    own.add((0, s + at, s + at + m))
                    continue
                if e == 0:
                    continue
                shift = band * w - s
                edits, end = align(passage, region, shift - e, shift + 2 * w + e)
                if edits <= e:
                    back = align(passage[::-1], region[:end][::-1], -e, e, free_start=False)[1]
                    own.add((edits, s + end - back, s + end))
        found = [*self._short_matches(data, offsets)]
        for (text, item), regions in met.items():
            taken: list[tuple[int, int]] = []
            for edits, s, t in sorted(regions):
                if not any(a < t and s < b for a, b in taken):
                    taken.append((s, t))
                    found += [(text, own, edits, s, t) for own in self.ids[item]]
        return sorted(found, key=lambda r: (r[0], r[3], r[4], str(r[1])))


def blocks(benchmark: DataFrame, budget: float, most: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over parts of the benchmark, none of more than ``most`` bytes unless one passage alone is."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = -(-(PER_BYTE * (total or 0) + 160 * count) // most)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield from _fitting(part.column("item_id").to_pylist(), part.column("text").to_pylist(), budget, most)


def _fitting(ids: list, texts: list[str], budget: float, most: int) -> Iterator[Index]:
    if not ids:
        return
    index = Index(ids, texts, budget)
    if index.nbytes <= most or len(ids) == 1:
        yield index
        return
    half = len(ids) // 2
    del index
    yield from _fitting(ids[:half], texts[:half], budget, most)
    yield from _fitting(ids[half:], texts[half:], budget, most)


def _passes(benchmark: DataFrame, budget: float, most: int, step, docs: DataFrame | None) -> list[DataFrame]:
    """Apply ``step`` (shared index, the result before) for every block; all but a lone block are written."""
    spark = benchmark.sparkSession
    out: list[DataFrame] = []
    indexes = blocks(benchmark, budget, most)
    index, after = next(indexes, None), next(indexes, None)
    while index is not None:
        shared = spark.sparkContext.broadcast(index)
        result = step(shared, out[-1] if out else docs)
        if out or after is not None:
            result = materialize(result, "leaks")
            shared.destroy()
        out.append(result)
        index, after = after, next(indexes, None)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, most: int = INDEX_BYTES) -> DataFrame:
    """One row a region: doc_id, item_id, edits, start, end (code points)."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_kind.simpleString()}, item_id {item_kind.simpleString()}, edits int, start long, end long"
    kind = to_arrow_type(item_kind)
    texts = docs.select("doc_id", "text")

    def search(shared, _) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for part in slices(batch.column("text")):
                    data, origin, offsets = fold(part.data, part.offsets)
                    rows = own.matches(data, offsets)
                    if not rows:
                        continue
                    points = CodePoints(part)
                    ids = batch.slice(part.first, part.n).column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([r[0] for r in rows])),
                            pa.array([r[1] for r in rows], kind),
                            pa.array([r[2] for r in rows], pa.int32()),
                            pa.array([points(r[0], int(origin[r[3]])) for r in rows], pa.int64()),
                            pa.array([points(r[0], int(origin[r[4] - 1]) + 1) for r in rows], pa.int64()),
                        ],
                        ["doc_id", "item_id", "edits", "start", "end"],
                    )

        return texts.mapInArrow(run, schema)

    found = _passes(benchmark, budget, most, search, None)
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, most: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no passage of the benchmark, all their columns as they are."""

    def clean(shared, kept: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for part in slices(batch.column("text")):
                    data, _, offsets = fold(part.data, part.offsets)
                    for row in shared.value.matches(data, offsets):
                        keep[part.first + row[0]] = False
                yield batch.filter(pa.array(keep))

        return kept.mapInArrow(run, docs.schema)

    return (_passes(benchmark, budget, most, clean, docs) or [docs])[-1]
