"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit that is set in over half of the XXH64 values (seed 42) of a
text's word shingles.  Fingerprints that differ in at most ``radius`` bits are linked.  The bits are
split in ``groups`` parts; for every part, the part is erased and all variants of the rest within
half of the radius less one are emitted: of two fingerprints that differ in at most three bits, some
part holds a difference, at most two are left elsewhere, and a variant of each meets a variant of
the other.  Fingerprints that meet are verified; links are reduced to a spanning forest by each
task, and components come from alternating star contractions.

Defined results: null or empty text, or one without words, has fingerprint zero, which is linked
like any other; copies share a fingerprint and are expanded only in the last join; rows that repeat
a doc_id each give a row; a null doc_id is never a component's id unless it has no other; an empty
table gives an empty result; extra columns are ignored.

Scale: variants are made from distinct fingerprints, natively, a bounded number of fingerprints a task, and
sorted by the shuffle, so a task holds one variant's fingerprints at a time.  Copies of one fingerprint are
labelled by a task for each million; the list of such fingerprints, a broadcast, has one entry at most for each
million documents.  The keys keep 42 bits or more, so that chance meetings
stay rare at 10**10 documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connect
from .textbatch import LOWER, Texts, slices, words
from .workspace import materialize

SEED = 42
_CHUNK = 1 << 16


def joined_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words, one space after each; their starts and ends there; the texts' cuts."""
    w = words(texts)
    length = w.end - w.start
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
    total = int(length.sum())
    source = np.arange(total) + np.repeat(w.start - (np.cumsum(length) - length), length)
    out[np.arange(total) + np.repeat(np.arange(len(length)), length)] = LOWER[texts.data[source]]
    return out, start, start + length, w.cuts


def shingle_spans(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of all k-word shingles (of the whole sequence where words are fewer), and their cuts."""
    n = np.diff(cuts)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    shingle_cuts = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(n)), many)
    first = np.arange(shingle_cuts[-1]) - shingle_cuts[doc] + cuts[doc]
    last = np.minimum(first + k, cuts[doc + 1]) - 1
    return start[first], end[last], shingle_cuts


def shingle_hashes(body: bytes, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    return np.fromiter((digest(body[s:e], seed) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def majority(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them, as uint64."""
    n = len(cuts) - 1
    counts = np.zeros((n, 64), dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(cuts, at, "right")) - 1
        last = int(np.searchsorted(cuts, at + len(part), "left"))
        inner = np.maximum(cuts[first:last] - at, 0)
        held = np.diff(np.append(inner, len(part))) > 0
        counts[np.arange(first, last)[held]] += np.add.reduceat(bits, inner[held], axis=0, dtype=np.int64)
    set_ = 2 * counts > np.diff(cuts)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: Texts, k: int = 3) -> np.ndarray:
    body, start, end, cuts = joined_words(texts)
    s, e, shingle_cuts = shingle_spans(start, end, cuts, k)
    return majority(shingle_hashes(body.tobytes(), s, e), shingle_cuts)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                bits = fingerprints_of(texts, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.slice(texts.first, texts.n).column("doc_id"), pa.array(bits)], ["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits long")


def variants(groups: int = 3) -> tuple[list[int], list[int]]:
    """Masks and flips such that (bits & mask) ^ flip are all variants of a fingerprint, radius 3."""
    masks, flips = [], []
    for g in range(groups):
        erased = {b for b in range(64) if b * groups // 64 == g}
        mask = sum(1 << b for b in range(64) if b not in erased)
        for flip in [0, *(1 << b for b in range(64) if b not in erased)]:
            masks.append(mask)
            flips.append(flip)
    return masks, flips


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over the fingerprints that one task has linked; tells which links join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def spanning(bits: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what chains of fingerprints within ``radius`` connect, one for each that is reached."""
    left = np.unique(bits)
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            hit = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            found, left = left[hit], left[~hit]
            yield from zip([int(x)] * len(found), found.tolist())
            reached.extend(found)


def _verified(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: verify what shares a key and emit a spanning forest."""
        forest = Forest()
        held_key = np.zeros(0, np.int64)
        held_bits = np.zeros(0, np.int64)

        def links(keys: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(cut, len(keys)))
            two = cut[size == 2]
            a, b = bits[two], bits[two + 1]
            ok = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            yield from zip(a[ok].tolist(), b[ok].tolist())
            for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
                yield from spanning(bits[at : at + n], radius)

        def emit(pairs) -> Iterator[pa.RecordBatch]:
            new = [(a, b) for a, b in pairs if a != b and forest.join(a, b)]
            if new:
                a, b = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_key, batch.column("key").to_numpy()])
            bits = np.concatenate([held_bits, batch.column("bits").to_numpy()])
            last = int(np.searchsorted(keys, keys[-1]))
            held_key, held_bits = keys[last:], bits[last:]
            if last:
                yield from emit(links(keys[:last], bits[:last]))
        if len(held_key):
            yield from emit(links(held_key, held_bits))

    return run


def linked(distinct: DataFrame, radius: int = 3, groups: int = 3, tasks: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct ``bits`` that connect all fingerprints within ``radius``.

    ``tasks``: in how many tasks variants are made, 131 of each fingerprint.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the variants meet for a radius of at most 3")
    masks, flips = variants(groups)
    literal = lambda xs: "array(" + ",".join(f"{_signed(x)}L" if _signed(x) != -(1 << 63) else "shiftleft(1L, 63)" for x in xs) + ")"
    key = F.expr(f"explode(zip_with({literal(masks)}, {literal(flips)}, (m, f) -> (bits & m) ^ f))")
    spread = distinct.select("bits") if tasks is None else distinct.select("bits").repartition(tasks, "bits")
    return spread.select("bits", key.alias("key")).repartition("key").sortWithinPartitions("key").mapInArrow(_verified(radius), "a long, b long")


#: Fingerprints whose variants one task makes, and copies of a fingerprint that are labelled by one task.
_EACH, _HOT = 50_000, 1 << 20


def group(docs: DataFrame, k: int = 3, radius: int = 3, hot: int = _HOT) -> DataFrame:
    """One row a document: doc_id, fingerprint (hexadecimal), component_id (its least doc_id)."""
    bits = materialize(fingerprints(docs, k), "fingerprints")
    own = materialize(bits.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    roots = connect(linked(own, radius, tasks=-(-own.count() // _EACH) or 1))
    rooted = own.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.ceil(F.col("copies") / hot).alias("salts"), F.coalesce("root", "bits").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.select("bits", "salts", "root").join(ids, "root").select("bits", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    # fingerprints of very many copies go to several tasks; there is at most one for every ``hot`` documents
    many = own.where(F.col("copies") > hot).select("bits", F.ceil(F.col("copies") / hot).alias("salts"))
    spread = bits.join(F.broadcast(many), "bits", "left").select("bits", "doc_id", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0).cast("long")).alias("salt"))
    return spread.join(labels, ["bits", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
