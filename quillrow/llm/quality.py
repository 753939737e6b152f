"""Quality rules: counts of each text, and how often its lines stand in other documents of its host.

Lines are normalised (A-Z lower-cased, digits as 0, only letters, digits and bytes above 0x7F kept)
and hashed.  A host is a document's source.  A line's frequency is the number of distinct documents
of the host that hold it; documents count as one where the sets of their lines are the same, so that
copies of one document aren't taken for boilerplate.  Lines whose frequency
passes the limit (``min_documents``, or ``share`` of the host's distinct documents if that is more)
are removed, and a document is depleted when less than ``min_left`` of its words are left.

Defined results: null or empty text has no words and fails the base rules; a null source is a host
of its own; rows that repeat a doc_id are judged separately; an empty table gives an empty result;
extra columns are ignored.

Scale: texts are read once by a map that keeps one row a document with its line hashes, written to
the shared folder; what is shuffled is a hash and an identity a line, pre-aggregated by task.  The join that
finds the frequent lines of documents shuffles both sides for itself alone, so adaptive execution splits the
partition of a line that very many documents hold.  A single text is held whole by its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import LOWER, Texts, mix, slices, span_hashes, words
from .workspace import materialize

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KEPT = np.zeros(256, dtype=bool)
_KEPT[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
_FOLD = LOWER.copy()
_FOLD[list(b"0123456789")] = ord("0")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " line array<long>, line_words array<int>, whole long"
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether an earlier one is."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    ordered = keys[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    any_, earlier = np.empty(len(keys), bool), np.empty(len(keys), bool)
    any_[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return any_, earlier


def _line_hashes(body: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each line's MD5: lines are few beside words, and SQL has it too."""
    md5 = hashlib.md5
    digests = b"".join(md5(body[s:e]).digest()[:8] for s, e in zip(start.tolist(), end.tolist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def measure(texts: Texts) -> dict[str, np.ndarray | list]:
    """The base counts of every text, and its distinct normalised lines with their words."""
    data, offsets = texts.data, texts.offsets
    w = words(texts)
    found = w.counts
    doc = w.doc
    char = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(char)])
    word_chars = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    hashes = span_hashes(data, w.start, w.end)

    covered = np.zeros(len(doc) + 2, dtype=bool)
    if len(doc) > 2:
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        three = mix(hashes[at] * _A + hashes[at + 1] * _B + hashes[at + 2] * _C) + mix(doc[at].astype(np.uint64) + _A)
        hit = at[_repeated(three)[0]]
        for k in range(3):
            covered[hit + k] = True
    repeat = np.diff(np.searchsorted(np.flatnonzero(covered), w.cuts))

    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    begins[1:] |= data == 0x0A
    start = np.flatnonzero(begins[:-1])
    end = np.append(start[1:], len(data)) if len(start) else start
    end = end - (data[end - 1] == 0x0A) if len(end) else end
    first = np.searchsorted(w.start, start)
    line_words = np.searchsorted(w.start, end) - first
    start, end, line_words = start[line_words > 0], end[line_words > 0], line_words[line_words > 0]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    exact = span_hashes(data, start, end) + mix(line_doc.astype(np.uint64) + _B)
    dup = np.bincount(line_doc[_repeated(exact)[1]], minlength=texts.n)

    folded = _FOLD[data]
    keep = _KEPT[folded]
    moved = np.concatenate([[0], np.cumsum(keep)])
    normal = _line_hashes(folded[keep].tobytes(), moved[start], moved[end])
    order = np.lexsort((normal, line_doc))
    d, h, n = line_doc[order], normal[order], line_words[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    d, h = d[at], h[at].view(np.int64)
    n = np.add.reduceat(n, at) if len(at) else n
    cuts = np.searchsorted(d, np.arange(texts.n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64) + _A), dtype=np.uint64)])
    return {
        "n_words": found,
        "word_chars": word_chars[w.cuts[1:]] - word_chars[w.cuts[:-1]],
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "line": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h, pa.int64())),
        "line_words": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(n, pa.int32())),
        "whole": (sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64),  # one for each set of lines
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            counts = measure(texts)
            rows = batch.slice(texts.first, texts.n)
            columns = [rows.column("doc_id"), rows.column("source"), rows.column("text_hash")]
            columns += [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in counts.values()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "text_hash", *counts])


def judge(docs: DataFrame, min_documents: int = 10, share: float = 0.01, min_left: float = 0.3, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row a document: the base counts, base_failed, kept, and the words its frequent lines hold.

    With them go source and text_hash (XXH64 of the text), which tell rows of one doc_id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    measured = own.mapInArrow(_run, f"doc_id {kind}, source string, text_hash long, {SCHEMA}")
    rows = materialize(measured.withColumn("row", F.monotonically_increasing_id()), "quality")
    host = [F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("hostless")]
    lines = rows.select(
        *host,
        "row",
        "whole",
        F.explode(F.arrays_zip("line", "line_words")).alias("l"),
    ).select("host", "hostless", "row", "whole", F.col("l.line").alias("line"), F.col("l.line_words").alias("words"))
    documents = rows.select(*host, "whole").distinct().groupBy("host", "hostless").agg(F.count("*").alias("documents"))
    frequent = (
        lines.select("host", "hostless", "line", "whole")
        .distinct()
        .groupBy("host", "hostless", "line")
        .agg(F.count("*").alias("held_by"))
        .where(F.col("held_by") > min_documents)
        .join(documents, ["host", "hostless"])
        .where(F.col("held_by") > F.col("documents") * share)
        .select("host", "hostless", "line")
    )
    removed = lines.join(frequent, ["host", "hostless", "line"]).groupBy("row").agg(F.sum("words").alias("frequent_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        rows.drop("line", "line_words", "whole")
        .join(removed, "row", "left")
        .withColumn("frequent_words", F.coalesce("frequent_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("frequent_words") >= F.col("n_words") * min_left))
        .drop("row")
    )


def without_rejected(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, all their columns as they are.

    Every row has its own verdict; rows of the same doc_id, source and text share it, as they must.
    """
    gone = judge(docs, **limits).where(~F.col("kept")).select(F.col("doc_id").alias("g_id"), F.col("source").alias("g_source"), F.col("text_hash").alias("g_hash")).distinct().hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(gone["g_id"]) & docs["source"].cast("string").eqNullSafe(gone["g_source"]) & (F.xxhash64(docs["text"]) == gone["g_hash"])
    return docs.join(gone, same, "left_anti")
