"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut where the tokenizer's special strings stand (each counts one token), the rest by the
tokenizer's own splitting pattern.  Each piece starts as one symbol a byte; the adjacent pair of
lowest rank is merged, leftmost first, until no pair has a rank.  A piece's count is its initial
symbols minus its merges; no identifiers are made.  Counts of pieces are remembered by each worker
in a table of bounded size, which only saves time.

Defined results: null or empty text counts 0 bytes and 0 tokens; repeated rows each give a row; an
empty table gives an empty result; extra columns are ignored.  A text is handled whole, whatever
its length: the longest piece sets the memory needed.

Scale: a map over the documents, without a shuffle; only (doc_id, text) are read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Pieces remembered by a worker, and the longest kept (in characters).
MEMO_PIECES, MEMO_LENGTH = 700_000, 40
BATCH_ROWS = 2000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairMerger(dict):
    """Maps a piece to its token count; pieces not met before are merged and remembered."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        super().__init__()
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        alphabet = byte_alphabet()
        self.of_byte = [number(alphabet[b]) for b in range(256)]
        #: rank and merged symbol by pair of symbols
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.rules.setdefault((number(left), number(right)), (rank, number(left + right)))

    def __missing__(self, piece: str) -> int:
        count = self.count(piece.encode())
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = count
        return count

    def count(self, piece: bytes) -> int:
        n = len(piece)
        of, get = self.of_byte, self.rules.get
        symbol = [of[b] for b in piece]
        heap = []
        for i in range(n - 1):
            rule = get((symbol[i], symbol[i + 1]))
            if rule is not None:
                heap.append((rule[0], i, symbol[i + 1], rule[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left_of = symbol[:]  # the symbol at a place when a heap entry for it is checked
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, right, merged = pop(heap)
            j = after[i]
            # stale entries: the place was merged away, or either symbol has changed since
            if left_of[i] < 0 or j >= n or left_of[j] != right:
                continue
            rule = get((left_of[i], right))
            if rule is None or rule[0] != rank:
                continue
            merges += 1
            left_of[i] = merged
            left_of[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rule = get((merged, left_of[k]))
                if rule is not None:
                    push(heap, (rule[0], i, left_of[k], rule[1]))
            h = before[i]
            if h >= 0:
                rule = get((left_of[h], merged))
                if rule is not None:
                    push(heap, (rule[0], h, merged, rule[1]))
        return n - merges


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from text to token count, for a byte-level vocabulary file of ``tokenizers``."""
    import public_tokenizers
    import regex

    spec = json.load(open(path, encoding="utf-8"))
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merger = PairMerger(merges)
    pieces = regex.compile(public_tokenizers.PATTERN).findall
    specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    lookup = merger.__getitem__

    def count(text: str) -> int:
        if cut is None or not cut.search(text):
            return sum(map(lookup, pieces(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(lookup, pieces(p))) for p in parts)

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                text = pc.fill_null(batch.column("text"), "")
                n = pa.array([count(t.as_py()) for t in text], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
