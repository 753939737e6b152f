"""Language-model scoring by a weighted backoff automaton.

Tokens are the lower-cased words of a text, then one end.  The n-grams of up to ``order`` tokens that
training texts hold become an automaton:

* a state for each history (an n-gram of less than ``order`` tokens, or a text's start) that training
  texts continue, with an arc for every token seen after it;
* a failure arc from each state to that of the history without its first token, and at last to the root;
* the root has an arc for every token of the training texts, and one for any other (words outside the
  vocabulary are one event, as in the base score).

Every level is smoothed by absolute discounting, with the discount that leave-one-out gives for the
level (n1 / (n1 + 2 n2)), and interpolated with the level below: an arc's weight is the smoothed
probability of its n-gram, a failure arc's what the discounts of its state leave over.  Each state's
arcs, with what is reached by failure, thus make a proper distribution.  A text is read once from left
to right: the state is the longest suffix of what has been read that is a state; a token without an
arc follows failure arcs, whose logarithms add up, until a state has one.  Since a state depends on
the last ``order`` - 1 tokens alone, the states at all places of a unit are found at once.

Counts are of all training texts and nothing is cut: a unit of texts holds its own part of the
automaton, every state and arc that its texts can reach, with weights of the whole corpus.

For that, level by level from the longest n-grams down, each unit sends its distinct n-grams (as
sorted 64-bit hashes with counts, cut in ranges, differences packed by bytes).  A range's task adds
up what all units sent and answers each unit in the same order, with the totals and with a mark at
one of the units that hold the n-gram.  A unit counts its marked n-grams by history; sent with the
level below, that gives the number of distinct successors of every history.  Only totals (a row a
range) reach the driver.

Defined results: null or empty text is the end token alone; a null doc_id counts as the text "" for
the held-out test; repeated rows each train and each give a row; an empty table gives an empty
result, and without training texts every token is unknown; extra columns are ignored.  Whole texts
are read; memory follows the longest text.

Scale: there are as many ranges as units, so a task's memory stays that of a unit.  An n-gram is sent
once by each unit that holds it, however often it stands there; a frequent one is one number a unit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import LOWER, Texts, mix, span_hashes, words
from .units import Unit, pack, together, unpack
from .workspace import dropping_shuffles, materialize, release

#: The hash that stands for the end token: no word has it but by chance, like any other hash.
END, START = np.uint64(0x5EED0E4D00000001), np.uint64(0x5EED0E4D00000002)
FOLDS, ORDER, SMOOTH = 10, 3, 0.1
#: Bytes of text in a unit; of an n-gram a task holds some dozens.
UNIT = 1 << 23
_NONE = np.zeros(0, np.int64)


def held_out(ids: pa.Array, folds: int = FOLDS) -> np.ndarray:
    """crc32 of the doc_id as text, modulo ``folds``, is 0."""
    crc = zlib.crc32
    return np.fromiter((crc(b"" if i is None else str(i).encode()) % folds == 0 for i in ids.to_pylist()), bool, len(ids))


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, ends included, and the texts' cuts."""
    w = words(texts)
    n = w.counts
    out = np.full(len(w.start) + texts.n, END, dtype=np.uint64)
    out[np.arange(len(w.start)) + w.doc] = span_hashes(LOWER[texts.data], w.start, w.end)
    return out, np.concatenate([[0], np.cumsum(n + 1)])


# Packed numbers


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte of all of them: five or six bytes each."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob).view(np.uint64), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


# What a unit knows by itself


@dataclass
class Level:
    """The distinct n-grams of a unit, by hash; sums over the corpus as they become known.

    ``at`` is the n-gram that ends at each place (-1: none so long), ``first`` a place of each n-gram.
    The first level holds the start of a text as well, as a history.
    """

    keys: np.ndarray
    first: np.ndarray
    at: np.ndarray
    own: np.ndarray
    start: int = -1
    count: np.ndarray = field(default_factory=lambda: _NONE)
    after: np.ndarray = field(default_factory=lambda: _NONE)

    def settled(self) -> None:
        """Let go of what only a question needs."""
        self.keys, self.own = self.keys[:0], self.own[:0]


class Grams:
    """The n-grams of the asked levels (and their histories' places) of one unit."""

    def __init__(self, unit: Unit, asked: range) -> None:
        parts = [tokens(texts) for texts in unit.slices()]
        t = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        self.cuts = np.concatenate([[0], *(p[1][1:] + e for p, e in zip(parts, ends))]).astype(np.int64)
        self.test = held_out(unit.ids)
        live = np.repeat(~self.test, np.diff(self.cuts))
        begins = np.zeros(len(t), bool)
        begins[self.cuts[:-1]] = True
        key, valid = t, np.ones(len(t), bool)
        token = mix(t + START)
        self.levels: dict[int, Level] = {}
        for n in range(1, asked.stop):
            if n > 1:
                before = np.empty_like(key)
                before[1:] = key[:-1]
                if n == 2:
                    before[begins] = START
                else:
                    ok = np.empty_like(valid)
                    ok[1:] = valid[:-1]
                    valid = ok & ~begins
                key = mix(before ^ token)
            if n in asked:
                self.levels[n] = self._level(key, valid, live, int((~self.test).sum()) if n == 1 else None)

    @staticmethod
    def _level(key: np.ndarray, valid: np.ndarray, live: np.ndarray, texts: int | None) -> Level:
        place = np.flatnonzero(valid).astype(np.int32)
        place = place[np.argsort(key[place])]
        own = key[place]
        new = np.append(True, own[1:] != own[:-1])[: len(own)]
        cut = np.flatnonzero(new)
        at = np.full(len(key), -1, np.int32)
        at[place] = np.cumsum(new, dtype=np.int32) - 1
        count = np.add.reduceat(live[place], cut, dtype=np.int32) if len(cut) else np.zeros(0, np.int32)
        keys, first, s = own[cut], place[cut], -1
        if texts is not None:  # the start of a text is a history as often as there are training texts
            s = int(np.searchsorted(keys, START))
            keys, first, count = np.insert(keys, s, START), np.insert(first, s, -1), np.insert(count, s, texts)
            at += at >= s
        return Level(keys, first, at, count, s)

    def histories(self, n: int, places: np.ndarray) -> np.ndarray:
        """For places where n-grams of level n + 1 end: the number of the history among level n."""
        level = self.levels[n]
        before = level.at[places - 1]
        return np.where(np.isin(places, self.cuts[:-1]), level.start, before) if n == 1 else before


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the ranges of hashes begins among sorted keys."""
    width = (1 << 64) // parts + 1
    return np.searchsorted(keys, np.array([k * width for k in range(parts)], dtype=np.uint64))


def _read(levels: dict[int, Level], answers: pa.Table, unit: int) -> dict[int, np.ndarray]:
    """Fill in the totals that were answered; returns the marks by level."""
    marks = {}
    answers = answers.sort_by([("level", "ascending"), ("part", "ascending")])
    of, whose = answers.column("level").to_numpy(), answers.column("unit").to_numpy()
    for n, level in levels.items():
        rows = np.flatnonzero((of == n) & (whose == unit))
        join = lambda name: np.concatenate([_NONE, *(unpack_numbers(answers.column(name)[int(i)].as_py()) for i in rows)])  # noqa: E731, B023
        level.count, level.after, marks[n] = join("counts"), join("after"), join("marks").astype(bool)
    return marks


_SENT = "part int, unit long, level int, keys binary, counts binary, after binary"
_ANSWER = "unit long, part int, level int, counts binary, after binary, marks binary, stats array<long>"
_BLOBS = (pa.binary(), pa.binary(), pa.binary())


def _sent(grams: Grams, unit: int, n: int, after: np.ndarray, parts: int) -> pa.Table:
    level = grams.levels[n]
    cuts = np.append(_ranges(level.keys, parts), len(level.keys))
    spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
    blobs = [[pack_sorted(level.keys[s]) for _, s in spans], [pack_numbers(level.own[s].astype(np.int64)) for _, s in spans], [pack_numbers(after[s]) for _, s in spans]]
    columns = [pa.array([k for k, _ in spans], pa.int32()), pa.array([unit] * len(spans), pa.int64()), pa.array([n] * len(spans), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in _SENT.split(", ")])


def _top(n: int, parts: int):
    """The longest n-grams of each unit; nothing follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in unpack(batch):
                grams = Grams(unit, range(n, n + 1))
                yield from _sent(grams, unit.unit, n, np.zeros(len(grams.levels[n].keys), np.int64), parts).to_batches()

    return run


def _below(n: int, parts: int):
    """The n-grams of a level, with how many marked ones of the level above continue them."""

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for unit in unpack(units.combine_chunks()):
            grams = Grams(unit, range(n, n + 2))
            marks = _read(grams.levels, answers, unit.unit)[n + 1]
            longer = grams.levels[n + 1]
            history = grams.histories(n, longer.first[marks & (longer.first >= 0)])
            out.append(_sent(grams, unit.unit, n, np.bincount(history, minlength=len(grams.levels[n].keys)), parts))
        return pa.concat_tables(out) if out else _empty(_SENT)

    return run


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist([], pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]))


def add_up(table: pa.Table) -> pa.Table:
    """One range: totals for every unit in the order it sent them, marks, and the range's sums.

    stats: n-grams seen once, seen twice, seen, and their counts; texts' starts aren't n-grams.
    """
    table = table.sort_by("unit")
    decode = lambda name, f: [f(x.as_py()) for x in table.column(name)]
    keys = decode("keys", unpack_sorted)
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    key, own, more = (np.concatenate(x) for x in (keys, decode("counts", unpack_numbers), decode("after", unpack_numbers)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(cut, len(key)))
    own = own[order]
    sums, successors = np.add.reduceat(own, cut), np.add.reduceat(more[order], cut)
    # of the units that hold it in training texts, the first is marked
    seen = np.cumsum(own > 0)
    before = np.repeat(seen[cut] - (own[cut] > 0), many)
    mark = (own > 0) & (seen - before == 1)
    back = np.empty((3, len(key)), np.int64)
    back[:, order] = np.repeat(sums, many), np.repeat(successors, many), mark
    counted = sums[key[cut] != START]
    stats = [int((counted == 1).sum()), int((counted == 2).sum()), int((counted > 0).sum()), int(counted.sum())]
    blobs = [[pack_numbers(x) for x in np.split(b, sizes)] for b in back]
    columns = [table.column("unit"), table.column("part"), table.column("level"), *(pa.array(b, pa.binary()) for b in blobs), pa.array([stats] + [None] * (table.num_rows - 1), pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in _ANSWER.split(", ")])


def discount(ones: int, twos: int) -> float:
    """What leave-one-out takes off each count; kept within 0.1 and 0.9 where few counts tell."""
    return min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class Model:
    total: int  # N
    distinct: int  # V
    discounts: list[float]  # by level


class Automaton:
    """A unit's part of the automaton.

    The states of level n are the n-grams of ``levels[n]`` (n < order) with a count; ``failure[n]`` is
    the logarithm of their failure arcs' weights.  The arcs of level n are those n-grams of
    ``levels[n]`` with a count, leaving the state of level n - 1; ``arc[n]`` is the logarithm of their weights.
    """

    def __init__(self, grams: Grams, model: Model) -> None:
        self.grams, self.model = grams, model
        self.order = max(grams.levels)
        first = grams.levels[1]
        cut, total = model.discounts[0], max(model.total, 1)
        chance = np.where(first.count > 0, (first.count - cut) / total, cut * model.distinct / total if model.total else 1.0)
        self.arc, self.failure = {1: np.log10(chance)}, {}
        for n in range(2, self.order + 1):
            level, below = grams.levels[n], grams.levels[n - 1]
            cut = model.discounts[n - 1]
            ok = below.count > 0
            left = np.where(ok, cut * below.after / np.maximum(below.count, 1), 1.0)
            # a history that only held-out texts hold, or that ends a text, is no state; its weight is never used
            self.failure[n - 1] = np.log10(np.where(left > 0, left, 1.0))
            history, shorter = grams.histories(n - 1, level.first), below.at[level.first]
            seen = np.maximum(level.count - cut, 0) / np.maximum(below.count[history], 1)
            chance = np.where(ok[history], seen + left[history] * chance[shorter], chance[shorter])
            self.arc[n] = np.log10(chance)

    def run(self) -> dict[str, np.ndarray]:
        grams, model = self.grams, self.model
        cuts, at = grams.cuts, grams.levels[1].at
        count = grams.levels[1].count[at]
        base = np.log10((count + SMOOTH) / (model.total + SMOOTH * (model.distinct + 1)))
        places = np.arange(len(at))
        log = np.zeros(len(at))
        waiting = np.ones(len(at), bool)
        for n in range(self.order, 0, -1):
            # arrived at level n - 1, by failure or because no longer history is a state
            level = grams.levels[n]
            here = places[waiting & (level.at >= 0)]
            gram = level.at[here]
            if n > 1:
                state = grams.histories(n - 1, here)
                real = grams.levels[n - 1].count[state] > 0
                here, gram, state = here[real], gram[real], state[real]
            arc = level.count[gram] > 0 if n > 1 else np.ones(len(gram), bool)
            log[here[arc]] += self.arc[n][gram[arc]]
            waiting[here[arc]] = False
            if n > 1:
                log[here[~arc]] += self.failure[n - 1][state[~arc]]
        fold = lambda x: np.add.reduceat(x, cuts[:-1]) if len(x) else x
        return {"n_tokens": np.diff(cuts), "n_known": fold((count > 0).astype(np.int64)), "base_score": fold(base), "score": fold(log)}


def _scores(model: Model, order: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for unit in unpack(units.combine_chunks()):
            grams = Grams(unit, range(1, order + 1))
            for level in grams.levels.values():
                level.settled()
            _read(grams.levels, answers, unit.unit)
            r = Automaton(grams, model).run()
            n = len(unit.ids)
            columns = [unit.ids, pa.array(grams.test), pa.array(r["n_tokens"], pa.int64()), pa.array(r["n_known"], pa.int64()), pa.array(np.full(n, model.total), pa.int64()), pa.array(r["base_score"]), pa.array(r["score"])]
            out.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if order < 2:
        raise ValueError("an automaton with failure arcs has an order of at least 2")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = pack(docs, "lm-units", UNIT)
    parts = max(1, units.count())
    known: list[DataFrame] = []
    discounts: list[float] = []
    stats = None
    with dropping_shuffles(spark):
        for n in range(order, 0, -1):
            sent = together(units, known[-1]).applyInArrow(_below(n, parts), _SENT) if known else units.mapInArrow(_top(n, parts), _SENT)
            added = sent.repartition(parts, "part").groupBy("part").applyInArrow(add_up, _ANSWER)
            known.append(materialize(added, f"lm-{n}"))
            del sent, added
            release(spark)
            stats = known[-1].select(*(F.sum(F.col("stats")[k]) for k in range(4))).first()
            discounts.append(discount(stats[0] or 0, stats[1] or 0))
    model = Model(stats[3] or 0, stats[2] or 0, discounts[::-1])
    answers = known[0]
    for other in known[1:]:
        answers = answers.union(other)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together(units, answers.drop("stats")).applyInArrow(_scores(model, order), schema)
