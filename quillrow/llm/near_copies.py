"""Near copies by word shingles: candidates by SimHash and by minimum hashes of the shingle sets, verified exactly.

Each text has the fingerprint of ``simhash``, over its ``k``-word shingles; fingerprints within three bits are found
by the same ball hashing that meets in the middle, and make their texts candidates.  At a similarity of 0.8
fingerprints differ in 5 to 14 bits, which no ball of three reaches, so the rest has a way of its own.  Of each text's set of ``k``-word shingles (the sets that the rule compares) the minima under 60 hash
functions are taken; two texts agree on each with a chance equal to their Jaccard similarity, wherever
and however they differ.  The functions form groups of six, and each five of a group make a key.  What
shares a key is checked by one bit of every minimum.  Texts that may be alike form clusters; within
them the exact Jaccard similarity of the sets decides every link that could join two groups.

Two texts of similarity s share five of a group with a chance p = 6 s**5 - 5 s**6, and some key with
1 - (1 - p)**10: at 0.8 all but 0.00003 of the pairs, at 0.85 all but 4e-7.  The check loses fewer than
0.00001 of the pairs at 0.8.

Defined results: texts with the same lower-cased words are one group, those without words among
them; texts of fewer than ``k`` words are alike only if their words are the same; of rows that
repeat a doc_id and a text one is kept; a text that only rows without doc_id have is compared for
equality alone, and its id comes after all others; an empty table gives an empty result; other columns are
returned as they are, whatever their names.  Rows whose id is null or repeated are settled apart from the
others, whose plan is the same with and without them.

Scale: exact copies collapse before anything else, so a group of copies costs one row.  The 60 keys
of a text and the 131 of a fingerprint are shuffled as 16 bytes; texts are shuffled twice.  Clusters are verified in blocks, so a task holds two
blocks of shingle sets; what is already connected isn't compared again, nor what can't reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connect
from .simhash import _EACH, Forest, _verified, joined_words, linked, majority, shingle_hashes, shingle_spans
from .textbatch import Texts, mix, slices, span_hashes
from .workspace import discard, materialize

GROUPS, MEMBERS, CHECK_BITS = 10, 6, 18
_SEEDS = np.random.default_rng(20240511).integers(1, 1 << 63, (GROUPS * MEMBERS, 2), dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 15
BLOCK = 256
#: Shingles that are numbered at once, and columns of an incidence matrix.
_PIECE, _COLUMNS = 1 << 20, 4096


def _whole(body: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's words, and their bytes."""
    n = np.diff(cuts)
    lo = np.where(n > 0, start[np.minimum(cuts[:-1], max(len(start) - 1, 0))] if len(start) else 0, 0)
    hi = np.where(n > 0, end[np.maximum(cuts[1:] - 1, 0)] if len(end) else 0, 0)
    return span_hashes(body, lo, hi), hi - lo


def minima(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The least value of each run of hashes under every hash function: functions by runs."""
    out = np.full((len(_SEEDS), len(cuts) - 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        first = int(np.searchsorted(cuts, at, "right")) - 1
        last = int(np.searchsorted(cuts, at + len(part), "left"))
        inner = np.maximum(cuts[first:last] - at, 0)
        held = np.diff(np.append(inner, len(part))) > 0
        place, inner = np.arange(first, last)[held], inner[held]
        for row, (flip, factor) in zip(out, _SEEDS):
            row[place] = np.minimum(row[place], np.minimum.reduceat((part ^ flip) * factor, inner))
    return out


def sketch(texts: Texts, k: int) -> dict[str, np.ndarray]:
    """Two hashes of the words, their number, the fingerprint, a bit of each minimum, and the keys (texts by keys)."""
    body, start, end, cuts = joined_words(texts)
    s, e, shingle_cuts = shingle_spans(start, end, cuts, k)
    whole, size = _whole(body, start, end, cuts)
    fingerprint = majority(shingle_hashes(body.tobytes(), s, e), shingle_cuts)
    least = mix(minima(span_hashes(body, s, e), shingle_cuts))
    bits = np.zeros(texts.n, dtype=np.uint64)
    for i, row in enumerate(least):
        bits |= (row & np.uint64(1)) << np.uint64(i)
    # a group's key is the sum of its members' hashes without one's, each mixed with its place
    placed = mix(least + _SEEDS[:, :1])
    keys = np.empty((texts.n, len(_SEEDS)), dtype=np.uint64)
    for i, own in enumerate(placed):
        g = i // MEMBERS * MEMBERS
        keys[:, i] = mix(placed[g : g + MEMBERS].sum(0) - own + np.uint64(i))
    return {"same": whole.view(np.int64), "size": size, "many": np.diff(cuts), "print": fingerprint.view(np.int64), "bits": bits.view(np.int64), "keys": keys.view(np.int64)}


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                columns = sketch(texts, k)
                ids = batch.slice(texts.first, texts.n).column("doc_id")
                keys = columns.pop("keys")
                ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in columns.values()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["doc_id", *columns, "keys"])

    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                body, start, end, cuts = joined_words(texts)
                s, e, shingle_cuts = shingle_spans(start, end, cuts, k)
                h = span_hashes(body, s, e).view(np.int64)
                sets = [np.unique(h[a:b]) for a, b in zip(shingle_cuts[:-1], shingle_cuts[1:])]
                rows = batch.slice(texts.first, texts.n)
                whole, _ = _whole(body, start, end, cuts)
                own = rows.column("same").to_numpy() == whole.view(np.int64)  # else another row of the doc_id
                rows, sets = rows.filter(pa.array(own)), [x for x, o in zip(sets, own) if o]
                if not sets:
                    continue
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("root"), rows.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))],
                    ["root", "node", "shingles"],
                )

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.searchsorted(a, b)
    both = int((a[np.minimum(both, len(a) - 1)] == b).sum())
    return both >= similarity * (len(a) + len(b) - both)


def _in_common(values: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values every left row has in common with every right row, by products of incidence matrices."""
    both = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24
    place = np.full((2, max(left.max(), right.max()) + 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    pieces = -(-len(values) // _PIECE)
    part = values.view(np.uint64) % np.uint64(pieces)
    for piece in range(pieces):
        own = part == piece
        _, column = np.unique(values[own], return_inverse=True)
        sides = [p[row[own]] for p in place]
        shared = np.logical_and(*(np.bincount(column[s >= 0], minlength=column.max(initial=-1) + 1) > 0 for s in sides))
        if left is right or len(left) == len(right) and (left == right).all():
            shared &= np.bincount(column) > 1
        column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
        order = np.argsort(column, kind="stable")
        column, sides = column[order], [s[order] for s in sides]
        for at in range(0, int(shared.sum()), _COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
            a, b = (np.zeros((n, _COLUMNS), np.float32) for n in both.shape)
            for matrix, s in zip((a, b), sides):
                there = s[lo:hi] >= 0
                matrix[s[lo:hi][there], column[lo:hi][there] - at] = 1
            both += a @ b.T
    return both.astype(np.float64)


def _links(similarity: float):
    def run(table):
        """A forest of links between the rows of one block or pair of blocks.

        Rows that share a ``comp`` are connected already; of two sides only pairs across count.
        """
        table = table.sort_by("node").combine_chunks()
        node, comp, side = (table.column(n).to_numpy() for n in ("node", "comp", "side"))
        lists = table.column("shingles").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
        size = lists.value_lengths().to_numpy()
        whole = np.arange(len(node))
        across = len(np.unique(side)) > 1
        left, right = (np.flatnonzero(side == side.max()), np.flatnonzero(side == side.min())) if across else (whole, whole)
        both = _in_common(lists.flatten().to_numpy(), np.repeat(whole, size), left, right)
        near = (both >= similarity * (size[left][:, None] + size[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        i, j = np.nonzero(near if across else np.tril(near, -1))
        i, j = left[i], right[j]
        forest = Forest()
        new = [forest.join(x, y) for x, y in zip(comp[i].tolist(), comp[j].tolist())]
        return pa.table({"a": pa.array(node[i][new], pa.int64()), "b": pa.array(node[j][new], pa.int64())})

    return run


def _may_link(sets: DataFrame, similarity: float) -> DataFrame:
    """The sets that could reach the similarity with another of their cluster.

    Two sets of sizes x and y reach s if they have s / (1 + s) * (x + y) in common, and none has more in common than
    it holds of what others hold too.  So a set reaches sizes up to a bound, and only from those that reach its own.
    """
    held = sets.select("root", "node", F.explode("shingles").alias("shingle")).groupBy("root", "shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = held.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    size = F.size("shingles")
    reach = (size - F.coalesce("own", F.lit(0))) * (1 + 1 / similarity) - size + 0.001
    texts = sets.join(own, "node", "left").select("root", "node", size.alias("size"), reach.alias("reach"))
    kinds = texts.groupBy("root", "size").agg(F.max("reach").alias("top"), F.count("*").alias("n")).withColumnsRenamed({"root": "cluster", "size": "other"})
    fits = (F.col("other") <= F.col("reach")) & (F.col("size") <= F.col("top")) & (F.col("other") >= similarity * F.col("size") - 0.001) & ((F.col("other") != F.col("size")) | (F.col("n") > 1))
    return sets.join(texts.join(kinds, (F.col("root") == F.col("cluster")) & fits, "left_semi").select("node"), "node", "left_semi")


def _verified_links(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) with the connectivity of all pairs of a cluster that reach the similarity.

    sets: root (the cluster), node, shingles.  Clusters of one block are compared whole.  Of a larger one the texts
    that hold too much of their own to reach any other are left out.  The others are compared within blocks, then
    representatives of what is connected, again and again: a group of copies falls together in a few rounds, each
    linear in what is left.  Then all that isn't in the cluster's largest component is compared with everything in
    the others.
    """
    find = lambda rows, *by: rows.groupBy(*by).applyInArrow(_links(similarity), "a long, b long")
    alone = lambda rows: rows.withColumn("comp", F.col("node")).withColumn("side", F.lit(0))

    def blocked(rows: DataFrame, turn: int) -> DataFrame:
        count = rows.groupBy("root").agg(F.count("*").alias("members"))
        place = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("members") / block))
        return find(alone(rows.join(count, "root").withColumn("block", place).drop("members")), "root", "block")

    large = sets.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > block).select("root")
    if not large.limit(1).count():
        return materialize(blocked(sets, 0), "verified")
    rest = materialize(_may_link(sets.join(large, "root"), similarity), "large")
    links = materialize(find(alone(sets.join(large, "root", "left_anti")), "root").union(blocked(rest, 0)), "verified")
    before = rest.count()
    for turn in range(1, 40):
        grouped = connect(links)
        leaders = rest.join(grouped, "node", "left_anti")
        left = leaders.count()
        # a round that joins few costs more than it saves the comparison below, which takes all that is left
        if left >= 0.9 * before:
            break
        before = left
        links = materialize(links.union(blocked(leaders, turn)), "verified")
    placed = rest.join(grouped, "node", "left").select(rest["root"], "node", "shingles", F.coalesce(grouped["root"], "node").alias("comp"))
    sizes = placed.groupBy("root", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n0"), F.sum("n").alias("n")).where("n > n0")
    lists = (
        placed.join(main, "root")
        .withColumn("side", F.when(F.col("comp") == F.col("main"), 0).otherwise(1))
        .withColumn("b0", F.ceil(F.col("n0") / block))
        .withColumn("b1", F.ceil((F.col("n") - F.col("n0")) / block))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))))
    )
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    across = lists.withColumn("other", F.explode(F.when(F.col("side") == 0, upto("b1")).otherwise(upto("b0"))))
    across = across.select("root", F.lit(0).alias("kind"), F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("q"), "node", "comp", "side", "shingles")
    outer = lists.where("side = 1").withColumn("other", F.explode(upto("b1")))
    outer = outer.select("root", F.lit(1).alias("kind"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "comp", F.lit(0).alias("side"), "shingles")
    return links.union(find(across.union(outer), "root", "kind", "p", "q"))


def _of_one_ball(texts: DataFrame) -> DataFrame:
    """Links (a, b) between the ``bits`` of texts whose fingerprints are connected by steps of three bits or fewer."""
    own = materialize(texts.select(F.col("print").alias("bits")).distinct(), "prints")
    balls = connect(linked(own, tasks=-(-own.count() // _EACH) or 1)).withColumnRenamed("node", "print")
    placed = texts.select("print", "bits").join(balls, "print", "left").select("bits", F.coalesce("root", "print").alias("ball")).distinct()
    least = placed.groupBy("ball").agg(F.min("bits").alias("b"))
    return placed.join(least, "ball").where("bits <> b").select(F.col("bits").alias("a"), "b")


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8, check_bits: int = CHECK_BITS, block: int = BLOCK) -> DataFrame:
    """The documents without near copies: of each group, the row of the least doc_id stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "same long, size long, many long, print long, bits long, keys array<long>"
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_sketches(k), f"doc_id {kind}, {fields}"), "sketches")
    # ids of several rows, and null, don't tell a row
    shared = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "shared-ids")
    repeated = shared.limit(1).count() > 0
    texts = rows.groupBy("same", "size").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("many", "print", "bits", "keys")))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    keys = texts.where(F.col("many") >= k).select("bits", F.explode("keys").alias("key"))
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(check_bits), "a long, b long")
    roots = connect(met.union(_of_one_ball(texts.where(F.col("many") >= k))))
    placed = texts.where(F.col("many") >= k).join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("node", "doc_id", "same", F.coalesce("root", "bits").alias("root"))
    crowded = placed.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    candidates = materialize(placed.join(crowded, "root"), "candidates")
    sets = (
        docs.select("doc_id", "text")
        .join(candidates.hint("shuffle_hash"), "doc_id")
        .select("root", "node", "same", "text")
        .mapInArrow(_shingle_sets(k), "root long, node long, shingles array<long>")
    )
    sets = sets.dropDuplicates(["node"]) if repeated else sets
    grouped = connect(_verified_links(materialize(sets, "shingles"), similarity, block))
    # every text whose group has a text of a lesser doc_id goes, and every copy but the first
    ranked = texts.join(grouped, "node", "left").select("same", "size", "doc_id", F.coalesce("root", "node").alias("root"))
    least = ranked.groupBy("root").agg(F.min("doc_id").alias("least"))
    kept = materialize(ranked.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("same", "size", "least"), "kept")
    removed = rows.select("doc_id", "same", "size").join(kept.select("same", "size", F.col("least").alias("doc_id")), ["same", "size", "doc_id"], "left_anti")
    removed = materialize(removed.select("doc_id"), "removed")
    discard(texts, candidates)
    if not repeated:
        return docs.join(removed.hint("shuffle_hash"), "doc_id", "left_anti")
    shared = shared.hint("shuffle_hash")
    alone = docs.join(shared, docs["doc_id"].eqNullSafe(shared["doc_id"]), "left_anti")
    several = docs.join(shared, docs["doc_id"].eqNullSafe(shared["doc_id"]), "left_semi")
    return alone.join(removed.hint("shuffle_hash"), "doc_id", "left_anti").unionByName(_of_shared_ids(several, kept))


def _of_shared_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose doc_id others have too: those of a text and id that stay, once each."""
    names = docs.columns
    free = lambda base: base if base not in names else free(f"_{base}")
    same, size, least = free("same"), free("size"), free("least")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                whole, n = _whole(*joined_words(texts))
                part = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64))], [*names, same, size])

    keyed = docs.mapInArrow(key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{same}` long, `{size}` long")
    one = keyed.dropDuplicates([same, size, "doc_id"])
    stay = kept.select(F.col("same").alias(same), F.col("size").alias(size), F.col("least").alias(least))
    return one.join(stay, [same, size]).where(F.col("doc_id").eqNullSafe(F.col(least))).select(*(f"`{n}`" for n in names))
