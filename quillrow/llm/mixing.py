"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule w(t) = weight * (1 + slope * (2 t - 1)) over training time t in
0..1, whose integral is its weight.  Targets share all words by weight; none passes ``max_passes``
times its source's size and what is over is shared again by weight among the rest.  A source's
documents form one stream in hashed order, repeated until the target is met; the last document
taken is taken in part.  A document is trained on at the time at which its source's cumulative
demand reaches the words before it: the schedule's integral, inverted in closed form.

Defined results: null or empty text has size 0 and is taken 0 times, without a position; a null
source is a source of its own, last in order; rows that repeat a doc_id are rows like any other; an
empty table gives an empty result; extra columns are ignored.

Scale: the text is read once, and only (doc_id, source, size) are kept.  Sums within a source run
over hashed slots (16 ** ``slot_digits`` of them), so that a source with a third of all rows is spread over as many
tasks; only one row a source meets in a single task, to settle the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_passes: int = 3) -> DataFrame:
    """sizes: one row a source (src, src_null, source_size); adds weight, slope and target."""
    order = Window.orderBy("src_null", "src")
    rank = F.row_number().over(order) - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("rank") % len(xs) + 1)
    cap = F.col("source_size") * float(max_passes)
    ranked = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", pick([float(w) for w in weights]))
        .withColumn("slope", pick(list(slopes)))
        .withColumn("ratio", cap / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - max_passes * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("src", "src_null", F.col("source_size").alias("full_size"), "slope", F.least(F.col("weight") * F.col("level"), cap).alias("target"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_passes: int = 3, slot_digits: int = 3) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, passes, position.

    taken: words the mix takes of it, repeats counted.  position: when it is first trained on
    (0..1, null if never).  Rows come range-sorted by position.
    """
    placed, u, linear = _placed(docs, weights, slopes, max_passes, slot_digits)
    return placed.select(
        "doc_id",
        "source",
        "size",
        F.col("full_size").alias("source_size"),
        "target",
        "taken",
        "passes",
        F.when(F.col("taken") > 0, _when(u(F.lit(0)), linear)).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def schedule(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_passes: int = 3, slot_digits: int = 3) -> DataFrame:
    """The training order: one row each time a document is trained on, range-sorted by position.

    doc_id, source, pass (from 0), words (all of the document's, or the part that the last pass takes of the
    last document) and position.  The words of a document add up to what ``mix`` takes of it.
    """
    placed, u, linear = _placed(docs, weights, slopes, max_passes, slot_digits)
    each = placed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    words = F.when(F.col("pass") < F.col("full_passes"), F.col("size")).otherwise(F.col("part"))
    return each.select("doc_id", "source", "pass", words.alias("words"), _when(u(F.col("pass")), linear).alias("position")).orderBy("position", "source", "doc_id")


def _when(u: Column, linear: Column) -> Column:
    """The training time at which a source has met the part u of its demand."""
    return 2 * u / (linear + F.sqrt(linear * linear + 4 * F.col("slope") * u))


def _placed(docs: DataFrame, weights, slopes, max_passes: int, slot_digits: int):
    """Each document's place in its source's stream and what is taken of it; the part of the demand that
    is met before its n-th pass, and the linear term of the schedule."""
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix",
    ).select(
        "doc_id",
        "source",
        "size",
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNull().alias("src_null"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.col("size").cast("string")))).alias("key"),
    )
    sized = sized.withColumn("slot", F.substring("key", 1, slot_digits))
    slot_sums = sized.groupBy("src", "src_null", "slot").agg(F.sum("size").alias("slot_size"))
    within = Window.partitionBy("src", "src_null").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_starts = slot_sums.withColumn("before", F.coalesce(F.sum("slot_size").over(within), F.lit(0)))
    goals = targets(slot_sums.groupBy("src", "src_null").agg(F.sum("slot_size").alias("source_size")), weights, slopes, max_passes)
    plan = slot_starts.join(goals, ["src", "src_null"])
    running = Window.partitionBy("src", "src_null", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("full_size") > 0, F.floor(F.col("target") / F.col("full_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5) - F.col("full_passes") * F.col("full_size") - F.col("begins")))
    placed = (
        sized.join(plan, ["src", "src_null", "slot"])
        .withColumn("begins", F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("full_passes", passes)
        .withColumn("part", part)
        .withColumn("taken", F.col("full_passes") * F.col("size") + F.col("part"))
        .withColumn("passes", F.when(F.col("taken") > 0, F.col("full_passes") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0))
    )
    return placed, lambda n: (F.col("begins") + n * F.col("full_size")) / F.col("target"), 1 - F.col("slope")
