"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Sources in code point order, null last, have the weights 3, 1, 2, repeating, and share a total. A source's target stops
at ``max_epochs`` times its size; what is over goes to the others by weight until no target is above. That is the level
at which all targets together make the total, found with prefix sums over the sources sorted by size per weight.

Each document draws the exponential key -ln(u) / quality, u from a hash of its id, so reruns agree. A target's whole
multiples of the source are complete epochs: every document is taken so often. The rest goes to documents in the order
of their keys until it is used up; the last one gives what is still missing.

The prefix sums don't put a source into one task: a key becomes one of ``buckets`` ranges by 1 - exp(-key), ranges are
summed first, and documents are only sorted within their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
TOTAL_SHARE, MAX_EPOCHS = 1.5, 2
BUCKETS = 4096
SEED = 9
#: Weights of documents with quality 1, 0 and unknown.
QUALITY_WEIGHTS = (2.0, 0.5, 1.0)


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``.

    ``sizes``: ``source``, ``source_size``, one row per source; they are few enough to be sorted in one task.
    """
    if not 0 <= total_share <= max_epochs:
        raise ValueError("total_share must lie between 0 and max_epochs")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("fill", "rank")
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        # The level if this source and all that fill up later stay below their caps.
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
    )
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)["level"]
    return filled.withColumn("final", level).select(
        "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target")
    )


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words).

    ``quality``: rows of ``doc_id`` and ``quality`` (0 or 1); of several for an id the best counts, and none is as good
    as unknown. Null texts have size 0 and nothing is taken of them. Null sources are one source, the last. Equal keys
    are ordered by id and size, null ids first; rows that repeat an id are documents of their own, and of those equal
    in everything it doesn't matter which is taken. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    good, bad, unknown = QUALITY_WEIGHTS
    if quality is not None:
        best = quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("q_id")).agg(F.max("quality").alias("quality"))
        rows = rows.join(best, rows["doc_id"] == best["q_id"], "left").drop("q_id")
        weight = F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(unknown)
    else:
        weight = F.lit(unknown)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(SEED)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = rows.withColumn("key", -F.ln(uniform) / weight).withColumn(
        "bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int")
    )
    # A stand-in for null, so that null sources join.
    keyed = cut(keyed.select("doc_id", "size", "key", "bucket", F.array("source").alias("in_source")))
    ranges = keyed.groupBy("in_source", "bucket").agg(F.sum("size").alias("range_size"))
    sources = targets(
        ranges.groupBy("in_source").agg(F.sum("range_size").alias("source_size")).select(F.col("in_source")[0].alias("source"), "source_size"),
        weights, total_share, max_epochs,
    ).select(F.array("source").alias("in_source"), "source_size", "target")
    before = F.sum("range_size").over(Window.partitionBy("in_source").orderBy("bucket")) - F.col("range_size")
    placed = ranges.withColumn("before_range", before).join(sources, "in_source").drop("range_size")
    order = Window.partitionBy("in_source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = whole - epochs * F.col("source_size")
    return (
        keyed.withColumn("up_to", F.sum("size").over(order))
        .join(placed, ["in_source", "bucket"])
        .withColumn("ahead", F.col("before_range") + F.col("up_to") - F.col("size"))
        .select(
            "doc_id", "size", "source_size", "target",
            (epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("ahead")))).cast("bigint").alias("taken"),
        )
    )


def mixed(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the mix takes words of, all their columns kept, with ``taken``.

    A column ``taken`` of the documents gives way to it. Rows that repeat an id and size each get the most that any of
    them does. See ``mix``.
    """
    found = mix(docs, quality, id_col=id_col, text_col=text_col, **options)
    taken = found.groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max("taken").alias("taken")).where("taken > 0")
    rows = docs.drop("taken").withColumn("__own_size", size_of(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own_size") == F.col("__size"))
    return rows.join(taken, same).drop("__id", "__size", "__own_size")
