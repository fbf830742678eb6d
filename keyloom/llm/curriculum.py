"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. A source's weight at time t is its mean weight times
1 + ramp * (1 - 2t): a schedule that integrates to the mean, falling for ramp > 0 and rising
for ramp < 0. Its documents, in a fixed random order and repeated in passes, are met when the
source's cumulative demand reaches them; inverting that demand gives each document's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm import shared

#: Weights of the sources in code-point order, repeating; null last.
WEIGHTS = (5, 2, 1)
#: Slope of the weight schedule of the sources in the same order, repeating.
RAMPS = (0.0, 0.5, -0.5)
#: No document is taken more often than this.
MOST_PASSES = 3
#: Parts of a source that are summed up apart, by the first three hex digits of the order key.
PARTS = 4096


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), shared.SPACE + "+"), lambda w: w != "")).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target, ramp: all sizes together shared out by weight, none above
    ``most`` times the source's size, the excess reshared until none is above.

    Sources by rising cap per weight: while the rest of the total, shared among this source and
    all after it, gives it more than its cap, it stops at its cap. The table has a row for each
    source; it alone is ordered in one task.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by) - 1).alias("turn")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % len(values) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("*", turn)
    sources = sources.select("source", "source_size", "turn", pick([float(w) for w in weights]).alias("weight"), pick([float(r) for r in ramps]).alias("ramp"), (F.col("source_size") * most).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    # The first source that stays below its cap sets the level of all after it.
    shared_level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("cap") / F.col("weight") <= F.coalesce(shared_level, F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(shared_level * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"), "ramp")


def _met_at(share: Column, ramp: Column) -> Column:
    """The time at which a source has had ``share`` of its demand: the root in [0, 1] of
    (1 + ramp) t - ramp t**2 = share."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + ramp) * (1 + ramp) - 4 * ramp * share))
    return F.when(ramp == 0, share).otherwise((1 + ramp - root) / F.when(ramp != 0, 2 * ramp))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, ramps=RAMPS, most: int = MOST_PASSES, row_col: str | None = None
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, ramp, start (the
    source's words before it), copies, taken and position (of the first copy; null without one);
    also ``row``, if docs have a column ``row_col`` that tells their rows apart.

    A source's words stand in a fixed order by MD5 of the doc_id. A document is taken whole in
    each full pass, and in the last, unfinished one if its middle word still falls within the
    target; so taken = copies * size, and a source misses its target by half a document at most.
    A null text has size 0 and takes nothing; a null source is a source of its own, after all
    others; null and repeated doc_ids are ordered by size. An empty table gives no rows.
    """
    row = [] if row_col is None else ["row"]
    sized = shared.keep(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *(F.col(row_col).alias(c) for c in row)).withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        "sizes",
    ).withColumn("part", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int"))
    targets = source_targets(sized, weights, ramps, most)
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target", "ramp")
    within = Window.partitionBy("source", "part").orderBy("turn", "size", "doc_id", *row).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("s")
    placed = placed.join(parts.alias("q"), F.col("s.source").eqNullSafe(F.col("q.source")) & (F.col("s.part") == F.col("q.part")))
    start = F.col("first") + F.col("inside")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    last = F.col("target") - F.col("passes") * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.when(2 * F.col("start") + F.col("size") <= 2 * last, 1).otherwise(0))
    placed = placed.select(*row, "doc_id", "s.source", "size", "source_size", "target", "ramp", start.alias("start"), passes.alias("passes"))
    placed = placed.withColumn("copies", copies.cast("int"))
    share = F.least(F.lit(1.0), F.col("start") / F.col("target"))
    position = F.when(F.col("copies") > 0, _met_at(share, F.col("ramp")))
    return placed.select(*row, "doc_id", "source", "size", "source_size", "target", "ramp", "start", "copies", (F.col("copies") * F.col("size")).alias("taken"), position.alias("position"))


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as ``mix(docs, **options)`` takes it, range-sorted by
    training position; the columns are those of docs.

    Rows are written once with a number of their own, by which each meets its copies: so rows
    that repeat a doc_id, or have none, are taken each for itself. Documents without words are
    never taken. An empty table gives no rows.
    """
    row, position, nth = (shared.fresh(docs, c) for c in ("row", "position", "nth"))
    numbered = shared.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    each = mix(numbered, **options, row_col=row).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), (F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target"))
    each = shared.keep(each.select(F.col("row").alias(row), F.col("copy").alias(nth), _met_at(share, F.col("ramp")).alias(position)), "training-positions")
    order = (position, row, nth)
    return numbered.join(each, row).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
