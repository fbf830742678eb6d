"""Time partitions: where a record belongs, and which partitions a lookup must visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 604_800
#: 1970-01-06, a Tuesday: weeks are counted from Tuesdays.
TUESDAY = 5 * DAY


def start(ts: Column, period: int) -> Column:
    """Start of the partition of a time: periods up to a day count from UTC midnight, longer
    ones up to a week from Tuesday."""
    if not 0 < period <= WEEK:
        raise ValueError("a period is at most seven days")
    anchor = ts - F.pmod(ts, F.lit(DAY)) if period <= DAY else ts - F.pmod(ts - TUESDAY, F.lit(WEEK))
    return (anchor + F.floor((ts - anchor) / period) * period).cast("long")


def name(start_ts: Column, owner: Column) -> Column:
    return F.concat_ws("_", start_ts.cast("string"), owner)


def parse_name(text: Column) -> tuple[Column, Column]:
    """(start or null, owner or null)"""
    parts = F.split(text, "_", 2)
    return F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1))


def assign(records: DataFrame, holders: DataFrame, ts: str = "ts") -> DataFrame:
    """Each record with the latest-starting holder [start_ts, end_ts) of its vdisk_id around it;
    records without one are left out.

    The holders of a virtual disk, one a period, are gathered into an array, and the record
    looks its own up there: records are joined by vdisk_id once, or not shuffled at all where
    Spark broadcasts the holders, and equal records stay apart.
    """
    held = holders.groupBy("vdisk_id").agg(F.collect_list(F.struct("start_ts", "end_ts")).alias("held"))
    around = F.filter("held", lambda h: (F.col(ts) >= h["start_ts"]) & (F.col(ts) < h["end_ts"]))
    placed = records.join(held, "vdisk_id").withColumn("start_ts", F.array_max(F.transform(around, lambda h: h["start_ts"])))
    return placed.where("start_ts IS NOT NULL").select(*records.columns, "start_ts")


def gap_step(starts: DataFrame, period: int, now: int) -> DataFrame:
    """For each vdisk_id the longest gap between partitions, to ``now`` included, and how far
    back from a hit older partitions may still matter: twice the gap or period, and one."""
    following = F.lead("start_ts", 1, now).over(Window.partitionBy("vdisk_id").orderBy("start_ts"))
    gaps = starts.select("vdisk_id", "start_ts").distinct().withColumn("gap", following - F.col("start_ts"))
    return gaps.groupBy("vdisk_id").agg(F.max("gap").alias("max_gap")).withColumn("step", 2 * F.greatest("max_gap", F.lit(period)) + 1)


def visited(parts: DataFrame, best_ts: Column, period: int, step: int) -> DataFrame:
    """The partitions that a lookup with a hit at best_ts must still visit."""
    return parts.where(best_ts.isNull() | (F.col("start_ts") + period + step >= best_ts))


def ages(parts: DataFrame, period: int, now: int, max_records: int) -> DataFrame:
    """State of partitions (start_ts, records, last_write): ended, idle for 10 s, small."""
    return parts.withColumns({"outdated": F.lit(now) > F.col("start_ts") + period, "idle": F.lit(now) - F.col("last_write") > 10, "small": F.col("records") * 10 < max_records})


def closing_order(parts: DataFrame, hard: int, soft: int) -> DataFrame:
    """Which ended, idle partitions to close, best first: small ones by latest end, then the
    others by latest end. The first ``hard`` close in any case; after them ``soft`` more, but
    none once a small one comes up.

    Turns are counted from the numbers of partitions by (small, start_ts), a row for each
    period; these alone are ordered in one task.
    """
    open_parts = parts.where("outdated AND idle")
    of = ["small", "start_ts"]
    before = Window.orderBy(F.desc("small"), F.desc("start_ts")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = open_parts.groupBy(*of).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy(*of).orderBy("vdisk_id"))
    ranked = open_parts.withColumn("nth", nth).join(firsts, of).withColumn("turn", (F.col("first") + F.col("nth")).cast("int")).drop("nth", "first")
    stop = ranked.where(F.col("small") & (F.col("turn") > hard)).agg(F.min("turn").alias("stop"))
    stops = F.coalesce(F.col("turn") >= F.col("stop"), F.lit(False))
    return ranked.join(F.broadcast(stop)).withColumn("close", (F.col("turn") <= hard) | ((F.col("turn") <= hard + soft) & ~stops)).drop("stop")  # one row


def release(parts: DataFrame, limit: int) -> DataFrame:
    """Releases the oldest partitions, level 0 before 1, until the memory left is within limit.
    Sums run over the totals by (level, start_ts), a row for each period, then within these."""
    of = ["level", "start_ts"]
    before = Window.orderBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum("total").over(Window.partitionBy(F.lit(1)))
    totals = parts.groupBy(*of).agg(F.sum("memory").alias("total"))
    left = totals.select(*of, (everything - F.coalesce(F.sum("total").over(before), F.lit(0))).alias("left"))
    inside = F.coalesce(F.sum("memory").over(Window.partitionBy(*of).orderBy("vdisk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("inside", inside).join(left, of).withColumn("released", F.col("left") - F.col("inside") > limit).drop("left", "inside")


def group_matches(alien: Column, vdisk_id: Column, node: Column, disk: Column, of: dict[str, Column]) -> Column:
    """Whether a group of partitions serves an operation (of: alien, vdisk_id, node, disk): an
    alien one by virtual disk and, if one is asked for, owner; another by virtual disk and disk."""
    return (of["vdisk_id"] == vdisk_id) & F.when(of["alien"], alien & (of["node"].isNull() | of["node"].eqNullSafe(node))).otherwise(~alien & of["disk"].eqNullSafe(disk))


def controller_matches(alien: Column, owns: Column, of: dict[str, Column]) -> Column:
    """Whether a disk serves an operation: the alien one all alien operations, another those of
    virtual disks it owns, whatever disk they name."""
    return F.when(of["alien"], alien).otherwise(~alien & owns)
