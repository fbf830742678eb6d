"""Latest versions, existence and deletion over a log of puts and tombstones.

All are top-1 or existence aggregations by key: partial aggregation runs before the shuffle, so
a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(*by: str) -> Column:
    return F.max_by(F.struct("ts", "seq", "is_tombstone", "payload"), F.struct(*by)).alias("v")


def latest(log: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest version of each key by (ts, seq), tombstones included."""
    return log.groupBy(*keys).agg(_newest("ts", "seq")).select(*keys, "v.*")


def live(log: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """GET: the newest version of each key; a key whose newest version is a tombstone is gone."""
    return latest(log, keys).where(~F.col("is_tombstone")).drop("is_tombstone")


def alien(log: DataFrame) -> DataFrame:
    """GET from aliens: the newest of the owners' own newest versions. Tombstones hide versions
    of their owner only; a version of time 0 is never found."""
    each = live(log.where("source = 'alien'"), ("key", "owner_node", "vdisk_id")).where("ts > 0")
    return each.groupBy("key").agg(F.max_by(F.struct("ts", "seq", "payload"), F.struct("ts", "seq")).alias("v")).select("key", "v.*")


def tiered(log: DataFrame) -> DataFrame:
    """GET by precedence: within each tier and replica the newest version, deleted ones left
    out; then the lowest tier and replica that has one. An old local version thus beats a newer
    remote one, and a key deleted here can come back from elsewhere."""
    each = live(log, ("key", "tier", "replica"))
    first = F.min_by(F.struct("tier", "replica", "ts", "seq", "payload"), F.struct("tier", "replica"))
    return each.groupBy("key").agg(first.alias("v")).select("key", "v.*")


def exists(wanted: DataFrame, log: DataFrame, sources: tuple[str, ...] = ("normal", "alien")) -> DataFrame:
    """EXIST: wanted (position, key) with found, by position; a key may be asked for twice."""
    # The log is cut down to the keys asked for before it is aggregated.
    asked = log.where(F.col("source").isin(*sources)).join(wanted.select("key").distinct(), "key", "left_semi")
    alive = live(asked).select("key", F.lit(True).alias("hit"))
    return wanted.join(alive, "key", "left").select("position", "key", F.coalesce("hit", F.lit(False)).alias("found"))


def exists_by_tier(log: DataFrame) -> DataFrame:
    """For each key the first tier that has it live, and in how many tiers it is."""
    each = live(log, ("key", "tier"))
    return each.groupBy("key").agg(F.min("tier").alias("first_tier"), F.count("*").alias("tiers"))


def exists_anywhere(log: DataFrame) -> DataFrame:
    """Whether any replica or any alien owner has each key live."""
    normal = latest(log.where("source = 'normal'"), ("key", "replica")).groupBy("key").agg(F.bool_or(~F.col("is_tombstone")).alias("in_replicas"))
    aliens = latest(log.where("source = 'alien'"), ("key", "owner_node")).groupBy("key").agg(F.bool_or(~F.col("is_tombstone")).alias("in_aliens"))
    return normal.join(aliens, "key", "full").select("key", F.coalesce("in_replicas", F.lit(False)).alias("in_replicas"), F.coalesce("in_aliens", F.lit(False)).alias("in_aliens"))


def delete_effect(log: DataFrame, at: DataFrame) -> DataFrame:
    """at: key, delete_ts. A delete's tombstones by day partition of the records: always in the
    partition of its time, and in older ones that hold the key. Returns key, tombstones, and
    records older than the delete."""
    day = F.expr("ts - pmod(ts, 86400)")
    held = log.where(~F.col("is_tombstone")).join(at, "key").where("ts <= delete_ts").withColumn("day", day)
    own = F.expr("delete_ts - pmod(delete_ts, 86400)")
    n = held.where(F.col("day") < own).groupBy("key").agg(F.countDistinct("day").alias("older"))
    covered = held.groupBy("key").agg(F.count("*").alias("records"))
    return at.join(n, "key", "left").join(covered, "key", "left").select("key", (F.coalesce("older", F.lit(0)) + 1).alias("tombstones"), F.coalesce("records", F.lit(0)).alias("records"))


def after_deletes(log: DataFrame) -> DataFrame:
    """Each live key with how many of its records the tombstones before it cover."""
    last = log.where("is_tombstone").groupBy("key").agg(F.max(F.struct("ts", "seq")).alias("last_delete"))
    marked = log.join(last, "key", "left")
    newer = F.col("last_delete").isNull() | (F.struct("ts", "seq") > F.col("last_delete"))
    return marked.where(~F.col("is_tombstone")).groupBy("key").agg(F.count_if(newer).alias("alive"), F.count_if(~newer).alias("covered"))
