"""Reads and writes of many keys at once, as plans over the log: which records a request finds,
and which records a write or a delete leaves where.

Every plan starts from the distinct keys asked for, so that the log is cut down to them before
it is aggregated; Spark sends the keys to the scan by itself where they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators import routing, versions

#: Where a key is looked for, in this order.
TIERS = ("local", "remote", "local alien", "remote alien")


def of_keys(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the keys asked for."""
    return log.join(wanted.select("key").distinct(), "key", "left_semi")


def get(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """GET: wanted (position, key), each with ts, seq and payload of the first tier and replica
    that has the key live; null where none has. A key may be asked for twice."""
    return wanted.join(versions.tiered(of_keys(log, wanted)), "key", "left").select("position", "key", "tier", "ts", "seq", "payload")


def exists_cascade(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """EXIST tier after tier: each asks only for keys that are still missing. Returns position,
    key and the tier that has it, null for none."""
    missing, found = wanted.select("key").distinct(), None
    for tier in range(len(TIERS)):
        here = of_keys(log.where(F.col("tier") == tier), missing)
        hits = versions.live(here).select("key", F.lit(tier).alias("tier"))
        found = hits if found is None else found.union(hits)
        missing = missing.join(hits, "key", "left_anti")
    return wanted.join(found, "key", "left").select("position", "key", "tier")


def copied(log: DataFrame, copies: DataFrame) -> DataFrame:
    """copies: key, to_key, ts, seq. The records that a copy of each live key appends under its
    new key; a key that is gone is not copied."""
    live = versions.live(of_keys(log, copies)).select("key", "payload")
    return live.join(copies, "key").select(F.col("to_key").alias("key"), "ts", "seq", F.lit(False).alias("is_tombstone"), "payload")


def tombstones(log: DataFrame, deletes: DataFrame, start: Column, by: tuple[str, ...] = ("vdisk_id",)) -> DataFrame:
    """deletes: key, the columns of ``by``, delete_ts, forced. The tombstones to append: key, by, start_ts, ts.

    A forced delete always leaves one in the partition of its own time; older partitions, and
    with an unforced delete all that start before it, get one if the key is live there. ``start``
    gives a record's partition from ``ts``; ``by`` says what holds partitions of its own: virtual
    disks, disks, or the owners of aliens.
    """
    of = ("key", *by)
    own = deletes.withColumn("ts", F.col("delete_ts")).select(*of, "delete_ts", "forced", start.alias("own_start"))
    held = versions.live(of_keys(log, deletes).withColumn("start_ts", start), (*of, "start_ts")).select(*of, "start_ts")
    older = held.join(own, list(of)).where(F.when(F.col("forced"), F.col("start_ts") < F.col("own_start")).otherwise(F.col("start_ts") < F.col("delete_ts")))
    actual = own.where("forced").select(*of, F.col("own_start").alias("start_ts"), F.col("delete_ts").alias("ts"))
    return older.select(*of, "start_ts", F.col("delete_ts").alias("ts")).union(actual)


def put_plan(answers: DataFrame, support: DataFrame, local: str) -> DataFrame:
    """answers: op, node, ok. support: op, node (nodes that can help, in order). Where each
    copy of a put comes to lie: op, node, source, owner_node.

    A target that answers keeps a normal record. What failed goes, as an alien record of its
    owner, to one helper each; without one it stays with the local node.
    """
    normal = answers.where("ok").select("op", "node", F.lit("normal").alias("source"), F.col("node").alias("owner_node"))
    aliens = routing.hand_off(answers.where("NOT ok").select("op", "node"), support)
    return normal.union(aliens.select("op", F.coalesce("helper", F.lit(local)).alias("node"), F.lit("alien").alias("source"), F.col("node").alias("owner_node")))


def delete_plan(answers: DataFrame, support: DataFrame, nodes: DataFrame, local: str) -> DataFrame:
    """The tombstones of a delete: op, node, owner_node (null for the node's own records),
    forced. answers and support as in ``put_plan``; nodes: name.

    Targets that answer get a forced one of their own. Each that does not gets one, forced, with
    a helper, or with the local node. All other nodes are asked, unforced, for aliens of the
    targets.
    """
    own = answers.where("ok").select("op", "node", F.lit(None).cast("string").alias("owner_node"), F.lit(True).alias("forced"))
    kept = put_plan(answers, support, local).where("source = 'alien'").select("op", "node", "owner_node", F.lit(True).alias("forced"))
    used = answers.select("op", "node").union(kept.select("op", "node")).union(answers.select("op", F.lit(local).alias("node")))
    others = routing.remaining(answers.select("op").distinct(), nodes, used)
    asked = others.join(answers.select("op", F.col("node").alias("owner_node")), "op").select("op", "node", "owner_node", F.lit(False).alias("forced"))
    return own.union(kept).union(asked)


def delete_outcome(plan: DataFrame, local: str, local_ok: Column) -> DataFrame:
    """Per op its tombstones by kind, and its status: a delete fails only if the local node has
    to keep a forced alien one and cannot."""
    stays = F.col("owner_node").isNotNull() & F.col("forced") & (F.col("node") == local)
    counts = plan.groupBy("op").agg(F.count_if(F.col("owner_node").isNull()).alias("plain"), F.count_if(F.col("owner_node").isNotNull() & F.col("forced")).alias("forced"), F.count_if(~F.col("forced")).alias("asked"), F.bool_or(stays).alias("stays"))
    return counts.select("op", "plain", "forced", "asked", F.when(F.col("stays") & ~local_ok, "failed").otherwise("ok").alias("status"))
