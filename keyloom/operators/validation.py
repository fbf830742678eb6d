"""Checks of configured topologies: each returns the rows that violate a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators import routing


def duplicates(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("times")).where("times > 1")


def id_gaps(ids: DataFrame, col: str = "id") -> DataFrame:
    """Ids that should run from 0 without gaps: each first id out of step, as dup or gap.

    In ascending order an id is in step if it is one above the id before it, and the least one
    if it is 0; each further row of an id is a dup. Null ids are left out.
    """
    each = ids.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("id")).agg(F.count("*").alias("times"))
    least = each.agg(F.min("id").alias("least"))
    first = each.join(each.select((F.col("id") + 1).alias("id")), "id", "left_anti").join(F.broadcast(least))  # one row
    first = first.where("id != 0 OR id != least").select("id", F.when((F.col("id") == F.col("least")) & (F.col("id") < 0), "dup").otherwise("gap").alias("problem"))
    again = each.where("times > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("times")))).select("id", F.lit("dup").alias("problem"))
    return first.unionByName(again)


def adjacent_duplicates(df: DataFrame, col: str) -> DataFrame:
    """Values that stand next to themselves in sorted order: those that stand more than once."""
    return duplicates(df.where(F.col(col).isNotNull()), col).select(col)


def missing(part: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """Rows of part that whole lacks: empty if part is a subset."""
    return part.join(whole, on, "left_anti").select(*on).distinct()


def violations(nodes: DataFrame, disks: DataFrame, replicas: DataFrame, vdisks: DataFrame) -> DataFrame:
    """rule, subject: everything wrong with a topology."""
    said = lambda df, rule, *cols: df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(c).cast("string") for c in cols)).alias("subject"))
    empty = lambda *cols: reduce(lambda a, b: a | b, ((F.col(c).isNull()) | (F.col(c) == "") for c in cols))
    return reduce(
        DataFrame.unionByName,
        [
            said(nodes.where(empty("name")), "empty node name", "address"),
            said(nodes.where(empty("address")), "empty address", "name"),
            said(disks.where(empty("disk", "path")), "empty disk name or path", "node"),
            said(replicas.where(empty("node", "disk")), "replica without node or disk", "vdisk_id"),
            said(vdisks.where(F.col("id").isNull()), "virtual disk without id", "id"),
            said(nodes.agg(F.count("*").alias("n")).where("n = 0"), "no nodes", "n"),
            said(vdisks.agg(F.count("*").alias("n")).where("n = 0"), "no virtual disks", "n"),
            said(duplicates(nodes, "name"), "duplicate node", "name"),
            said(duplicates(disks, "node", "disk"), "duplicate disk", "node", "disk"),
            said(duplicates(vdisks, "id"), "duplicate virtual disk", "id"),
            said(id_gaps(vdisks).where("problem = 'gap'"), "gap before virtual disk", "id"),
            said(duplicates(replicas, "vdisk_id", "node", "disk"), "duplicate replica", "vdisk_id", "node", "disk"),
            said(routing.dangling(replicas.where(~empty("node", "disk")), disks), "replica on unknown disk", "vdisk_id", "node", "disk"),
            said(vdisks.join(replicas, vdisks.id == replicas.vdisk_id, "left_anti"), "virtual disk without replicas", "id"),
        ],
    )


def user_violations(users: DataFrame, roles: DataFrame, hash_digits: int = 128) -> DataFrame:
    """users: username, password, password_hash, role. roles: role. What is wrong with them: a
    name twice, neither or both of password and hash, a hash of another length, an unknown role."""
    said = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("username").cast("string").alias("subject"))
    checks = [
        said(duplicates(users, "username"), "duplicate user"),
        said(users.where(F.col("password").isNull() == F.col("password_hash").isNull()), "not one of password and hash"),
        said(users.where(F.length("password_hash") != hash_digits), "hash of wrong length"),
        said(users.where(F.col("role").isNotNull()).join(roles, "role", "left_anti"), "unknown role"),
    ]
    return reduce(DataFrame.unionByName, checks)


def node_violations(configs: DataFrame) -> DataFrame:
    """configs: node, quorum, replicas, timeout_ms, check_interval_ms, count_interval_ms, policy.
    What is wrong with each node's own configuration."""
    rules = {
        "no quorum": F.col("quorum") < 1,
        "quorum above replicas": F.col("quorum") > F.col("replicas"),
        "no timeout": F.coalesce(F.col("timeout_ms") <= 0, F.lit(True)),
        "no interval": F.coalesce((F.col("check_interval_ms") <= 0) | (F.col("count_interval_ms") <= 0), F.lit(True)),
        "unknown policy": ~F.coalesce(F.col("policy").isin("quorum", "simple"), F.lit(False)),
    }
    said = F.array_compact(F.array(*(F.when(wrong, F.lit(rule)) for rule, wrong in rules.items())))
    return configs.select("node", F.explode(said).alias("rule"))
