"""Topology joins: keys to replicas, nodes and paths, and stand-ins for nodes that are away.

Topologies are small dimension tables; Spark broadcasts them below its own size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fan_out(records: DataFrame, replicas: DataFrame) -> DataFrame:
    """Each record with every replica of its virtual disk."""
    return records.join(replicas, "vdisk_id")


def target_nodes(records: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """vdisk_id, idx, node: the distinct nodes of each record's disk, in node order."""
    used = records.select("vdisk_id").distinct().join(replicas, "vdisk_id").select("vdisk_id", "node").distinct()
    return used.join(nodes, used.node == nodes.name).select("vdisk_id", "idx", "node")


def replica_paths(replicas: DataFrame, nodes: DataFrame, disks: DataFrame) -> DataFrame:
    """Each replica with its node's address and its disk's path."""
    placed = replicas.join(nodes.withColumnRenamed("name", "node"), "node").join(disks, ["node", "disk"])
    return placed.select("vdisk_id", "ord", "node", "disk", "address", "path")


def dangling(replicas: DataFrame, disks: DataFrame) -> DataFrame:
    """Replicas on a node or disk that does not exist."""
    return replicas.join(disks, ["node", "disk"], "left_anti")


def node_view(replicas: DataFrame) -> DataFrame:
    """For each node its virtual disks, comma-joined, and how many replicas it holds."""
    return replicas.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("vdisk_id")).cast("array<string>"), ",").alias("vdisks"), F.count("*").alias("replicas"))


def replicas_per_node(records: DataFrame, replicas: DataFrame) -> DataFrame:
    return fan_out(records, replicas).groupBy("node").agg(F.count("*").alias("replicas"))


def support_nodes(targets: DataFrame, nodes: DataFrame, available: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """For each vdisk_id up to ``count`` nodes that are not its targets: available ones first,
    each group round robin in node order from the offset-th available."""
    states = nodes.join(available, "name")
    vdisks = targets.select("vdisk_id").distinct()
    # Each virtual disk meets every node of the topology once: the nodes are a dimension, and
    # gathered in one row.
    every = states.agg(F.collect_list(F.struct(*states.columns)).alias("every"))
    others = vdisks.join(F.broadcast(every)).select("vdisk_id", F.explode("every").alias("s")).select("vdisk_id", "s.*").join(targets.select("vdisk_id", F.col("node").alias("name")), ["vdisk_id", "name"], "left_anti")
    by_index = Window.partitionBy("vdisk_id").orderBy("idx")
    n = F.count_if("available").over(Window.partitionBy("vdisk_id"))
    nth = F.count_if("available").over(by_index.rowsBetween(Window.unboundedPreceding, 0)) - 1
    start = F.max(F.when(F.col("available") & (F.col("nth") == F.pmod(F.lit(offset), F.greatest("n", F.lit(1)))), F.col("idx"))).over(Window.partitionBy("vdisk_id"))
    turned = others.withColumn("n", n).withColumn("nth", nth).withColumn("start", F.coalesce(start, F.lit(0)))
    order = Window.partitionBy("vdisk_id").orderBy(F.desc("available"), (F.col("idx") < F.col("start")), "idx")
    return turned.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count).select("vdisk_id", "turn", "name", "available")


def remaining(ops: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """op, node: for each op the nodes (name) it has not used (op, node)."""
    names = nodes.agg(F.collect_set("name").alias("names"))  # one row: the topology
    every = ops.join(F.broadcast(names)).select("op", F.explode("names").alias("node"))
    return every.join(used.distinct(), ["op", "node"], "left_anti")


def hosted_aliens(records: DataFrame, replicas: DataFrame) -> DataFrame:
    """Alien records whose owner really hosts their virtual disk."""
    hosts = replicas.select(F.col("node").alias("owner_node"), "vdisk_id").distinct()
    return records.where("source = 'alien'").join(hosts, ["owner_node", "vdisk_id"], "left_semi")


def old_first(nodes: DataFrame, old: DataFrame, of: str) -> DataFrame:
    """Adds turn: the place of each node (name, idx) within its ``of``, those that stood in the
    old topology before new ones."""
    marked = nodes.join(old.select("name", F.lit(True).alias("was")), "name", "left").withColumn("was", F.coalesce("was", F.lit(False)))
    return marked.withColumn("turn", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("was"), "idx")))


def hand_off(failed: DataFrame, support: DataFrame) -> DataFrame:
    """failed: op, node. support: op, node. Pairs them by position within each operation; what
    finds no partner stays with the local node (null helper)."""
    place = lambda df: df.withColumn("turn", F.row_number().over(Window.partitionBy("op").orderBy("node")))
    helpers = place(support).select("op", "turn", F.col("node").alias("helper"))
    return place(failed).join(helpers, ["op", "turn"], "left").select("op", "node", "helper")


def devices(mounts: DataFrame, disks: DataFrame) -> DataFrame:
    """Configured disks with the mount point on their device."""
    return disks.join(mounts, "device")
