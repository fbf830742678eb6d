"""Counts and sizes over stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_vdisk(log: DataFrame) -> DataFrame:
    return log.groupBy("vdisk_id").agg(F.count("*").alias("records"))


def per_partition(log: DataFrame, start: Column) -> DataFrame:
    return log.groupBy("vdisk_id", start.alias("start_ts")).agg(F.count("*").alias("records"), F.max("ts").alias("last_write"))


def partitions_of_vdisk(log: DataFrame, start: Column) -> DataFrame:
    parts = log.select("vdisk_id", start.alias("start_ts")).distinct()
    return parts.groupBy("vdisk_id").agg(F.count("*").alias("partitions"), F.min("start_ts").alias("first_start"), F.max("start_ts").alias("last_start"))


def blob_summary(log: DataFrame) -> DataFrame:
    dead = F.col("is_tombstone")
    return log.groupBy("vdisk_id").agg(
        F.count("*").alias("records"), F.count_distinct("key").alias("unique_keys"), F.count_if(dead).alias("deleted"), F.count_distinct(F.when(dead, F.col("key"))).alias("unique_deleted")
    )


def blobs_by_source(log: DataFrame, start: Column) -> DataFrame:
    """How many partition files each source has."""
    return log.select("source", "vdisk_id", "disk", "owner_node", start.alias("s")).groupBy("source").agg(F.count_distinct("vdisk_id", "disk", "owner_node", "s").alias("blobs"))


def space_by_disk(log: DataFrame, record_bytes: int) -> DataFrame:
    return log.groupBy("disk").agg((F.count("*") * record_bytes).alias("used"))


def space(volumes: DataFrame) -> DataFrame:
    """total, free (available blocks) and used (total less free blocks) over all volumes."""
    size = F.col("block_size")
    return volumes.agg(F.sum(F.col("blocks") * size).alias("total"), F.sum(F.col("available") * size).alias("free"), F.sum((F.col("blocks") - F.col("free")) * size).alias("used"))


def corrupted(disks: DataFrame) -> DataFrame:
    """disks: is_alien, corrupted. Corrupted blobs of all normal disks."""
    return disks.agg(F.coalesce(F.sum(F.when(~F.col("is_alien"), F.col("corrupted"))), F.lit(0)).alias("corrupted"))


def memory(holders: DataFrame) -> DataFrame:
    """holders: disk, index_bytes, filter_bytes. Memory of indexes and filters by disk."""
    return holders.groupBy("disk").agg(F.sum("index_bytes").alias("index_memory"), F.sum("filter_bytes").alias("filter_memory"))


def active_disks(states: DataFrame) -> DataFrame:
    """states: disk, state. How many disks there are, and how many are ready."""
    return states.agg(F.count("*").alias("disks"), F.count_if(F.col("state") == "Ready").alias("active"))


def nodes_available(pings: DataFrame) -> DataFrame:
    """pings: round, node, ok. All nodes of a round less those that failed."""
    return pings.groupBy("round").agg((F.count("*") - F.count_if(~F.col("ok"))).alias("available"))


def present(found: DataFrame) -> DataFrame:
    """found: packet, found. How many keys of each packet of an existence check are there."""
    return found.groupBy("packet").agg(F.count("*").alias("asked"), F.count_if("found").alias("present"))
