"""The tables as an operation log, blobs, metric samples and a topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VDISKS, NODES, REPLICAS = 8, 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_log(events: DataFrame) -> DataFrame:
    """key, ts (seconds), seq, is_tombstone, payload, vdisk_id, and where the record lies: tier
    (0 local, 1 remote, 2 local alien, 3 remote alien), replica, source, owner_node and disk."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    tier = F.pmod("event_id", F.lit(4)).cast("int")
    return events.select(
        F.col("user_id").alias("key"),
        seconds.alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("is_tombstone"),
        F.col("value").alias("payload"),
        F.pmod("user_id", F.lit(VDISKS)).cast("long").alias("vdisk_id"),
        tier.alias("tier"),
        F.pmod(F.expr("event_id div 4"), F.lit(REPLICAS)).cast("int").alias("replica"),
        F.when(tier >= 2, "alien").otherwise("normal").alias("source"),
        F.concat(F.lit("n"), F.pmod(F.expr("event_id div 8"), F.lit(NODES)).cast("string")).alias("owner_node"),
        F.concat(F.lit("d"), F.pmod(F.expr("event_id div 32"), F.lit(2)).cast("string")).alias("disk"),
    )


def nodes(spark: SparkSession, n: int = NODES) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("10.0.0."), F.col("id").cast("string"), F.lit(":20000")).alias("address"), F.col("id").cast("int").alias("idx"))


def disks(spark: SparkSession, n: int = NODES) -> DataFrame:
    d = F.concat(F.lit("d"), (F.col("id") % 2).cast("string"))
    node = F.concat(F.lit("n"), F.expr("id div 2").cast("string"))
    return spark.range(2 * n).select(node.alias("node"), d.alias("disk"), F.concat(F.lit("/srv/"), node, F.lit("/"), d).alias("path"))


def replicas(spark: SparkSession, vdisks: int = VDISKS, n: int = NODES, copies: int = REPLICAS) -> DataFrame:
    """Replica r of virtual disk v is on node (v + r) mod n."""
    v, r = F.expr(f"id div {copies}"), F.col("id") % copies
    return spark.range(vdisks * copies).select(v.alias("vdisk_id"), r.cast("int").alias("ord"), F.concat(F.lit("n"), ((v + r) % n).cast("string")).alias("node"), F.concat(F.lit("d"), (v % 2).cast("string")).alias("disk"))


def samples(events: DataFrame) -> DataFrame:
    """Metric samples: name, kind, value, ts (seconds), seq."""
    kind = F.element_at(F.array(F.lit("counter"), F.lit("gauge"), F.lit("timer")), (F.pmod(F.length("event_type"), F.lit(3)) + 1).cast("int"))
    return events.select(F.col("event_type").alias("name"), kind.alias("kind"), "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
