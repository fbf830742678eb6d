"""Metric samples to counters, gauges, timers and rates; all also run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole(col: str):
    """Values are recorded as whole numbers, rounded down."""
    return F.floor(F.col(col)).cast("long")


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.sum(whole("value")).alias("value"), F.max("ts").alias("ts"))


def gauges(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.max_by(whole("value"), "seq").alias("value"), F.max("ts").alias("ts"))


def timers(samples: DataFrame, every: int) -> DataFrame:
    """Whole-number mean of each flush of ``every`` seconds."""
    flush = (F.floor(F.col("ts") / every) * every).alias("flush_ts")
    return samples.groupBy("name", flush).agg(F.expr("sum(CAST(floor(value) AS BIGINT)) div count(*)").alias("mean"))


def rates(samples: DataFrame, seconds: int = 5) -> DataFrame:
    """<name>_rate: a counter's sum in each window, divided by its seconds, rounded down."""
    opened = (F.floor(F.col("ts") / seconds) * seconds).alias("window_ts")
    return samples.groupBy(F.concat("name", F.lit("_rate")).alias("name"), opened).agg(F.expr(f"sum(CAST(floor(value) AS BIGINT)) div {seconds}").alias("value"))


def merged(samples: DataFrame) -> DataFrame:
    """One row for each metric, whichever its kind: counters, gauges and timers together."""
    of = lambda kind: samples.where(F.col("kind") == kind)
    mean = of("timer").groupBy("name").agg(F.expr("sum(CAST(floor(value) AS BIGINT)) div count(*)").alias("value"), F.max("ts").alias("ts"))
    return counters(of("counter")).unionByName(gauges(of("gauge"))).unionByName(mean)


def graphite_lines(merged_metrics: DataFrame, prefix: str) -> DataFrame:
    return merged_metrics.select(F.format_string(f"{prefix}.%s %d %d", F.col("name"), F.col("value"), F.col("ts")).alias("line"))


def deltas(samples: DataFrame, by: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Each sample less the one before it, null for the first."""
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def disk_load(samples: DataFrame) -> DataFrame:
    """samples: disk, ms, ops, busy_ms (counters). Operations a second and busy share between
    neighbouring samples more than 500 ms apart; a counter that wraps at 2**32 goes on."""
    w = Window.partitionBy("disk").orderBy("ms")
    step = lambda c: F.pmod(F.col(c) - F.lag(c).over(w), F.lit(1 << 32))
    both = samples.withColumns({"elapsed": F.col("ms") - F.lag("ms").over(w), "d_ops": step("ops"), "d_busy": step("busy_ms")}).where("elapsed > 500")
    return both.select("disk", "ms", (F.col("d_ops") * 1000 / F.col("elapsed")).alias("iops"), (F.col("d_busy") * 100 / F.col("elapsed")).alias("util"))


def iowait(cpu: DataFrame) -> DataFrame:
    """cpu: line ('cpu a b c …'). The fifth number's share of their sum, in percent."""
    n = F.transform(F.filter(F.split("line", r"\s+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))
    return cpu.select(*(c for c in cpu.columns if c != "line"), (F.get(n, F.lit(4)) * 100.0 / F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)).alias("iowait"))


def throughput(ops: DataFrame) -> DataFrame:
    """Per second: operations, mean value."""
    return ops.groupBy(F.col("ts").alias("second")).agg(F.count("*").alias("ops"), F.avg("value").alias("mean_value"))


def error_histogram(errors: DataFrame, code: str) -> DataFrame:
    return errors.groupBy(code).agg(F.count("*").alias("times"))


def averages(ops: DataFrame) -> DataFrame:
    """Over a whole run: operations, seconds, operations a second, mean value."""
    span = F.max("ts") - F.min("ts") + 1
    return ops.agg(F.count("*").alias("ops"), span.alias("seconds"), (F.count("*") / span).alias("rps"), F.avg("value").alias("mean_value"))


def rate_limited(errors: DataFrame, code: str, interval: int) -> DataFrame:
    """One line for each error in each interval: how often, and when last."""
    return errors.groupBy(code, (F.floor(F.col("ts") / interval) * interval).alias("since")).agg(F.count("*").alias("times"), F.max("ts").alias("last"))


#: Operations and layers that are counted and timed, and gauges; fixed names.
OPERATIONS, LAYERS = ("put", "get", "exist", "delete"), ("cluster_grinder", "client")
GAUGES = (
    "link_manager.nodes_number", "backend.backend_state", "backend.blob_count", "backend.corrupted_blob_count", "backend.bloom_filters_ram", "backend.alien_count", "backend.index_memory", "backend.active_disks",
    "backend.disks", "hardware.disks", "backend.used_disk", "hardware.descr_amount", "hardware.cpu_iowait", "hardware.available_ram", "hardware.used_ram", "hardware.total_ram", "hardware.used_swap",
    "hardware.free_space", "hardware.used_space", "hardware.total_space",
)


def catalogue(spark: SparkSession) -> DataFrame:
    """name and kind of every metric: for each layer and operation a counter, an error counter
    and a timer, for existence checks their keys too; and the gauges."""
    ops = [(f"{layer}.{op}_{what}", "timer" if what == "timer" else "counter") for layer in LAYERS for op in OPERATIONS for what in ("count", "error_count", "timer")]
    keys = [(f"{layer}.exist_{what}", "counter") for layer in LAYERS for what in ("keys_count", "error_keys_count")]
    return spark.createDataFrame(ops + keys + [(g, "gauge") for g in GAUGES], "name string, kind string")
