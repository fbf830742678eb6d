"""Text files: disk events, kernel counters, and payloads in files named by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DISK_EVENTS = "disk_name string, is_alien boolean, new_state string, datetime string"


def write_disk_events(events: DataFrame, path: str) -> None:
    events.select("disk_name", "is_alien", "new_state", "datetime").write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_disk_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DISK_EVENTS).option("sep", ";").option("header", True).csv(path)


def disk_states(events: DataFrame) -> DataFrame:
    """Each disk's last state, and how many changes skipped a step of NotReady, Initialized,
    Ready (a disk may always fall back to NotReady)."""
    from pyspark.sql import Window

    w = Window.partitionBy("disk_name", "is_alien").orderBy("datetime")
    before = F.lag("new_state", 1, "NotReady").over(w)
    fine = (F.col("new_state") == "NotReady") | ((before == "NotReady") & (F.col("new_state") == "Initialized")) | ((before == "Initialized") & (F.col("new_state") == "Ready")) | (before == F.col("new_state"))
    return events.withColumn("bad", ~fine).groupBy("disk_name", "is_alien").agg(F.max_by("new_state", "datetime").alias("state"), F.count_if("bad").alias("bad_changes"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Lines of counters by position, as /proc shows them."""
    return spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words"))


def read_keyed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """key and payload of files whose names follow a pattern with one {key} of digits."""
    head, found, tail = pattern.rpartition("/")[2].partition("{key}")
    if not found or "{key}" in tail:
        raise ValueError("the pattern needs one {key}")
    files = spark.read.format("binaryFile").load(pattern.replace("{key}", "*"))
    name = F.element_at(F.split("path", "/"), -1)
    key = F.substring(name, F.lit(len(head) + 1), F.length(name) - len(head) - len(tail))
    return files.where(key.rlike("^[0-9]+$")).select(key.cast("long").alias("key"), F.col("content").alias("payload"))


def write_keyed_files(blobs: DataFrame, pattern: str) -> None:
    """blobs: key, payload. Writes each payload to the file of its key; the pattern holds {key},
    and its folder is one that all executors share."""
    if pattern.count("{key}") != 1:
        raise ValueError("the pattern needs one {key}")

    def write(rows) -> None:  # noqa: ANN001
        from pyarrow import fs

        for row in rows:
            at, path = fs.FileSystem.from_uri(pattern.replace("{key}", str(row.key)))
            with at.open_output_stream(path) as out:
                out.write(bytes(row.payload))

    blobs.select("key", "payload").foreachPartition(write)


def folders(files: DataFrame, root: str) -> DataFrame:
    """files: path. Every folder on the way from root to a file: path, name, parent; files
    themselves are left out."""
    steps = F.slice(F.split(F.expr(f"substring(path, locate('{root}', path) + {len(root.rstrip('/'))})"), "/"), 2, 1 << 30)
    names = files.where(F.contains("path", F.lit(root))).select(steps.alias("s"))
    depth = names.where("size(s) > 1").select("s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("n"))
    join = lambda n: F.concat_ws("/", F.lit(root.rstrip("/")), F.slice("s", 1, n))
    return depth.select(join(F.col("n")).alias("path"), F.get("s", F.col("n") - 1).alias("name"), join(F.col("n") - 1).alias("parent")).distinct()
