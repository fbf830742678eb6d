"""The batch operators on streams: the same functions, with an output mode of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators import metrics, versions


def _to_parquet(out: DataFrame, path: str, checkpoint: str | None) -> StreamingQuery:
    """Each batch's whole result replaces the one before it in Parquet at ``path``; none of it
    comes to the driver."""

    def write(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start()


def latest_stream(log: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keeps the newest version of every key in Parquet at ``path``; late records are never
    dropped, and one older than the newest changes nothing."""
    return _to_parquet(versions.latest(log), path, checkpoint)


def counter_stream(samples: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    return _to_parquet(metrics.counters(samples), path, checkpoint)


def rate_stream(samples: DataFrame, delay: str = "1 minute", seconds: int = 5) -> DataFrame:
    """Rates by event time: windows close, and leave the state, ``delay`` after they end."""
    timed = samples.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", delay)
    return timed.groupBy(F.window("time", f"{seconds} seconds"), "name").agg(F.expr(f"sum(CAST(floor(value) AS BIGINT)) div {seconds}").alias("value"))
