"""A partitioned Parquet store of records: append, attach, detach and drop partitions.

Records lie under source, vdisk_id and start_ts, the time partition. Late records are appended
to their old partition; nothing is dropped for being late. Paths go through Spark's own file
systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import partitions

LAYOUT = ("source", "vdisk_id", "start_ts")


class Store:
    def __init__(self, spark: SparkSession, path: str, period: int = partitions.DAY):
        self.spark, self.path, self.period = spark, path, period

    def append(self, records: DataFrame) -> None:
        """Writes records by partition; those of one partition meet in few files."""
        placed = records.withColumn("start_ts", partitions.start(F.col("ts"), self.period))
        placed.repartition(*LAYOUT).write.mode("append").partitionBy(*LAYOUT).option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/live")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/live")

    def partitions(self) -> DataFrame:
        """The partitions there are, by start: from the folders' names alone."""
        rows = [(source, int(vdisk), int(start)) for source, vdisk, start in self._folders()]
        return self.spark.createDataFrame(sorted(rows), "source string, vdisk_id long, start_ts long")

    def _folders(self) -> list[tuple[str, ...]]:
        """The values in the names of all partitions' folders; a listing, a row for each."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live/source=*/vdisk_id=*/start_ts=*")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return [tuple(part.partition("=")[2] for part in str(f.getPath().toString()).split("/")[-3:]) for f in found]

    def detach_all(self, source: str = "alien") -> int:
        """Detaches all partitions of a source; their files stay. Returns how many."""
        found = [(int(vdisk), int(start)) for of, vdisk, start in self._folders() if of == source]
        for vdisk, start in found:
            self.detach(vdisk, start, source)
        return len(found)

    def _move(self, vdisk: int, start: int, source: str, back: bool) -> None:
        here, there = (f"{self.path}/{top}/source={source}/vdisk_id={vdisk}/start_ts={start}" for top in (("detached", "live") if back else ("live", "detached")))
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        a, b = jvm.org.apache.hadoop.fs.Path(here), jvm.org.apache.hadoop.fs.Path(there)
        fs = a.getFileSystem(conf)
        if not fs.exists(a):
            raise ValueError(f"no partition {here}")
        if fs.exists(b):
            raise ValueError(f"partition {there} is there already")
        fs.mkdirs(b.getParent())
        fs.rename(a, b)

    def detach(self, vdisk: int, start: int, source: str = "normal") -> None:
        self._move(vdisk, start, source, False)

    def attach(self, vdisk: int, start: int, source: str = "normal") -> None:
        self._move(vdisk, start, source, True)

    def drop(self, vdisk: int, start: int, source: str = "normal") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live/source={source}/vdisk_id={vdisk}/start_ts={start}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True):
            raise ValueError(f"no partition {path}")
