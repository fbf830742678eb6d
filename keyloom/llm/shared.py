"""Small helpers of the training-data operators: reading inputs and cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.shared import new_path

#: ASCII white space, as Java and DuckDB regular expressions and bytes.split() see it.
SPACE = r"[\x20\x09-\x0D]"

#: Paths of the tables that ``keep`` has written and that nobody has removed.
_KEPT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a frame to the shared folder and reads it back: it is computed once, and a lost
    executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables kept within are removed at the end, but for the paths put in the list given."""
    mark, stays = len(_KEPT), []
    try:
        yield stays
    finally:
        for path in _KEPT[mark:]:
            if path not in stays:
                remove(spark, path)
        _KEPT[mark:] = stays


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def last_kept() -> str:
    """The path of the table kept last."""
    return _KEPT[-1]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
