"""Outcomes of replicated writes and deletes, from a table of each node's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quorum(answers: DataFrame, need: int) -> DataFrame:
    """answers: op, node, ok, replicas (how many of the key's replicas that node holds).

    A node that answers counts for all its replicas. Below the quorum the write still succeeds,
    through aliens on other nodes for what failed: status is then alien."""
    got = F.coalesce(F.sum(F.when(F.col("ok"), F.col("replicas"))), F.lit(0)).cast("long")
    return answers.groupBy("op").agg(got.alias("written"), F.count_if(~F.col("ok")).alias("failed")).withColumn(
        "status", F.when((F.col("written") >= need) & (F.col("failed") == 0), "ok").when(F.col("written") >= need, "ok, hand off").otherwise("alien")
    )


def simple(answers: DataFrame, need: int) -> DataFrame:
    """The simple policy writes to all nodes; as many as the quorum must answer."""
    return answers.groupBy("op").agg(F.count_if("ok").alias("written")).withColumn("status", F.when(F.col("written") >= need, "ok").otherwise("failed"))


def delete(answers: DataFrame) -> DataFrame:
    """A delete's tombstones: plain ones on targets that answer, forced ones elsewhere for each
    target that does not, so it succeeds for every op."""
    return answers.groupBy("op").agg(F.count_if("ok").alias("plain"), F.count_if(~F.col("ok")).alias("forced")).withColumn("status", F.lit("ok"))
