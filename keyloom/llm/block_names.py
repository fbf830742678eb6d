"""Exact dedup by deterministic block naming, in DataFrame operations alone.

Every text is cut into blocks of fixed size. The distinct blocks are sorted and get integer
names; then adjacent names are paired, the distinct pairs sorted and named in turn, until one
name is left for each document. Two documents have the same number of blocks and the same
last name exactly if their texts are equal: names stand for contents, never for hashes.

Contents are shuffled once, one copy a task at most. To find its block's name again, an
occurrence carries the block's two 64-bit hashes; should two distinct blocks ever share both,
all occurrences are joined by content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import shared

BLOCK_BYTES = 512


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), shared.SPACE + "+", " ")


def two_hashes(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def _named(values: DataFrame, *cols: str) -> DataFrame:
    """The distinct rows, sorted within their partitions, with an integer name each. Written
    before use, so that the names never change."""
    return values.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES, hashes: Callable[[Column], tuple[Column, Column]] = two_hashes) -> DataFrame:
    """rows: doc_id, version, body (binary) and its number of blocks, n_blocks; they are read several
    times. Returns doc_id, version, n_blocks, name."""
    cut = rows.select(
        "doc_id", "version", "n_blocks", "body", F.posexplode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("at", "_")
    )
    cut = cut.withColumn("block", F.substring("body", F.col("at") * block_bytes + 1, F.lit(block_bytes)))
    one, two = hashes(F.col("block"))
    names = shared.keep(_named(cut, "block").select(one.alias("h1"), two.alias("h2"), "name"), "block-names")
    places = cut.select("doc_id", "version", "n_blocks", "at", one.alias("h1"), two.alias("h2"), "block")
    if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        level = places.drop("block").join(names, ["h1", "h2"])
    else:
        contents = shared.keep(_named(cut, "block"), "block-contents")
        level = places.join(contents, "block")
    level = level.select("doc_id", "version", "n_blocks", F.col("n_blocks").alias("left"), "at", "name")

    blocks = rows.select(F.max("n_blocks")).first()[0] or 0
    done = [level.where("left = 1")]
    while blocks > 1:
        pairs = shared.keep(
            level.where("left > 1")
            .groupBy("doc_id", "version", "n_blocks", F.expr("(left + 1) div 2").cast("int").alias("left"), F.expr("at div 2").cast("int").alias("at"))
            .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")),
            "pairs",
        )
        level = pairs.join(shared.keep(_named(pairs, "a", "b"), "pair-names"), ["a", "b"]).drop("a", "b")
        done.append(level.where("left = 1"))
        blocks = (blocks + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "version", "n_blocks", "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashes=two_hashes) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the least doc_id with an equal text),
    group_size, kept, text_sha256 of the normalised text.

    A null text counts as empty, and all empty texts are equal. Rows with one doc_id count each
    in group_size; those with the doc_id that stays are all kept. A null doc_id never stays
    unless no other row has the text. An empty table gives no rows; other columns are left out.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("body"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    # Written, so that texts are normalised once and each use reads only the columns it needs.
    rows = shared.keep(body.select("doc_id", F.xxhash64("body").alias("version"), n_blocks.alias("n_blocks"), F.sha2("body", 256).alias("text_sha256"), "body"), "normalised")
    named = identities(rows, block_bytes, hashes).distinct()
    every = rows.select("doc_id", "version", "text_sha256").alias("r")
    every = shared.keep(
        every.join(named.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.version") == F.col("n.version"))).select("r.doc_id", "text_sha256", "n_blocks", "name"),
        "identities",
    )
    # Written before it is joined: so both sides have a shuffle of their own, and Spark can split
    # the rows of a large group.
    groups = shared.keep(every.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return every.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
