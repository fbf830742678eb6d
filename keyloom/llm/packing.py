"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then one for each binary digit of the rest, longest first. Pieces of
equal length form a bucket; every piece is a sequence of its own, so no sequence crosses
documents and none holds padding.

Sequences are numbered longest bucket first, within a bucket in the order of the input. Each
task ranks its pieces by length as it cuts them; only the counts of each part and length are
then summed up, so ids are neither sorted nor shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import shared, tokens

#: Parts (blocks of input files or tasks) whose counts by length are sent to all workers, 11
#: numbers each at 1024 tokens; beyond, pieces meet their part's counts in a shuffle.
BROADCAST_PARTS = 100_000


def decompose(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, start, length) of each piece of documents of n tokens, in order."""
    full = n // longest
    doc, first = np.repeat(np.arange(len(n)), full), np.cumsum(full) - full
    start = (np.arange(len(doc)) - np.repeat(first, full)) * longest
    parts = [(doc, start, np.full(len(doc), longest))]
    bit = longest >> 1
    while bit:
        doc = np.flatnonzero(n & bit)
        parts.append((doc, n[doc] // (2 * bit) * (2 * bit), np.full(len(doc), bit)))
        bit >>= 1
    doc, start, length = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def pieces(
    docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, with_ids: bool = True, in_file_order: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenizes whole texts, appends ``end_id`` and cuts each document into binary-length pieces.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, with ``with_ids`` the piece's ids as
    little-endian unsigned 32-bit integers, and part_file, part_first, rank: the part the piece
    was cut in and its number there among those of its length. With ``in_file_order`` docs must
    be read straight from Parquet, and parts follow the order of its files and rows; else they
    are tasks. A null text counts as empty and gives the end id alone; null or repeated doc_ids
    keep one set of pieces for each row.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    long = T.LongType()
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens")),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
            T.StructField("part_file", T.StringType()),
            T.StructField("part_first", long),
            T.StructField("rank", long),
        ]
    )
    size_class = longest.bit_length()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, True).encode
        part, last, ranks = None, None, np.zeros(size_class, np.int64)
        for batch in batches:
            texts, files, rows = batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            edges = [0]  # where a new block of a file begins
            for i, at in enumerate(zip(files, rows)):
                if last is None or at[0] != last[0] or at[1] != last[1] + 1:
                    edges.append(i)
                last = at
            for low, high in zip(edges, [*edges[1:], len(texts)]):
                if low == high:
                    continue
                if part is None or low in edges[1:]:
                    part, ranks = (files[low], rows[low]), np.zeros(size_class, np.int64)
                for a, b in tokens.slices(texts[low:high]):
                    ids, sizes = encode(texts[low + a : low + b])
                    n = sizes + 1
                    ids = np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id)
                    doc, start, length = decompose(n, longest)
                    at = (np.cumsum(n) - n)[doc] + start
                    raw = memoryview(ids.tobytes())
                    cuts = [raw[4 * i : 4 * j] for i, j in zip(at.tolist(), (at + length).tolist())]
                    rank = np.zeros(len(length), np.int64)
                    for k in range(size_class):
                        mine = np.flatnonzero(length == 1 << k)
                        rank[mine] = ranks[k] + np.arange(len(mine))
                        ranks[k] += len(mine)
                    out = [batch.column(0).slice(low + a, b - a).take(pa.array(doc)), *map(pa.array, (start, length, [zlib.crc32(x) for x in cuts], n[doc]))]
                    if with_ids:
                        out.append(pa.array([bytes(x) for x in cuts], pa.binary()))
                    out += [pa.array([part[0]] * len(doc), pa.string()), pa.array(np.full(len(doc), part[1])), pa.array(rank)]
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    place = docs.metadataColumn("_metadata") if in_file_order else None
    where = (place["file_path"], place["row_index"]) if in_file_order else (F.lpad(F.spark_partition_id().cast("string"), 10, "0"), F.monotonically_increasing_id())
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *where).mapInArrow(cut, schema)


def number_sequences(cut: DataFrame) -> DataFrame:
    """Adds sequence_id and offset: each piece is a sequence, numbered without gaps. ``cut`` is
    read twice, so it should be a written table.

    Files count by the number in their names, as Spark writes ranges, then by name. The table
    of counts, a row for each part and length, alone is ordered in one task.
    """
    counts = cut.groupBy("length", "part_file", "part_first").agg(F.count("*").alias("pieces"))
    nth_file = F.regexp_extract("part_file", r"part-([0-9]+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(F.desc("length"), nth_file, "part_file", "part_first").rowsBetween(Window.unboundedPreceding, -1)
    counts = shared.keep(counts, "piece-counts").withColumn("first", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    firsts = shared.keep(counts.groupBy("part_file", "part_first").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts")), "part-firsts")
    if firsts.count() <= BROADCAST_PARTS:
        firsts = F.broadcast(firsts)
    return (
        cut.join(firsts, ["part_file", "part_first"])
        .withColumn("sequence_id", F.element_at("firsts", F.col("length")) + F.col("rank"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("part_file", "part_first", "rank", "firsts")
    )


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, with_ids: bool = True, in_file_order: bool = False, **cols: str) -> DataFrame:
    """Pieces of all documents with their sequences; see ``pieces`` and ``number_sequences``.
    An empty table gives no pieces; columns but the id and the text are left out."""
    return number_sequences(shared.keep(pieces(docs, tokenizer, longest, end_id, with_ids, in_file_order, **cols), "pieces"))
