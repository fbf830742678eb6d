"""Content-addressed store of token-id streams.

A rolling hash over the last ids of a document cuts its ids into chunks, so equal passages give
equal chunks in whatever document they stand and whatever is stored beside it. The store has:

* ``entries/kind=chunk``: digest and ids of each distinct chunk, once.
* ``recipes``: for each document, in ascending doc_id order, its number of ids, its chunks'
  digests and sizes in order, and their Merkle root. ``part`` numbers the range of documents,
  ``nth`` the document within it, ``inside`` the ids of the part before it.
* ``manifest``: for each part its documents, ids and the Merkle root over its documents' roots,
  and in the row of part -1 the same over all parts.

``entries/kind=document`` holds the recipes before they are sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import tokens

#: A chunk ends where the low bits of the rolling hash are zero: 256 ids on average.
CUT_BITS = 8
#: A chunk without such a place ends after so many ids.
LONGEST = 4096


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Tree:
    """Merkle root of leaves that come one by one; it holds a node for each binary digit of
    their number. A last node without a partner moves up as it is."""

    def __init__(self):
        self.n, self.nodes = 0, []

    def add(self, leaf: bytes) -> None:
        self.n += 1
        self.nodes.append(leaf)
        k = self.n
        while k % 2 == 0:
            right = self.nodes.pop()
            self.nodes[-1] = digest(b"\x01" + self.nodes[-1] + right)
            k //= 2

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        out = self.nodes[-1]
        for left in self.nodes[-2::-1]:
            out = digest(b"\x01" + left + out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _scrambled() -> np.ndarray:
    h = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


#: The scrambled value of each 16-bit id.
_SCRAMBLED = _scrambled()
#: Bytes that the memo of units may take here.
MEMO_BYTES = 128_000_000
#: Ids that the rolling hash spans.
WINDOW = 32


def rolling(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """At each id of documents that stand one after another, a hash of it and of the 31 before it
    in its document: the sum of their scrambled values, each shifted by its distance, built by
    doubling. Zeros between the documents part them."""
    at = np.arange(len(ids)) + WINDOW * np.repeat(np.arange(len(sizes)), sizes)
    spread = np.zeros(len(ids) + WINDOW * len(sizes), np.uint32)
    spread[at] = _SCRAMBLED[ids]
    for step in (1, 2, 4, 8, 16):
        spread[step:] = spread[step:] + (spread[:-step] << np.uint32(step))
    return spread[at]


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of all chunks of documents that stand one after another and end at ``ends``."""
    cut = np.flatnonzero(rolling(ids, np.diff(ends, prepend=0)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    cut = np.union1d(cut, ends)
    gaps = np.diff(cut, prepend=0)
    long = np.flatnonzero(gaps > LONGEST)
    more = [np.arange(cut[i] - gaps[i] + LONGEST, cut[i], LONGEST) for i in long]
    return np.union1d(cut, np.concatenate(more)) if more else cut


def entries(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: the chunks, each once in a slice of documents, under their digest as
    key; and for each row of docs its recipe, under a key of its own. A null text counts as
    empty."""
    ids_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_id", ids_type),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("root", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, False, MEMO_BYTES).encode
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in tokens.slices(texts):
                ids, sizes = encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u2")
                ends = np.cumsum(sizes + 1)
                stop = chunk_ends(ids, ends)
                start = np.concatenate([[0], stop[:-1]])
                raw = ids.tobytes()
                found = [raw[2 * i : 2 * j] for i, j in zip(start.tolist(), stop.tolist())]
                names = [digest(x) for x in found]
                stored = dict(zip(names, found))
                edges = np.concatenate([[0], np.searchsorted(stop, ends) + 1]).astype(np.int32)
                n, m = b - a, len(stored)
                keys = [task.to_bytes(8, "big") + (nth + i).to_bytes(8, "big") for i in range(n)]
                nth += n
                own = edges.tolist()
                roots = [merkle(names[i:j]) for i, j in zip(own, own[1:])]
                none = lambda kind, k: pa.nulls(k, kind)
                columns = [
                    pa.array(["chunk"] * m + ["document"] * n),
                    pa.array([*stored, *keys], pa.binary()),
                    pa.array([*stored.values(), *[None] * n], pa.binary()),
                    pa.concat_arrays([none(batch.column(0).type, m), batch.column(0).slice(a, n)]),
                    pa.concat_arrays([none(pa.int64(), m), pa.array(sizes + 1, pa.int64())]),
                    pa.concat_arrays([none(pa.list_(pa.binary()), m), pa.ListArray.from_arrays(pa.array(edges), pa.array(names, pa.binary()))]),
                    pa.concat_arrays([none(pa.list_(pa.int32()), m), pa.ListArray.from_arrays(pa.array(edges), pa.array((stop - start).astype(np.int32)))]),
                    pa.array([*[None] * m, *roots], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


_RECIPE = ["doc_id", "n_tokens", "digests", "sizes", "root"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part, nth and inside to sorted recipes; the last row of a part also has the part's
    documents, ids and root."""
    part, tree, total, held = TaskContext.get().partitionId(), Tree(), 0, None

    def out(batch: pa.RecordBatch, nth: int, inside: np.ndarray, last: bool) -> pa.RecordBatch:
        n = batch.num_rows
        end = [None] * (n - 1)
        sums = [pa.array(end + [x if last else None], kind) for x, kind in ((tree.n, pa.int64()), (total, pa.int64()), (tree.root(), pa.binary()))]
        own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nth, nth + n)), pa.array(inside)]
        return pa.RecordBatch.from_arrays([*batch.columns, *own, *sums], names=[*_RECIPE, "part", "nth", "inside", "part_documents", "part_tokens", "part_root"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield out(*held, last=False)
        sizes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = batch, tree.n, total + np.cumsum(sizes) - sizes
        total += int(sizes.sum())
        for root in batch.column(4).to_pylist():
            tree.add(root)
    if held is not None:
        yield out(*held, last=True)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, **cols: str) -> None:
    """Writes the store of all documents, one recipe for each row. An empty table gives empty
    tables.

    Ids are shuffled once, at most one copy of a chunk from each task: Spark sums up within
    tasks before it shuffles, so a chunk that very many documents share gathers nowhere.
    """
    spark = docs.sparkSession
    found = entries(docs, tokenizer, end_id, **cols)
    first = [F.first(c).alias(c) for c in ("ids", *_RECIPE)]
    once = found.groupBy("kind", "key").agg(*first)
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/entries")

    recipe = T.StructType([f for f in once.schema.fields if f.name in ("key", *_RECIPE)])
    unsorted = spark.read.schema(T.StructType([*recipe.fields, T.StructField("kind", T.StringType())])).parquet(f"{path}/entries").where("kind = 'document'")
    ordered = unsorted.repartitionByRange("doc_id", "root", "key").sortWithinPartitions("doc_id", "root", "key").select(*_RECIPE)
    long = T.LongType()
    added = [("part", T.IntegerType()), ("nth", long), ("inside", long), ("part_documents", long), ("part_tokens", long), ("part_root", T.BinaryType())]
    schema = T.StructType([*(ordered.schema[c] for c in _RECIPE), *(T.StructField(*f) for f in added)])
    ordered.mapInArrow(_numbered, schema).write.parquet(f"{path}/recipes")

    parts = spark.read.parquet(f"{path}/recipes").where("part_root IS NOT NULL").select("part", "part_documents", "part_tokens", "part_root").orderBy("part").collect()  # a row for each range
    whole = [(-1, sum(p.part_documents for p in parts), sum(p.part_tokens for p in parts), merkle([bytes(p.part_root) for p in parts]))]
    rows = whole + [(p.part, p.part_documents, p.part_tokens, bytes(p.part_root)) for p in parts]
    spark.createDataFrame(rows, "part int, documents long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict[int, tuple[int, int, int, bytes]]:
    """Part -> (ids of all parts before, documents, ids, root), a row for each range of
    documents, checked against the row over all parts."""
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/manifest").collect()))
    if not rows or rows[0][0] != -1:
        raise ValueError("the manifest has no root")
    (_, documents, n_tokens, root), parts = rows[0], rows[1:]
    if (documents, n_tokens, bytes(root)) != (sum(p[1] for p in parts), sum(p[2] for p in parts), merkle([bytes(p[3]) for p in parts])):
        raise ValueError("the manifest's parts do not match its root")
    before = np.cumsum([0, *(p[2] for p in parts)]).tolist()
    return {p[0]: (b, p[1], p[2], bytes(p[3])) for p, b in zip(parts, before)}


def _sound(recipes: DataFrame, parts: dict[int, tuple[int, int, int, bytes]]) -> DataFrame:
    """The steps of all recipes: part, nth, doc_id, start, n_tokens, digest, n and after (the ids
    that follow in the document). Raises an error where a document's digests do not match its
    root, its sizes its length, or a part's documents the manifest."""
    doc_id = recipes.schema["doc_id"].dataType
    long = T.LongType()
    fields = [("part", T.IntegerType()), ("nth", long), ("doc_id", doc_id), ("start", long), ("n_tokens", long), ("digest", T.BinaryType()), ("n", long), ("after", long)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    rows = recipes.select("part", "nth", "inside", *_RECIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, total = None, Tree(), 0

        def ended() -> None:
            if part is not None and (tree.n, total, tree.root()) != parts[part][1:]:
                raise ValueError(f"part {part} does not match the manifest")

        for batch in batches:
            steps: list[list] = [[] for _ in fields]
            for of, nth, inside, doc, n_tokens, digests, sizes, root in zip(*(c.to_pylist() for c in batch.columns)):
                if of != part:
                    ended()
                    part, tree, total = of, Tree(), 0
                    if of not in parts:
                        raise ValueError(f"the manifest has no part {of}")
                if merkle(digests) != root or sum(sizes) != n_tokens or len(sizes) != len(digests):
                    raise ValueError(f"a recipe of part {of} does not match its root")
                if (nth, inside) != (tree.n, total):
                    raise ValueError(f"part {of} lacks documents")
                tree.add(root)
                total += n_tokens
                left = n_tokens
                for name, n in zip(digests, sizes):
                    left -= n
                    for column, value in zip(steps, (of, nth, doc, parts[of][0] + inside, n_tokens, name, n, left)):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), batch.column(3).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(steps, kinds)], names=schema.names)
        ended()

    return rows.repartition("part").sortWithinPartitions("part", "nth").mapInArrow(run, schema)


def _crc_powers() -> np.ndarray:
    """For each k, byte tables of the operator that carries a CRC-32 over 2**k zero bytes."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1).astype(np.uint32)

    def apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]

    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([rows[byte], *((byte << np.uint32(8 * i)) >> np.uint32(8) for i in (1, 2, 3))])
    out = [one]
    for _ in range(47):
        out.append(np.stack([apply(out[-1], t) for t in out[-1]]))
    return np.stack(out)


_POWERS = _crc_powers()


def crc_carried(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds, by exclusive or, to that of a whole that goes on for n_bytes."""
    crc = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        at, t = np.flatnonzero((n_bytes >> k) & 1), _POWERS[k]
        c = crc[at]
        crc[at] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return crc


@F.pandas_udf(T.LongType())
def _carried(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series(crc_carried(crc.fillna(0).to_numpy(), n_bytes.to_numpy()).astype(np.int64))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stored chunk's own digest against its name, and the CRC-32 of its 32-bit ids."""
    for batch in batches:
        names, stored = (batch.column(i).to_pylist() for i in (0, 1))
        for name, raw in zip(names, stored):
            if digest(raw) != name:
                raise ValueError(f"chunk {name.hex()} does not match its content")
        crc = [zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4")) for raw in stored]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array([len(x) // 2 for x in stored], pa.int64())], names=["digest", "crc", "stored"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Reads the store back: doc_id, start, n_tokens and ids_crc32 of each row stored.

    The manifest is checked against its root, parts against the manifest, recipes against their
    parts' and their own roots, and chunks against their digests, once each. A document's CRC is
    the exclusive or of its recipe's chunks' CRCs, each carried over the bytes that follow it, so
    no ids are shuffled. Whatever does not fit raises an error.
    """
    parts = manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    held = {r.part for r in recipes.select("part").distinct().collect()}  # a number for each range
    if held != set(parts):
        raise ValueError(f"parts that only the recipes or only the manifest has: {sorted(held ^ set(parts))[:9]}")
    crcs = _chunks(spark, path).mapInArrow(_checked, "digest binary, crc long, stored long")
    steps = _sound(recipes, parts).join(crcs, "digest", "left")
    fits = F.when(F.col("stored") == F.col("n"), _carried("crc", F.col("after") * 4)).otherwise(F.raise_error("a recipe's chunk is missing or of another size").cast("long"))
    out = steps.withColumn("part_crc", fits).groupBy("part", "nth", "doc_id", "start", "n_tokens").agg(F.bit_xor("part_crc").alias("ids_crc32"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, ids binary, kind string").parquet(f"{path}/entries").where("kind = 'chunk'").select(F.col("key").alias("digest"), "ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of each row stored, put together again from its chunks."""
    steps = _sound(spark.read.parquet(f"{path}/recipes"), manifest(spark, path)).join(_chunks(spark, path), "digest")
    whole = steps.groupBy("part", "nth", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids"))).alias("s"))
    return whole.select("doc_id", "start", F.expr("aggregate(s, CAST(X'' AS BINARY), (a, x) -> a || x.ids)").alias("ids"))
