"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Documents are counted over hashed words, trigrams of character classes and a few sums about
repeated words and lines. Words and trigrams are weighted by how few of all documents have them.
A singular value decomposition of the labelled documents' weighted counts gives the latent space. The labelled vectors, bounded by ``PER_LABEL`` for each label, are broadcast;
every document's cosine with all of them is computed in blocks, and the nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import tokens, words

#: Labelled documents of each label that the model learns from, those with the least MD5 of
#: their doc_id: the bound of what is broadcast.
PER_LABEL = 2048
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 25, 8
BLOCK = 1024

#: Classes of bytes: other white space, space, lower, upper, digit, beyond ASCII, ends of
#: sentences, commas and the like, exclamation, bars, signs, other.
_CLASSES = np.full(256, 11, np.int64)
for _k, _members in enumerate(
    (b"\t\n\r\x0b\x0c", b" ", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".", b",;:'\"()-", b"!?", b"|<>{}[]=", b"#$%&*@~^_\\/+")
):
    _CLASSES[list(_members)] = _k
_N = 12
TRIGRAMS = _N**3
#: Words are counted in so many hashed places.
WORDS = 512
TERMS = TRIGRAMS + WORDS
WIDTH = TERMS + 8


def features(texts: list[bytes]) -> np.ndarray:
    """A row of damped relative counts for each text. An empty text has no trigrams, and the sums
    of one line without words."""
    n = len(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    out[size == 0, TERMS:] = (0, 0, 0, 0, 0, 0, 1, 0.3)
    if not len(raw):
        return out
    owner = np.repeat(np.arange(n), size)
    kind = _CLASSES[raw]
    if len(raw) > 2:
        code = (kind[:-2] * _N + kind[1:-1]) * _N + kind[2:]
        inside = owner[:-2] == owner[2:]
        out[:, :TRIGRAMS] = np.bincount((owner[:-2] * TRIGRAMS + code)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(out[:, :TRIGRAMS] / np.maximum(size, 1)[:, None])
    word, ends = words.word_hashes(texts)
    counts = np.diff(ends, prepend=0)
    place = np.repeat(np.arange(n), counts) * WORDS + (word >> np.uint64(32)).astype(np.int64) % WORDS
    out[:, TRIGRAMS:TERMS] = np.sqrt(np.bincount(place, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(counts, 1)[:, None])
    a = 0
    for i, (text, b) in enumerate(zip(texts, ends.tolist())):
        if not size[i]:
            continue
        lines = text.split(b"\n")
        k = max(1, b - a)
        pairs = word[a : b - 1] * np.uint64(3) + word[a + 1 : b] if b - a > 1 else word[a:b]
        out[i, TERMS:] = (
            1 - len(set(lines)) / len(lines),
            1 - len(np.unique(word[a:b])) / k,
            1 - len(np.unique(pairs)) / max(1, len(pairs)),
            min(1.0, size[i] / k / 20),
            min(1.0, np.log1p(k) / 10),
            min(1.0, k / len(lines) / 200),
            min(1.0, len(lines) / k),
            0.3,
        )
        a = b
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each feature
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, unit length
    label: np.ndarray
    share: np.ndarray  # how many labelled documents each of these stands for
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weight) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest labelled vectors."""
        if not len(self.label):
            return np.full(len(rows), self.prior)
        out = np.full(len(rows), self.prior)
        k = min(NEIGHBOURS, len(self.label))
        for a in range(0, len(rows), BLOCK):
            cosine = self.project(rows[a : a + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** SHARPNESS * self.share[near]
            total = vote.sum(axis=1)
            good = total > 1e-12
            out[a : a + BLOCK][good] = ((vote * self.label[near]).sum(axis=1) / np.where(good, total, 1))[good]
        return np.clip(out, 0.0, 1.0)


def fit(rows: np.ndarray, label: np.ndarray, share: np.ndarray, seen: np.ndarray, documents: int) -> Model:
    """seen: how many of all documents have each feature."""
    prior = float((label * share).sum() / share.sum()) if len(label) else 0.5
    if not len(label):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), label, share, prior)
    weight = np.where(seen > 0, np.log((1 + documents) / (1 + seen)) + 0.5, 0.0).astype(np.float32)
    weight[TERMS:] = 1.0
    basis = _leading((rows * weight).astype(np.float64), min(DIMENSIONS, len(rows))).astype(np.float32)
    model = Model(weight, basis, np.zeros((0, 1), np.float32), label.astype(np.float32), share.astype(np.float32), prior)
    model.vectors = model.project(rows).astype(np.float32)
    return model


def _leading(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors of x, by subspace iteration from a fixed start."""
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], k + 8)))[0]
    for _ in range(12):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :k]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature stands, over all documents, and their number. A row a
    feature comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(WIDTH + 1, np.int64)
            for a, b, rows in _rows(batch, 0):
                seen += np.append((rows > 0).sum(axis=0), b - a)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(seen)], names=["feature", "n"])

    got = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(WIDTH + 1, np.int64)
    for r in got:
        out[r.feature] = r.n
    return out[:-1], int(out[-1])


def _rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = batch.column(at).fill_null("").to_pylist()
    for a, b in tokens.slices(texts, 250_000):
        yield a, b, features([t.encode("utf-8", "surrogatepass") for t in texts[a:b]])


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Learns from at most per_label labelled rows
    for each of the labels 0 and 1, none of them held out; weights are counted over all docs.
    Only the labelled rows' features and the weights, of fixed width, come to the driver."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    picked = None
    for label in sorted(counts):
        some = usable.where(F.col("quality") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(per_label)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return fit(np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(0), np.zeros(WIDTH), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in _rows(batch, 0):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (1, 2)), pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())], names=["doc_id", "quality", "row"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("quality", T.LongType()), T.StructField("row", T.BinaryType())])
    picked = picked.select("doc_id", F.col("quality").cast("long").alias("quality"))
    got = docs.join(F.broadcast(picked), "doc_id").select("text", "doc_id", "quality").mapInArrow(run, schema).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    label = np.array([r.quality for r in got], np.float64)
    rows = np.stack([np.frombuffer(r.row, np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, WIDTH), np.float32)
    share = np.array([counts[r.quality] for r in got], np.float64)
    for value in set(label.tolist()):
        share[label == value] /= (label == value).sum()
    return fit(rows, label, share, *document_frequencies(docs))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds each text's score, 0 to 1, to the rows of docs, all columns kept; ``into`` must not
    be among them. A null text counts as empty, and an empty one is judged by its own features;
    a text unlike any labelled text gets the labels' mean."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in _rows(batch, at):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shipped.value.scores(rows))], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score and predicted (1 if score >=
    threshold). Scores come from the text alone. A null doc_id is not held out. Without usable
    labels every score is 0.5; an empty table gives no rows; other columns are left out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
