"""Media columns: bytes held in progressive JPEG frames, and their full-resolution tensors.

Each 64 bytes of a payload are the coefficients of one block, in zigzag order and less 128, so
the entropy-coded scans keep them without loss. Reading accumulates the scans, spectral band by
band and bit by bit, into coefficient arrays; the inverse transform, chroma upsampling and
colour conversion in whole numbers give RGB tensors that agree on any machine.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import progressive, shared

#: Payload bytes that are coded together in a task.
BATCH_BYTES = 1 << 20


def payload(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _groups(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about so many bytes, at least one item each."""
    start = size = 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(items):
        yield start, len(items)


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: its frames, one JPEG file after another."""
    frames, owner = [], []
    for i, p in enumerate(payloads):
        for a in range(0, len(p), progressive.FRAME_BYTES):
            frames.append(p[a : a + progressive.FRAME_BYTES])
            owner.append(i)
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _groups(frames, BATCH_BYTES):
        for i, f in zip(owner[a:b], progressive.encode(frames[a:b])):
            out[i].append(f)
    return [b"".join(x) for x in out]


#: Where one frame of this coder ends and the next begins; it stands nowhere inside a frame.
_SEAM = b"\xff\xd9\xff\xd8\xff\xfe"


def _frames(file: bytes) -> list[bytes]:
    cut = file.split(_SEAM)
    return [(_SEAM[2:] if i else b"") + x + (_SEAM[:2] if i < len(cut) - 1 else b"") for i, x in enumerate(cut)]


def read(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """(payload, RGB tensor of each frame) of each stored form."""
    cut = [_frames(f) for f in files]
    frames = [x for own in cut for x in own]
    raw, tensors = [], []
    for a, b in _groups(frames, BATCH_BYTES):
        coef, parsed = progressive.decode(frames[a:b])
        for (f,) in parsed:
            raw.append((coef[f.first : f.first + f.n_bytes // 64] + 128).astype(np.uint8).tobytes())
            tensors.append(progressive.rgb(coef, f))
    ends = np.cumsum([len(own) for own in cut]).tolist()
    return [(b"".join(raw[a:b]), tensors[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def feature(tensors: list[np.ndarray]) -> str:
    """Frames, sum of each colour over all pixels, and a CRC-32 of the tensors."""
    sums = sum(t.reshape(len(t), -1).sum(0, dtype=np.int64).reshape(-1, 3).sum(0) for t in tensors)
    crc = 0
    for t in tensors:
        crc = zlib.crc32(np.ascontiguousarray(t), crc)
    h, w, _ = tensors[0].shape
    return f"{len(tensors)}x{h}x{w}:{sums[0]}:{sums[1]}:{sums[2]}:{crc}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes and media, the text's bytes as JPEG frames.

    A null or empty text is a payload of 64 zero bytes. Null and repeated doc_ids are rows like
    any other; an empty table gives no rows; other columns are left out.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            held = [payload(t) for t in texts]
            for a, b in _groups(held, BATCH_BYTES):
                n = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(store(held[a:b]), pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def read_back(media: DataFrame, with_media: bool = True) -> DataFrame:
    """The rows of ``stored`` with what the stored bytes hold: payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, and tensors (each frame's pixels as height,
    width and RGB bytes); without ``with_media`` all but media and tensors."""
    tensor = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])
    text, long = T.StringType(), T.LongType()
    fields = [("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)]
    fields += [("media", T.BinaryType()), ("tensors", T.ArrayType(tensor))] if with_media else []
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(*f) for f in fields)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            for a, b in _groups(files, BATCH_BYTES):
                rows = []
                for file, (raw, tensors) in zip(files[a:b], read(files[a:b])):
                    rows.append([len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(tensors)])
                    if with_media:
                        rows[-1] += [file, [{"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()} for t in tensors]]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1)), *columns], names=schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_columns(docs: DataFrame, with_media: bool = True, **cols: str) -> DataFrame:
    """The media columns of docs, written to the shared folder, and what they hold when read
    back; see ``stored`` and ``read_back``."""
    return read_back(shared.keep(stored(docs, **cols), "media", compression="zstd"), with_media)
