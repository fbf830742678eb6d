"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every element of a document's shingle set falls into
a hashed coordinate with the value i + its hash; in round T + j all fall into coordinate j. Each
coordinate keeps its least value. So every coordinate fills within 2T rounds, few rounds do for
large sets, and the share of equal coordinates is concentrated about the Jaccard similarity.

Documents with equal shingle sets form one class. Classes that share a band of their sketches
are candidates. In a large bucket not all pairs are tried: its members are first held against
one leader, the one with most neighbours, by exact intersection of the full sets; links so found
make components; and only members that are still in different components meet in further rounds.
The last round is exact for them: each orders its shingles so that those which few leaders of
its bucket's largest component have come first, of these the rarest, and two members can be
similar enough only if they share one of the first few, at places that leave enough common
ones. What many members have in common so comes last and brings few of them together. So the
components are those of all candidate pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import shared, tokens, words

U = np.uint64
#: 40 bands of 5 coordinates: a pair at similarity 0.8 shares none with probability 1.3e-7, one
#: at 0.85 with 6e-11.
BANDS, ROWS = 40, 5
#: Leaders of a component by which shingles are ordered in the last round.
LEADERS = 3
#: Sizes of sets are compared in classes of this ratio.
SIZE_STEP = 1.05
#: Rounds with one leader a bucket go on while they link one in so many candidate classes.
LEADERS_GAIN, LEADER_ROUNDS = 50, 4


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each set; rows of empty sets are never filled."""
    n = len(sets)
    counts = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if n else np.zeros(0, U)
    owner = np.repeat(np.arange(n), counts)
    table = np.full(n * size, np.iinfo(U).max, U)
    for i in range(2 * size):
        if not len(element):
            break
        h = words.mix(element + words.keys(1, 100 + i))
        low = h & U(0xFFFFFFFF)
        place = ((h >> U(32)) * U(size) >> U(32)).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(table, owner * size + place, low | (U(i) << U(32)))
        open_rows = (table.reshape(n, size) == np.iinfo(U).max).any(axis=1)
        still = open_rows[owner]
        if not still.all():
            element, owner = element[still], owner[still]
    return table.reshape(n, size)


def band_hashes(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = table.reshape(len(table), bands, rows)
    h = np.broadcast_to(words.keys(bands, 7), (len(table), bands)).copy()
    for j in range(rows):
        h = words.mix(h * U(0x9E3779B97F4A7C15) + cut[:, :, j])
    return h


def _lowered(texts: list[str]) -> list[bytes]:
    """UTF-8 with A-Z in lower case; bytes.lower() changes no others."""
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts]


def sketched(docs: DataFrame, words_each: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs: doc_id, text. Adds n_shingles, set_key (16-byte digest of the set) and bands."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in tokens.slices(texts, 1_000_000):
                sets = words.shingle_sets(_lowered(texts[a:b]), words_each)
                table = band_hashes(sketches(sets, bands * rows), bands, rows).view(np.int64)
                filled = np.array([len(s) > 0 for s in sets])
                edges = np.concatenate([[0], np.cumsum(filled * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(table[filled].ravel())),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """node and its full sorted shingle set, for the classes in wanted (node, rep, set_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sought = batch.column(0).fill_null("").to_pylist(), batch.column(2).to_pylist()
            for a, b in tokens.slices(texts, 1_000_000):
                raw = [s.tobytes() for s in words.shingle_sets(_lowered(texts[a:b]), words_each)]
                right = [hashlib.blake2b(r, digest_size=16).digest() == k for r, k in zip(raw, sought[a:b])]
                mask = pa.array(right)
                out = pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(raw, pa.binary())], names=["node", "shingles"])
                yield out.filter(mask)

    rows = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.rep)).select("text", "node", "set_key")
    return rows.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            linked = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(x) + len(y)
                common = both - len(np.unique(np.concatenate([x, y])))
                linked.append(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _shared_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node and shared, those of its shingles that another of the nodes has too, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            shingle = np.concatenate([*own, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(shingle)], names=["node", "shingle"])

    each = nodes.join(sets, "node").select("node", "shingles").mapInArrow(run, "node long, shingle long")
    each = shared.keep(each, "node-shingles")
    often = shared.keep(each.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1"), "frequent-shingles")
    rows = each.join(often.hint("merge"), "shingle").select("node", "k", "shingle").repartition("node")
    return rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("l")).select("node", F.col("l.shingle").alias("shared"))


def _firsts(seats: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The first shingles of each node of seats (node, n, comp, head) and their places: those of
    no other node come first, then those that few of the head's leaders have, of these the
    rarest; so many that a node linked with this one has one of them. leaders: head, of_leaders
    (their sets). Adds shingle and place; shingles of no other node keep their places but get
    no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, places = [], []
            for n, x, y in zip(batch.column(1).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
                x = x.values.to_numpy()
                alone = n - len(x)
                known = sum(np.isin(x, np.frombuffer(of, np.int64), assume_unique=True).astype(np.int8) for of in y)
                taken.append(x[np.argsort(known, kind="stable")][: max(0, n + 1 + (-percent * n) // 100 - alone)])
                places.append(np.arange(alone, alone + len(taken[-1])))
            rows = pa.array(np.repeat(np.arange(len(taken)), [len(t) for t in taken]), pa.int64())
            shingle, place = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (taken, places))
            columns = [batch.column(i).take(rows) for i in range(4)] + [pa.array(shingle), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "comp", "head", "shingle", "place"])

    own = _shared_shingles(seats.select("node").distinct(), sets)
    rows = seats.join(own, "node").join(leaders, "head").select("node", "n", "comp", "head", "shared", "of_leaders")
    return rows.mapInArrow(run, "node long, n long, comp long, head long, shingle long, place long")


def _straggling_pairs(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a bucket and may be linked.

    All linked ones are among them. A bucket's head is the component that fills most of it; the
    leaders of a head are its nodes with most neighbours, one from each of ``LEADERS`` hashed
    parts. Under each key (head, shingle) the nodes of all components
    but its largest meet all nodes that are in other components and of a fitting size; pairs
    within a component never arise.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(LEADERS))
    leaders = open_members.groupBy(F.col("comp").alias("head"), part.alias("part")).agg(F.min(F.struct(-F.col("near"), "node")).alias("l")).select("head", F.col("l.node").alias("node"))
    heads = open_members.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("head"))
    seats = shared.keep(open_members.join(heads, "band").select("node", "n", "comp", "head").distinct(), "seats")
    leaders = leaders.join(seats.select("head").distinct(), "head").join(sets, "node").groupBy("head").agg(F.collect_list("shingles").alias("of_leaders"))
    firsts = shared.keep(_firsts(seats, leaders, sets, percent), "first-shingles")
    sizes = firsts.groupBy("head", "shingle", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("head", "shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    marked = shared.keep(firsts.join(mixed, ["head", "shingle"]), "mixed-shingles")

    def size_class(n):  # noqa: ANN001, ANN202
        return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(SIZE_STEP)))

    left = F.col("n") - F.col("place")
    largest = F.floor(((100 + percent) * left - percent * F.col("n")) / percent)
    reach = F.sequence(size_class(F.floor(F.col("n") * percent / 100)), size_class(largest))
    others = marked.where((F.col("comp") != F.col("most")) & (largest * 100 >= F.col("n") * percent))
    others = others.select("head", "shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), left.alias("left_a"), F.explode(reach).alias("class"))
    every = marked.select("head", "shingle", "most", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), left.alias("left_b"), size_class(F.col("n")).alias("class"))
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = others.join(every, ["head", "shingle", "class"]).where(((F.col("comp_b") == F.col("most")) | (F.col("comp_a") < F.col("comp_b"))) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node that edges (a, b) join it with, by alternating large and
    small stars. Each round is written; neighbours are never gathered, only their least."""

    def star(pairs: DataFrame, name: str) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return shared.keep(pairs.join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select("u", "m")).where("x != y").distinct(), name)

    now, seen = edges.select(F.col("a").alias("x"), F.col("b").alias("y")), None
    while True:
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select("y", "x"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = shared.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        now = star(large, "small-star")
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("x", "y")), F.lit(0))).first()
        if state == seen:
            return now.select(F.col("x").alias("node"), F.col("y").alias("comp"))
        seen = state


def near_groups(
    docs: DataFrame, words_each: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that
    links reach, itself included), kept (doc_id = component_id).

    A null or blank text has no shingles, is linked with nothing and is its own component. Rows
    that repeat a doc_id are all kept or all not. A null doc_id is reached but never the least,
    unless it is alone. An empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = shared.keep(sketched(docs, words_each, bands, rows), "sketches")
    classes = shared.keep(
        every.where("n_shingles > 0")
        .groupBy("set_key", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    member = classes.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    # Written before it is joined, as are leaders and mixed buckets below: so both sides of the
    # join have a shuffle of their own, and Spark can split the rows of a large bucket.
    crowded = shared.keep(member.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"), "crowded-bands")
    near = F.sum("k").over(Window.partitionBy("node"))  # neighbours, counted in each band
    member = shared.keep(member.join(crowded, "band").withColumn("near", near).drop("k"), "band-members")
    active = member.select("node").distinct()
    sets = shared.keep(_full_sets(docs, classes.join(active, "node").select("node", "rep", "set_key"), words_each), "full-sets")
    n_active = sets.count()

    fits = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    comp = None
    open_members = member.withColumn("comp", F.col("node"))
    for nth in range(LEADER_ROUNDS):
        order = F.xxhash64(F.lit(nth), "node") if nth else -F.col("near")
        leaders = open_members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "node", "n", "comp")).alias("l")).select("band", F.col("l.node").alias("a"), F.col("l.n").alias("n_b"), F.col("l.comp").alias("comp_b"))
        pairs = open_members.join(shared.keep(leaders, "leaders"), "band").where((F.col("comp") != F.col("comp_b")) & fits)
        pairs = pairs.select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()
        found = shared.keep(_verified(pairs, sets, percent), "links")
        edges = found if comp is None else comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found)
        comp = components(edges)
        open_members = member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = open_members.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
        open_members = shared.keep(open_members.join(shared.keep(mixed, "mixed-bands"), "band"), "open-members")
        if found.count() * LEADERS_GAIN < n_active:
            break
    last = shared.keep(_verified(_straggling_pairs(open_members, sets, percent), sets, percent), "links")
    if not last.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(last))

    labelled = classes.select("set_key", "node", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labelled = labelled.join(least, "comp").select("set_key", "component_id")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = every.select("doc_id", "n_shingles", "set_key").join(labelled, "set_key", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
