"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Two lines within ``edits`` edits of each other share, if one is cut into edits + 1 segments, at
least one whole segment, which lies in the other at most so far displaced as the edits and the
difference in length allow. So each line is filed under the hashes of its own segments, and
under those of its substrings that a segment of a shorter line could be. Lines that meet agree
but for the rest of the line, and the rests are again within the edits: so where many lines
meet under a key they are filed again by the segments of their rests, and so on. Pairs that
still meet are verified by a banded bit-parallel edit distance of the whole lines.

Lines are ordered by (doc_id, place in the document). A line goes if an equal line, or one
within the edits, has an earlier place. Equal lines are found at any length, near ones from
``min_chars`` on, which by default is all that are longer than the edits. Blank lines stay.

In a large group each line is first held against the earliest alone. If that shows all others
to be late, the group is done; else its lines, the late ones too, go on to the segments of
their rests. All pairs are tried in groups of ``FEW`` lines, and of those lines that differ in
their last few characters only. So the work grows with the lines, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import shared

EDITS = 1
#: Lines of fewer characters are compared for equality alone: any two of them are within the edits.
MIN_CHARS = EDITS + 1
#: Keys and lines are found again by a broadcast of their hashes up to this number (8 bytes
#: each), by a shuffle beyond.
BROADCAST_LINES = 500_000
#: In groups of so many lines all pairs are tried.
FEW = 8


def _segment(length: Column, nth: int, parts: int) -> tuple[Column, Column]:
    """1-based start and length of segment nth (from 0) of a line: all as long as the division
    allows, the longer ones last."""
    base, more = F.floor(length / parts), length % parts
    long_before = F.greatest(F.lit(0), more - (parts - nth))
    return base * nth + long_before + 1, base + F.when(F.lit(nth) >= parts - more, 1).otherwise(0)


def _variants(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, number of its segment, how far displaced), those of
    a line's own segments first."""
    parts = edits + 1
    own = [(0, i, 0) for i in range(parts)]
    others = [(s, i, m) for s in range(parts) for i in range(parts) for m in range(max(-i, s - (edits - i)), min(i, s + (edits - i)) + 1)]
    return own + [v for v in others if v not in own]


def _cut(text: Column, n: Column, variant: tuple[int, int, int], edits: int) -> tuple[Column, Column, Column]:
    """Whether a text of n characters has the variant's segment, the segment, and the rest."""
    shorter, nth, moved = variant
    start, size = _segment(n - shorter, nth, edits + 1)
    start = start + moved
    inside = (start >= 1) & (start + size - 1 <= n)
    return inside, F.substring(text, start, size), F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start + size, n))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), then)[0]


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether arrays of characters, each longer than ``edits``, are within so many edits.

    Column by column of the distance matrix, only the 2 * edits + 1 rows about the diagonal are
    held, as two integers of up and down steps. The distance is followed along the lowest
    diagonal of the band, and once that leaves the matrix, along the last row.
    """
    band = (1 << (2 * edits + 1)) - 1
    top = 2 * edits
    m, n = F.size(a), F.size(b)

    def step(state: Column, j: Column) -> Column:
        def bit(k: int) -> Column:
            row = j - edits + k  # 1-based row of bit k in column j
            same = (row >= 1) & (row <= m) & F.coalesce(F.get(a, row - 1) == F.get(b, j - 1), F.lit(False))
            return F.when(same, F.lit(1 << k)).otherwise(0)

        equal = bit(0)
        for k in range(1, top + 1):
            equal = equal.bitwiseOR(bit(k))

        def moved(x: Column) -> Column:
            up, down = state["up"], state["down"]
            d = ((x.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(x).bitwiseOR(down).bitwiseAND(F.lit(band))
            return _let(d, lambda d: _let(F.struct(d.alias("d"), down.bitwiseOR(F.lit(band).bitwiseXOR(d.bitwiseOR(up).bitwiseAND(F.lit(band)))).alias("right"), d.bitwiseAND(up).alias("left")), after))

        def after(s: Column) -> Column:
            d, right, left = s["d"], s["right"], s["left"]
            shifted = F.shiftright(d, 1)
            at = F.call_function("shiftleft", F.lit(1), (m - j + edits).cast("int"))
            below = F.when(d.bitwiseAND(F.lit(1 << top)) == 0, 1).otherwise(0)
            beside = F.when(right.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(left.bitwiseAND(at) != 0, 1).otherwise(0)
            return F.struct(
                left.bitwiseOR(F.lit(band).bitwiseXOR(shifted.bitwiseOR(right).bitwiseAND(F.lit(band)))).alias("up"),
                shifted.bitwiseAND(right).alias("down"),
                (state["far"] + F.when(j <= m - edits, below).otherwise(beside)).alias("far"),
            )

        return _let(equal, moved)

    first = F.struct(F.lit(band & ~((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("far"))
    far = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["far"])
    return F.when(F.abs(m - n) > edits, False).otherwise(far <= edits)


def hashed_lines(docs: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """doc_id, version, at, h1, h2, keys: all lines but blank ones. Two 64-bit hashes stand for a
    line's content; version tells rows with one doc_id and different texts apart; keys has a
    hash for each variant, null where the line has none, and is null for lines that are too
    short."""
    rows = _split(docs).withColumn("n", F.char_length("line"))
    keys = []
    for nth, variant in enumerate(_variants(edits)):
        inside, piece, _ = _cut(F.col("line"), F.col("n"), variant, edits)
        keys.append(F.when(inside, F.xxhash64(F.col("n") - variant[0], F.lit(variant[1]), piece)))
    return rows.select("doc_id", "version", "at", "h1", "h2", F.when(F.col("n") >= min_chars, F.array(*keys)).alias("keys"))


def _split(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(F.col("text"), "\n")).alias("at", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _small(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_LINES else hashes


def _meeting(docs: DataFrame, lines: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """key, h1, h2, first, line, rest, owns: the lines under each key that different lines share
    and at least one owns."""
    keyed = lines.where("keys IS NOT NULL").select("h1", F.posexplode("keys").alias("variant", "key")).where("key IS NOT NULL")
    owns = F.col("variant") <= edits
    shared_keys = keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.max(owns.cast("int")).alias("owned")).where("x < y AND owned = 1").select("key")
    shared_keys = _small(shared.keep(shared_keys, "shared-keys"))
    members = shared.keep(keyed.join(shared_keys, "key").distinct(), "key-members")
    wanted = _small(shared.keep(members.select("h1").distinct(), "lines-wanted"))
    content = _split(docs).join(wanted, "h1").select("h1", "h2", "line").dropDuplicates(["h1", "h2"])
    content = shared.keep(content.join(firsts, ["h1", "h2"]), "line-contents")
    met, n = members.join(content, "h1"), F.char_length("line")
    rest = F.coalesce(*(F.when(F.col("variant") == k, _cut(F.col("line"), n, v, edits)[2]) for k, v in enumerate(_variants(edits))))
    return met.select("key", "h1", "h2", "first", "line", rest.alias("rest"), owns.alias("owns"))


def _again(met: DataFrame, edits: int) -> DataFrame:
    """The lines of met, filed once more within their key by the segments of their rests."""
    n = F.char_length("rest")
    each = []
    for nth, variant in enumerate(_variants(edits)):
        inside, piece, rest = _cut(F.col("rest"), n, variant, edits)
        key = F.xxhash64("key", n - variant[0], F.lit(variant[1]), piece)
        each.append(F.when(inside & (n - variant[0] >= F.col("least")), F.struct(key.alias("key"), rest.alias("rest"), F.lit(nth <= edits).alias("owns"))))
    filed = met.select("h1", "h2", "first", "line", F.explode(F.array_compact(F.array(*each))).alias("k"))
    return filed.select("k.key", "h1", "h2", "first", "line", "k.rest", "k.owns")


def late_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """h1, h2 of the lines that are within the edits of a line with an earlier place."""

    def within(a: str, b: str) -> Column:
        return _let(F.split(a, ""), lambda x: _let(F.split(b, ""), lambda y: within_edits(x, y, edits)))

    def near(a: str, b: str, rest_a: str, rest_b: str) -> Column:
        # Lines are no nearer than their rests, which are shorter; the shortest tell nothing.
        short = F.least(F.char_length(rest_a), F.char_length(rest_b)) <= edits
        return (short | within(rest_a, rest_b)) & within(a, b)

    met = _meeting(docs, lines, firsts, edits)
    found, level = [], 0
    while True:
        met = shared.keep(met, "met-lines")
        groups = met.groupBy("key").agg(
            F.count("*").alias("k"), F.min(F.char_length("rest")).alias("least"), F.max("owns").alias("owned"), F.min("h1").alias("x"), F.max("h1").alias("y"), F.min(F.struct("first", "line", "rest")).alias("lead")
        )
        groups = shared.keep(groups.where("x < y AND owned").drop("owned", "x", "y"), "line-groups")
        met = met.drop("owns").join(groups, "key")
        done = F.col("least") <= edits  # no segments are left
        few = (F.col("k") <= FEW) & (done | F.lit(level > 0))
        # Half a line in common says little: the first groups go on to their rests.
        late = F.when(done | F.lit(level > 0), (F.col("first") > F.col("lead.first")) & near("lead.line", "line", "lead.rest", "rest")).otherwise(False)
        judged = shared.keep(met.where(~few).withColumn("late", late).drop("lead", "k"), "judged-lines")
        found.append(judged.where("late").select("h1", "h2"))
        # The earliest line is never late here: where another is not, the group goes on.
        left = judged.groupBy("key").agg(F.count_if(~F.col("late")).alias("left")).where("left > 1").select("key")
        judged = judged.join(left, "key")
        columns = ["key", "h1", "h2", "first", "line", "rest", "late"]
        tried = met.where(few).withColumn("late", F.lit(False)).select(*columns).union(judged.where(done).select(*columns))
        x = tried.select("key", F.col("first").alias("first_x"), F.col("line").alias("line_x"), F.col("rest").alias("rest_x"))
        y = tried.where("NOT late").select("key", "h1", "h2", F.col("first").alias("first_y"), F.col("line").alias("line_y"), F.col("rest").alias("rest_y"))
        pairs = x.join(y, "key").where((F.col("first_x") < F.col("first_y")) & near("line_x", "line_y", "rest_x", "rest_y"))
        found.append(shared.keep(pairs.select("h1", "h2").distinct(), "late-lines"))
        met = judged.where(~done)
        if met.isEmpty():
            break
        met, level = _again(met, edits), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = "n_lines", n_dropped: str | None = "n_dropped"
) -> DataFrame:
    """The rows of docs, all columns kept, with the text less its repeated lines, and two more
    columns: the number of lines before, and of those dropped, under the names given and in
    place of any columns so named; None leaves one out.

    A null text stays null with one line, an empty one. A null doc_id comes before all others.
    Rows that repeat doc_id and text lose the same lines. An empty table gives no rows.
    """
    if min_chars <= edits:
        raise ValueError("min_chars must be above edits")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = shared.keep(hashed_lines(named, min_chars, edits), "hashed-lines")
    firsts = shared.keep(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at", "version")).alias("first")), "first-lines")
    late = shared.keep(late_lines(named, lines, firsts, edits), "late-lines")
    stay = firsts.join(late, ["h1", "h2"], "left_anti").groupBy("first.doc_id", "first.version").agg(F.collect_list("first.at").alias("ats"))
    of, version, ats = (shared.fresh(docs, c) for c in ("of", "version", "ats"))
    stay = stay.select(F.col("doc_id").alias(of), F.col("version").alias(version), F.col("ats").alias(ats))
    joined = docs.join(stay, docs[id_col].eqNullSafe(stay[of]) & (F.xxhash64(docs[text_col]) == stay[version]), "left")

    def left(each: Column) -> Column:
        blank = F.filter(F.transform(each, lambda line, at: F.when(~line.rlike(r"[^\x20\x09-\x0D]"), at)), lambda at: at.isNotNull())
        places = F.sort_array(F.concat(blank, F.coalesce(stay[ats], F.array().cast("array<int>"))))
        return F.struct(F.size(each).cast("long").alias("n"), F.transform(places, lambda at: F.get(each, at)).alias("lines"))

    kept = shared.fresh(docs, "kept")
    out = joined.select(*(docs[c] for c in docs.columns), _let(F.split(F.coalesce(docs[text_col], F.lit("")), "\n"), left).alias(kept))
    text = F.when(F.col(text_col).isNotNull(), F.array_join(F.col(f"{kept}.lines"), "\n"))
    counts = ((n_lines, F.col(f"{kept}.n")), (n_dropped, F.col(f"{kept}.n") - F.size(f"{kept}.lines")))
    same = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c == text_col or c not in (n_lines, n_dropped)]
    return out.select(*same, *(count.cast("long").alias(name) for name, count in counts if name))
