"""The training-data operators on small tables with nulls, empty and odd texts, ties, repeated
rows and clashing columns, against plain versions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keyloom.llm import block_names, curriculum, html_text, line_dedup, media, near_dup, packing, page_blocks, progressive, quality, sanitise, token_store, words

SCHEMA = "doc_id long, text string, source string, score double, node long"
TEXTS = [None, "", " ", "one", "A b\tc", "a  b c", "Á" * 40 + "\x80" * 3, "x y " * 3000, "long line " * 9 + "\nshort\n" + "long line " * 9, "ab" * 5000, "a\x1cb c", "mail a.b@c.de now", "line one is quite long enough to count here\n" * 3, "a  <|endoftext|> b <|startoftext|>c<|EndOfText|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("s0", "s1", None)[i % 3], 0.5, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "s0", 0.1, 1), (3, "one", "s0", 0.5, 1), (3, "one", "s0", 0.5, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(spark, docs, none):
    got = block_names.exact_groups(docs, block_bytes=8).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = [(i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert block_names.exact_groups(none).count() == 0


def test_exact_groups_of_long_texts_beside_columns_of_the_same_names(spark):
    long = "".join(random.Random(1).choices("abc \n", k=300_000))
    texts = [long, long.replace(" ", "\t"), long + "x", long[:-1] + "y", None]
    names = ("version", "n_blocks", "body", "name", "keep_id", "kept", "group_size", "text_sha256", "at", "left")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({n: F.lit(7) for n in names})
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in block_names.exact_groups(rows).collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 1, True), 3: (3, 1, True), 4: (4, 1, True)}


def test_exact_groups_when_hashes_collide(docs):
    weak = lambda b: (F.octet_length(b) % 2, F.lit(0))
    a, b = (sorted(map(str, block_names.exact_groups(docs, block_bytes=8, **h).collect())) for h in ({}, {"hashes": weak}))
    assert a == b


def _jaccard_components(rows, size):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if top(j) == top(i)) for i in range(len(rows))}


def test_near_groups(spark, docs, none):
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base + [None, "", "one", "One"])]
    for i in range(60):
        w = r.choice(base).split()
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == _jaccard_components(rows, 2)
    assert near_dup.near_groups(docs, 2).count() == docs.count()
    assert near_dup.near_groups(none, 2).count() == 0


def test_near_links_left_to_the_last_round(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    base, rows = [word() for _ in range(60)], []
    for _ in range(12):
        w = [r.choice((x, x, x, word())) for x in base]
        for _ in range(5):
            rows.append((len(rows), " ".join(w)))
            w[r.randrange(60)] = word()
    monkeypatch.setattr(near_dup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "band_hashes", lambda table, bands, rows: np.zeros((len(table), bands), np.uint64))
    got = {x.doc_id: x.component_id for x in near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    want = _jaccard_components(rows, 2)
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_a_common_passage_brings_few_pairs_together(spark):
    r = random.Random(4)
    new = lambda n: [r.randrange(2**64) for _ in range(n)]
    passage = new(60)
    sets = [new(100)] + [passage + new(40) for _ in range(150)]
    sets += [sets[i][:-8] + new(8) for i in range(1, 11)]  # 92 of 108: linked with 1 to 10
    # The head is the node 0, which lacks the passage; the others are components of one.
    members = [(0, i, 100, 1, -1 if i == 0 else i) for i in range(len(sets))] + [(0, 999, 100, 1, -1)]
    texts = [(i, np.sort(np.array(s, np.uint64)).tobytes()) for i, s in [*enumerate(sets), (999, sets[0])]]
    seats = spark.createDataFrame(members, "band long, node long, n long, near long, comp long")
    pairs = near_dup._straggling_pairs(seats, spark.createDataFrame(texts, "node long, shingles binary"), 80)
    got = {(x.a, x.b) for x in pairs.collect()}
    linked = {(i, 150 + i) for i in range(1, 11)}
    assert linked <= got and len(got) < 2 * len(linked)


def test_sketch_share_follows_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = near_dup.sketches([words.mix(a), words.mix(b)], 2000)
    assert abs((x == y).mean() - 800 / 1200) < 0.05
    assert (near_dup.sketches([words.mix(a[:1])], 50) < np.iinfo(np.uint64).max).all()


def test_mix(spark, docs, none):
    got = curriculum.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    big = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 9 else None, 0.0, 1) for i in range(3000)], SCHEMA)
    rows = curriculum.mix(big).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r.source, [r.target, 0, r.source_size])
        t[1] += r.taken
    assert all(abs(taken - target) <= 7 for target, taken, _ in by.values())
    assert abs(sum(t[0] for t in by.values()) - sum(t[2] for t in by.values())) < 1e-6
    assert all(0 <= r.position <= 1 for r in rows if r.copies)
    ordered = curriculum.in_training_order(big)
    assert big.withColumns({"position": F.lit(1), "nth": F.lit(2), "Row": F.lit(3)}).transform(curriculum.in_training_order).columns == [*SCHEMA.replace(",", "").split()[::2], "position", "nth", "Row"]
    same = spark.createDataFrame([(None, f"w{i % 3} x", "s", 0.0, 1) for i in range(9)] + [(7, "a b c", "t", 0.0, 1)] * 8, SCHEMA)
    want = sum(r.copies for r in curriculum.mix(same).collect())
    assert curriculum.in_training_order(same).count() == want and curriculum.in_training_order(none).count() == 0
    assert ordered.count() == sum(r.copies for r in rows) and ordered.columns == big.columns
    assert curriculum.mix(none).count() == 0


def test_base_spans_equal_the_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(text):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    r = random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice("ab19@.+-() 25") for _ in range(r.randrange(70)))
        assert sanitise.base_spans(text) == plain(text), text


def test_disclosing_terms(spark, none):
    rows = [(i, "Write to Zebulon at zeb@mail.org today") for i in range(5)] + [(10 + i, f"plain words number {i} and today") for i in range(200)] + [(900, None)]
    got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:9:16" in got[0].spans and got[0].base_spans == "email:20:32" and "Zebulon" not in got[0].clean_text and "<EMAIL>" in got[0].clean_text
    assert got[10].spans == "" and got[900].clean_text == "" and len(got) == len(rows)
    assert sanitise.sanitise(none).count() == 0


def test_terms_of_a_value_that_stands_once(spark):
    rows = [(0, "Write to Zebulon at zeb@mail.org today"), (1, "Reach Quillon via q@mail.org today"), (2, "Reach Quillon via q@mail.org today")]
    rows += [(10 + i, f"plain words number {i} write reach via and today") for i in range(200)]
    got = {r.doc_id: r.spans for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "term:9:16,email:20:32" and got[1] == got[2] == "term:6:13,email:18:28"
    assert all(got[10 + i] == "" for i in range(200))


def test_terms_far_from_the_value_and_without_it(spark):
    far = "Zebulon came. " + "plain words and today " * 30
    rows = [(i, far + "zeb@mail.org") for i in range(5)] + [(5, "Only Zebulon here today"), (6, None)]
    rows += [(10 + i, f"plain words came and today only here mail org number {i}") for i in range(400)]
    for most in (sanitise.BROADCAST_TERMS, 0):  # by broadcast, by joins
        got = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_terms=most).collect()}
        assert all(got[i].spans == f"term:0:7,email:{len(far)}:{len(far) + 12}" for i in range(5))
        assert got[5].spans == "term:5:12" and got[5].clean_text == "Only  here today"
        assert len(got) == len(rows) and all(got[10 + i].spans == "" for i in range(400))


def _whole(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = dict(enumerate(_whole(path, TEXTS, 0)))
    got = packing.pack(docs, path, longest=64).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for i, ids in want.items():
        mine = sorted({(r.start, bytes(r.ids), r.ids_crc32, r.length) for r in got if r.doc_id == i})
        assert np.frombuffer(b"".join(x[1] for x in mine), "<u4").tolist() == ids
        assert all(zlib.crc32(b) == c and n & (n - 1) == 0 and n <= 64 for _, b, c, n in mine)
    assert packing.pack(none, path).count() == 0


def test_sequences_follow_the_input_order(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 7919 % 500, "w " * (i % 9), "s", 0.0, 1) for i in range(500)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    order = {(r.doc_id): n for n, r in enumerate(sorted(read.select("doc_id", "_metadata.file_path", "_metadata.row_index").collect(), key=lambda r: (r.file_path, r.row_index)))}
    got = packing.pack(read, path, longest=8, in_file_order=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    got.sort(key=lambda r: r.sequence_id)
    assert [r.length for r in got] == sorted((r.length for r in got), reverse=True)
    for length in (1, 2, 4, 8):
        mine = [(order[r.doc_id], r.start) for r in got if r.length == length]
        assert mine == sorted(mine) and len(mine) > 9


def test_token_store(spark, docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, str(tmp_path / "s"), path)
    rows = docs.collect()
    ids = _whole(path, [r.text for r in rows], 1)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    got = token_store.verify(spark, str(tmp_path / "s")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]  # a null doc_id comes first
    assert order == sorted(order)
    whole = sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in token_store.read(spark, str(tmp_path / "s")).collect())
    assert whole == sorted((-1 if r.doc_id is None else r.doc_id, x) for r, x in zip(rows, ids))
    token_store.write(none, str(tmp_path / "e"), path)
    assert token_store.verify(spark, str(tmp_path / "e")).count() == 0


def test_equal_documents_give_equal_chunks_anywhere():
    r = np.random.default_rng(5)
    doc = r.integers(0, 49000, 3000)
    cuts = lambda before: [e - len(before) for e in token_store.chunk_ends(np.concatenate([before, doc]), np.array([len(before), len(before) + 3000]) if len(before) else np.array([3000])) if e > len(before)]
    assert cuts(doc[:0]) == cuts(doc[:7]) == cuts(r.integers(0, 49000, 500)) and len(cuts(doc[:0])) > 3
    flat = token_store.chunk_ends(np.zeros(10_000, np.int64), np.array([1, 10_000]))
    assert np.diff(flat, prepend=0).max() <= token_store.LONGEST


def test_token_store_finds_what_was_changed(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")

    def changed(name, table, change):
        token_store.write(docs, f"{tmp_path}/{name}", path)
        old = spark.read.parquet(f"{tmp_path}/{name}/{table}")
        change(old).write.parquet(f"{tmp_path}/{name}/new")
        (tmp_path / name / table).rename(tmp_path / name / "old")
        (tmp_path / name / "new").rename(tmp_path / name / table)
        with pytest.raises(Exception, match="match|lack|part|missing"):
            token_store.verify(spark, f"{tmp_path}/{name}").collect()

    other = F.lit(b"0123456789abcdef")
    changed("root", "manifest", lambda t: t.withColumn("root", F.when(F.col("part") == 0, other).otherwise(F.col("root"))))
    changed("few", "manifest", lambda t: t.where("part < 0"))
    changed("lost", "recipes", lambda t: t.where("doc_id != 5"))
    changed("gone", "recipes", lambda t: t.where("part != 0"))
    changed("digest", "recipes", lambda t: t.withColumn("digests", F.transform("digests", lambda d: F.when(F.col("doc_id") == 5, other).otherwise(d))))
    changed("chunk", "entries", lambda t: t.withColumn("ids", F.when(F.col("kind") == "chunk", F.substring("ids", 1, 2)).otherwise(F.col("ids"))))


def test_line_dedup(spark, docs, none):
    r = random.Random(4)
    base = ["".join(r.choice("abc") for _ in range(r.randrange(9, 30))) for _ in range(30)]
    lines = base + [(lambda s, p: s[:p] + r.choice(("", "a", "bc")) + s[p + 1 :])(x := r.choice(base), r.randrange(len(x))) for _ in range(70)]
    rows = [(i // 4, "\n".join(lines[i : i + 4])) for i in range(0, 100, 4)]

    def far(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for edits in (1, 2):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=9, edits=edits).collect()}
        seen = []
        for i, t in rows:
            left = []
            for line in t.split("\n"):
                if len(line) < 9 or not any(len(s) >= 9 and far(s, line) <= edits for s in seen):
                    left.append(line)
                seen.append(line)
            assert got[i] == "\n".join(left)
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_short_lines(spark):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a == b or (len(a) > 1 and len(b) - len(a) <= 1 and (a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]))

    r = random.Random(5)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(14))) for _ in range(300)]
    lines += r.choices(lines, k=60) + [x[:k] + r.choice(("", "i", "jj")) + x[k + 1 :] for x in r.choices(lines, k=60) for k in [r.randrange(1 + len(x))]]
    rows = [(i, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []
    for i, t in rows:
        left = []
        for line in t.split("\n"):
            if not line.strip() or not any(near(line, s) for s in seen):
                left.append(line)
            seen += [line] if line.strip() else []
        assert got[i].text == "\n".join(left) and got[i].n_dropped == t.count("\n") + 1 - len(left)


def test_large_group_of_near_lines(spark):
    """Copies of one line with an edit each, and lines that share its first half alone."""
    r = random.Random(6)
    base = "".join(r.choice("abcdefgh ") for _ in range(48))
    near = [base[:k] + c + base[k + 1 :] for k in range(48) for c in "XYZ"]
    half = [base[:24] + "".join(r.choice("abcdefgh ") for _ in range(24)) for _ in range(150)]
    half += [h[:40] + "Q" + h[41:] for h in half[::5]]
    lines = [base, *r.sample(near, len(near)), *half]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    late = {i for i, x in enumerate(lines) if any(len(x) == len(y) and sum(a != b for a, b in zip(x, y)) <= 1 for y in lines[:i])}
    assert len(late) > 150 and all(got[i] == ("" if i in late else x) for i, x in enumerate(lines))


def test_quality(spark, docs, none):
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("aeiost") for _ in range(r.randrange(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(r.choice("AEIOST") for _ in range(5)) + "!!$$" for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good(), "s", 0.0, 1) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.classify(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 5 > 0) for r in got if r.held_out]) > 0.97
    assert all(0 <= x.score <= 1 for x in quality.classify(docs, labels).collect())
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_progressive_round_trip():
    g = np.random.default_rng(0)
    odd = [bytes(64), bytes([128] * 640), bytes([128] * 200 + [129] + [127] * 3 + [128] * 52), g.integers(0, 256, 6400).astype(np.uint8).tobytes(), g.choice([128, 129, 140], 6400, p=[0.9, 0.03, 0.07]).astype(np.uint8).tobytes()]
    files = media.store(odd)
    assert [raw for raw, _ in media.read(files)] == odd
    flat, tensor = media.read(media.store([bytes([129] + [128] * 63) + bytes([128] * 64 * 5)]))[0]
    assert tensor[0].shape == (16, 16, 3) and progressive.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_media_columns(docs, none):
    for r in media.media_columns(docs).collect():
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.tensors[0].rgb) == r.tensors[0].height * r.tensors[0].width * 3
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            held = raw + bytes(-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
    assert media.media_columns(none).count() == 0


def test_main_text(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home.</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies, many.</div><article><h1>The  title</h1><p><b>First &amp; one<br><p>Second para, with words. And more.</p><div class=ad>Buy now!</div></article><section class="comments"><p>Nice post. Thanks!</p></section><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "no markup < at all"), (1, "u", page), (4, "u", "<p>" * 3000)]
    got = html_text.summary(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got if r.page_id == 1] == ["The title\n\nFirst & one\n\nSecond para, with words. And more."] * 2
    assert len(got) == len(rows) and all(r.text == "" for r in got if r.page_id in (2, 3))
    assert html_text.main_text(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0


def _all_blocks(html):
    page = page_blocks.parse(html)
    return page_blocks.blocks_of_text(page, np.ones(len(page.kind), bool))


def test_nothing_of_a_page_is_lost():
    assert _all_blocks("<p>A</p><svg-icon></svg-icon><p>B</p><button-group>c</button-group><select-box>d</select-box>") == ["A", "B", "cd"]
    assert _all_blocks("<p>A</p><button>x<p>B</p>") == ["A", "x", "B"]  # without an end tag it hides nothing
    assert _all_blocks("<p>A</p><button>x</button><p>B</p>") == ["A", "B"]
    assert _all_blocks("<div><button>x<p>y</p></div><p>z</p><button>k</button>") == ["z"]  # its parent ends it
    assert _all_blocks("<div>A<svg><title>t</title><text>no</text></svg> tail</div>") == ["A tail"]
    assert _all_blocks("a<script>x</p>") == ["a"]


def test_pages_of_many_open_tags_take_linear_time():
    for html in ("<ul>" * 50_000, "<div>" * 50_000 + "<li></li>" * 20_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<p><b>" * 50_000, "<button>" * 50_000 + "</button>x", "<td><div>" * 50_000):
        start = time.process_time()
        page = page_blocks.parse(html)
        page_blocks.features([page])
        assert time.process_time() - start < 2


def test_decoding_equals_the_best_of_all_choices():
    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(1, 9)
        parent = np.array([-1] + [r.randrange(i) for i in range(1, n)])
        margin = np.array([r.uniform(-2, 2) for _ in range(n)])
        best = max(
            (sum(margin[i] for i in range(1, n) if keep >> i & 1), keep)
            for keep in range(1 << n)
            if keep & 1 and all(not keep >> i & 1 or keep >> int(parent[i]) & 1 for i in range(1, n))
        )
        kept = page_blocks.decode(margin, parent)
        assert kept[0] and abs(sum(margin[1:][kept[1:]]) - best[0]) < 1e-9
        assert all(not kept[i] or kept[parent[i]] for i in range(1, n))


def test_pages_with_attribute_words_never_learnt():
    teacher, trees = page_blocks.Teacher(77), html_text.model()
    for rename in (lambda x: x, lambda x: re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="{m[2][::-1]}"', x)):
        right = wrong = missed = 0
        for _ in range(60):
            page = teacher.page()
            want = sum(len(x) for x in _all_blocks(page) if "@" in x)
            got = [x for x in html_text.extract([rename(page)], trees)[0].split("\n\n") if x]
            mine = sum(len(x) for x in got if "@" in x)
            right, wrong, missed = right + mine, wrong + sum(map(len, got)) - mine, missed + want - mine
        assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.98


def test_disclosing_terms_equal_plain_information(spark):
    """Every (term, entity) pair by the formula itself."""
    r = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(300):
        text = r.choices(vocabulary, [1 / (1 + k) for k in range(len(vocabulary))], k=r.randrange(3, 25))
        if r.random() < 0.2:
            text.insert(r.randrange(len(text)), f"{r.choice(vocabulary)}@x{r.randrange(12)}.org")
        rows.append((i, " ".join(text)))
    holds, entities = {}, {}
    for i, t in rows:
        for w in sanitise._terms(t):
            holds.setdefault(w, set()).add(i)
        for s in sanitise.base_spans(t):
            entities.setdefault(sanitise._value(t, *s), set()).add(i)
    n, s = len(rows), sanitise.SMOOTH
    bad = set()
    for w, a in holds.items():
        for b in entities.values():
            gain = np.log2(n * (len(a & b) + s) / ((len(a) + s) * (len(b) + s)))
            if a & b and gain > 0 and gain >= sanitise.SHARE * np.log2(n / (len(b) + s)):
                bad.add(w)
    assert bad
    for x in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[x.doc_id][1]
        inside = [(a, b) for a, _, b in sanitise.base_spans(text)]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("[a-z]{3,}", text) if m[0] in bad and not any(m.start() < b and a < m.end() for a, b in inside)]
        assert [p for p in x.spans.split(",") if p.startswith("term")] == want


def test_votes_equal_plain_neighbours():
    g = np.random.default_rng(4)
    label = (g.random(90) < 0.6).astype(float)
    rows = np.abs(g.standard_normal((130, quality.WIDTH))).astype(np.float32)
    model = quality.fit(rows[:90], label, np.ones(90), (rows > 1).sum(0), 130)
    got = model.scores(rows)
    unit = lambda v: v / np.linalg.norm(v)
    space = [unit((x * model.weight) @ model.basis) for x in rows]
    for x, score in zip(space, got):
        cosine = np.array([x @ y for y in space[:90]])
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        assert abs(score - (vote * label[near]).sum() / vote.sum()) < 1e-3


def test_blank_texts_are_scored_by_themselves(spark):
    words = "alpha beta gamma delta eps zeta eta theta".split()
    rows = [(i, "" if i % 4 == 0 else " ".join(random.Random(i).choices(words, k=30)) + ".") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in quality.classify(docs, labels).collect())
