"""Personal data: patterns, and terms that disclose the values the patterns find.

Base spans are e-mail and IP addresses, payment-card and telephone numbers. Their values are
the protected entities. Over the whole corpus it is counted in how many documents each term
stands, in how many each entity, and in how many both. A term's pointwise mutual information
with an entity, log2(N n(t, e) / (n(t) n(e))), is held against the entity's information,
log2(N / n(e)), with ``SMOOTH`` added to each count: if it gives away at least ``SHARE`` of
that, the term discloses the entity and is removed wherever it stands, in all documents. No
number of documents is asked for, so values that stand once are judged too; n(t) makes common
words fail. Base values are generalised to their kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import shared, tokens, words

KINDS = ("email", "ip", "card", "phone")
SHARE, SMOOTH = 0.9, 0.5

#: Up to so many disclosing terms (8 bytes each) are sent to the workers; beyond, documents meet
#: theirs in joins.
BROADCAST_TERMS = 500_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match may start at the first digit of a run only: it would have started there before.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGITS = re.compile("[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the local part runs back to the previous match or the first other character."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _luhn(digits: str) -> bool:
    even = sum(map(int, digits[-1::-2]))
    odd = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (even + odd) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _terms(text: str) -> list[str]:
    return sorted({w.lower() for w in set(_TERM.findall(text))})


def _value(text: str, start: int, kind: int, end: int) -> str:
    """An entity: its kind and its value in one spelling."""
    raw = text[start:end]
    return f"{kind}:{raw.lower() if kind < 2 else _NOT_DIGITS.sub('', raw)}"


def _hash(strings: list[str]) -> np.ndarray:
    """One 64-bit hash for each string, as words.word_hashes gives it to a word."""
    return np.array([words.word_hashes([s.encode("utf-8", "surrogatepass")])[0][0] for s in strings], np.uint64).view(np.int64) if strings else np.zeros(0, np.int64)


def found_spans(docs: DataFrame) -> DataFrame:
    """docs: text. Returns, of documents with base spans, their distinct terms and entities as
    64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, entities = [], []
            for text in batch.column(0).fill_null("").to_pylist():
                if spans := base_spans(text):
                    terms.append(_term_hashes([text])[0])
                    entities.append(_hash(sorted({_value(text, *s) for s in spans})))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in (terms, entities)], names=["terms", "entities"])

    return docs.select("text").mapInArrow(run, "terms array<long>, entities array<long>")


def _term_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's distinct terms."""
    # Each document's terms once, as words of one byte string.
    found, ends = words.word_hashes(["\n".join(_terms(t)).encode("utf-8", "surrogatepass") for t in texts])
    return np.split(found.view(np.int64), ends[:-1])


def term_counts(docs: DataFrame) -> DataFrame:
    """term (hash) and n, the number of documents that hold it, summed up within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).fill_null("").to_pylist()
            for a, b in tokens.slices(texts, 4_000_000):
                term, n = np.unique(np.concatenate(_term_hashes(texts[a:b])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame, share: float = SHARE) -> DataFrame:
    """The terms that give away at least ``share`` of some entity's information.

    A term gives away enough if (n + s) / (both + s) <= (N / (n(e) + s)) ** (1 - share). As both
    is at most n(e), no term passes with n + s above ``most`` = (n(e) + s) ** share *
    N ** (1 - share): such terms are not paired with the entity at all.
    """
    total = docs.agg(F.count("*").alias("total"))
    found = shared.keep(found.withColumn("row", F.monotonically_increasing_id()), "entity-rows")
    each = found.select("row", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.count("*").alias("of_entity")).join(F.broadcast(total))  # one row
    # A little above, against rounding; the exact test follows.
    most = F.pow(F.col("of_entity") + SMOOTH, F.lit(share)) * F.pow("total", F.lit(1 - share)) * (1 + 1e-9)
    each = each.join(entities.withColumn("most", most), "entity")
    bounds = each.groupBy("row").agg(F.max("most").alias("row_most"))
    terms = found.select("row", F.explode("terms").alias("term")).join(term_counts(docs), "term")
    rare = terms.join(bounds, "row").where(F.col("n") + SMOOTH <= F.col("row_most"))
    pairs = rare.join(each, "row").where(F.col("n") + SMOOTH <= F.col("most"))
    pairs = pairs.groupBy("term", "entity").agg(F.count("*").alias("both"), *(F.first(c).alias(c) for c in ("n", "of_entity", "total")))
    n, both, of_entity = (F.col(c) + SMOOTH for c in ("n", "both", "of_entity"))
    gain = F.log2(F.col("total") * both / (n * of_entity))
    return pairs.where((gain >= share * F.log2(F.col("total") / of_entity)) & (gain > 0)).select("term").distinct()


def _marked(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """doc_id, text and, of documents with disclosing terms, these. Documents are known by a
    hash of their text: texts that share it get the terms of both, which changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a, b in tokens.slices(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_term_hashes(texts[a:b]), pa.list_(pa.int64()))], names=["key", "terms"])

    held = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, terms array<long>")
    hits = held.select("key", F.explode("terms").alias("term")).join(bad, "term").groupBy("key").agg(F.collect_set("term").alias("bad"))
    hits = shared.keep(hits, "disclosed")
    return docs.withColumn("key", F.xxhash64("text")).join(hits, "key", "left").select("doc_id", "text", "bad")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """One row for each row of docs: doc_id, base_spans and spans (text, kind:start:end each, by
    start and kind, comma-joined; added spans are of kind term), n_email, n_ip, n_card, n_phone
    and clean_text, in which base values stand as <KIND> and disclosing terms are left out.

    A null or empty text has no spans and an empty clean text. Rows that repeat a doc_id count
    as documents of their own. An empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bad = shared.keep(disclosing(docs, found_spans(docs), share), "disclosing")
    everywhere = None
    if bad.count() <= broadcast_terms:
        everywhere = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term for r in bad.collect()], np.int64)))
        marked = docs.withColumn("bad", F.lit(None).cast("array<long>"))
    else:
        marked = _marked(docs, bad)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
            *(T.StructField(c, T.StringType()) for c in ("base_spans", "spans", "clean_text")),
        ]
    )
    names = (*KINDS, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, terms = batch.column(1).fill_null("").to_pylist(), batch.column(2).to_pylist()
            if everywhere is not None:
                terms = []
                for a, b in tokens.slices(texts, 4_000_000):
                    each = _term_hashes(texts[a:b])
                    hit = np.isin(np.concatenate(each), everywhere.value)
                    terms += [t[h].tolist() for t, h in zip(each, np.split(hit, np.cumsum([len(t) for t in each])[:-1]))]
            rows = []
            for text, wanted in zip(texts, terms):
                spans = base_spans(text)
                every = set(spans)
                if wanted:
                    hashes = set(wanted)
                    wanted = {w for w, h in zip(_terms(text), _term_hashes([text])[0].tolist()) if h in hashes}
                    for m in _TERM.finditer(text):
                        if m[0].lower() in wanted and not any(m.start() < b and a < m.end() for a, _, b in spans):
                            every.add((m.start(), 4, m.end()))
                said = [",".join(f"{names[k]}:{a}:{b}" for a, k, b in x) for x in (spans, sorted(every))]
                clean, at = [], 0
                for a, k, b in sorted(every):
                    if a >= at:
                        clean += [text[at:a], f"<{names[k].upper()}>" if k < 4 else ""]
                    at = max(at, b)
                rows.append([*(sum(k == kind for _, k, _ in spans) for kind in range(4)), *said, "".join(clean) + text[at:]])
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=schema.names)

    return marked.mapInArrow(run, schema)
