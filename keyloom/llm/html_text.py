"""Main text of web pages by boosted trees over block features, decoded down the tree.

Every block of a page's tree gets the log-odds that main text is in it, from its subtree's
density, its attributes' words, its depth and its siblings. Of all choices in which no block is
kept under one that goes, the one with the greatest sum of log-odds is taken, so ancestors and
descendants never contradict each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import boosting, page_blocks, tokens

#: Invented pages that the trees learn from: the bound of all that is trained on.
LESSON_PAGES, SEED = 1200, 11


@lru_cache(maxsize=1)
def model(pages: int = LESSON_PAGES, seed: int = SEED) -> boosting.Trees:
    return boosting.fit(*page_blocks.Teacher(seed).lesson(pages), trees=60)


def extract(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page: its blocks joined by an empty line."""
    parsed = [page_blocks.parse(p) for p in pages]
    if not parsed:
        return []
    x, parent, ends = page_blocks.features(parsed)
    kept = page_blocks.decode(trees.margin(x), parent)
    out, a = [], 0
    for page, b in zip(parsed, ends.tolist()):
        out.append("\n\n".join(page_blocks.blocks_of_text(page, kept[a:b])))
        a = b
    return out


def main_text(pages: DataFrame, trees: boosting.Trees | None = None, html_col: str = "html", into: str = "text") -> DataFrame:
    """Adds the main text to the rows of pages, all columns kept but one already so named.

    A null or empty page has an empty text, as has one without main text. Repeated rows each
    get their text; an empty table gives no rows."""
    shipped = pages.sparkSession.sparkContext.broadcast(trees or model())  # 60 trees of 16 leaves
    pages = pages.drop(into) if into in pages.columns and into != html_col else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(at).fill_null("").to_pylist()
            for a, b in tokens.slices(html, 2_000_000):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(extract(html[a:b], shipped.value), pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)


def summary(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of the main text."""
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
