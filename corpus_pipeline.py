"""A training corpus from raw documents: drop low quality, repeated lines and near copies, mix
the sources to their targets, and pack the result.

Each stage takes (spark, docs, sf_dir), works on all documents it is given, and returns a frame
that is written as Parquet and read again as the next stage's documents. All but the last
return the columns of documents, whatever their names. A null text counts as empty; rows that
repeat a doc_id or have none are documents of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import curriculum, line_dedup, near_dup, packing, quality, shared

THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without labels to judge by all stay."""
    model = quality.train(docs, shared.table(spark, sf_dir, "labels"))
    if not len(model.label):
        return docs
    score = shared.fresh(docs, "score")
    return quality.score(docs, model, into=score).where(F.col(score) >= THRESHOLD).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no text is left. n_chars follows the text.
    Documents that lose no line stay as they are, null and blank texts too."""
    dropped = shared.fresh(docs, "n_dropped")
    out = line_dedup.dedup_lines(docs, n_lines=None, n_dropped=dropped)
    out = out.where((F.col(dropped) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        chars = F.when(F.col(dropped) == 0, F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.
    Blank texts are linked with nothing and stay; rows that repeat the doc_id that stays do too."""
    stays = shared.fresh(docs, "stays")
    kept = near_dup.near_groups(docs, words_each=5, percent=80).where("kept").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept[stays]), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. A null source is one of
    its own; documents without words are never taken."""
    return curriculum.in_training_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and sequences, numbered in training order
    within each length. docs must be read straight from Parquet, as ``run`` does."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=1024, end_id=0, in_file_order=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again. What a stage needed
    on its way is removed once its result is written, and the result once the next has read it."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with shared.passing(spark) as stays:
            docs = shared.keep(stage(spark, docs, sf_dir), f"stage-{name}")
            stays.append(shared.last_kept())
        if before:
            shared.remove(spark, before)
        before = stays[0]
    return STAGES[-1][1](spark, docs, sf_dir)
