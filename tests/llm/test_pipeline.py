"""The pipeline's stages on rows with nulls, repeats and clashing columns, and the chain."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import curriculum, quality

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    names = "score stays of version ats kept n_lines n_dropped row position nth".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.union(docs.where("doc_id < 5")).union(docs.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    path = str(tmp_path_factory.mktemp("docs") / "d")
    docs.withColumns({n: F.lit(99) for n in names}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "mixing"])
def test_stages_keep_the_columns(spark, clashing, name):
    for docs in (clashing, clashing.limit(0)):
        out = STAGES[name](spark, docs, SF)
        assert out.columns == clashing.columns
        assert all(r.n_lines == r.row == 99 for r in out.collect())


def test_without_labels_all_documents_stay(spark, clashing, monkeypatch):
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda docs, labels: train(docs, labels.limit(0)))
    assert STAGES["quality"](spark, clashing, SF).count() == clashing.count()


def test_mixing_takes_what_the_mix_says(spark, clashing):
    want = sum(r.copies for r in curriculum.mix(clashing).collect())
    assert STAGES["mixing"](spark, clashing, SF).count() == want


def test_the_chain(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sorted(r.sequence_id for r in got) == list(range(len(got)))
    whole = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.offset == 0
        whole.setdefault((r.doc_id, r.start), r)
    for doc in {r.doc_id for r in got}:
        mine = sorted((s, r) for (d, s), r in whole.items() if d == doc)
        ids = np.frombuffer(b"".join(bytes(r.ids) for _, r in mine), "<u4")
        assert len(ids) == mine[0][1].doc_tokens and ids[-1] == 0
