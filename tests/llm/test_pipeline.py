import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tierlake import session
from tierlake.llm import catalog, mixing, pii, quality_classifier
from llm_tools import ASCII_LOWER, ODD, words
from test_near_dedup import brute, sets_of
from test_packing import check as check_packing


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *catalog.QUERIES} <= names
    assert [n.split("_")[0] for n in sorted(catalog.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert {"op4_url_rules", "op8_mixing", "op11_collocations", "op12_manifest"} <= set(entry.oracle_sql())


def test_stages(spark, sf, documents, tmp_path):
    docs, labels = documents, spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label")
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == documents.columns
    scored = quality_classifier.score_documents(documents, labels)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept[1]) == ids(scored.where("score >= 0.3"))
    # One document of each group, by brute force.
    groups = brute([tuple(r) for r in kept[1].select("doc_id", "text").collect()])
    assert ids(kept[2]) == {d for d, _, _, keep in groups if keep}
    # Personal data is gone, and the rest of the texts is as it was.
    assert ids(kept[3]) == ids(kept[2])
    assert sum(len(r.base) for r in pii.find(kept[2]).collect()) > 0
    assert sum(len(r.base) for r in pii.find(kept[3]).collect()) == 0
    # The mix takes as many words as the operator says.
    total = lambda df: df.agg(F.sum(mixing.words(F.col("text")))).first()[0]
    assert total(kept[4]) == mixing.mix(kept[3]).agg(F.sum("taken")).first()[0]
    check_packing(kept[4])
    whole = pipeline.run(spark, sf)
    assert Counter(tuple(r)[:5] for r in whole.collect())[None] == 0 and whole.count() == docs.count()


def test_scratch_goes(spark, sf, tmp_path):
    """What a stage worked with is removed when the next one begins, and written documents once they have been used."""
    pipeline.run(spark, sf).count()
    left = f"{session.shared_dir(spark)}/tierlake/{spark.sparkContext.applicationId}"
    before = set(os.listdir(left))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert set(os.listdir(left)) <= before
    pipeline.run(spark, sf).count()
    assert len(set(os.listdir(left)) - before) == 1


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, sf, odd, empty, stage):
    out = pipeline.STAGES[stage][1](spark, odd, sf)
    rows = out.collect()
    assert stage == 4 or out.columns == odd.columns
    if stage == 1:
        assert Counter((r.doc_id, r.text) for r in rows) == _kept_of_odd()
    if stage == 2:
        assert len(rows) == len(ODD)
    assert pipeline.STAGES[stage][1](spark, empty, sf).count() == 0


def _kept_of_odd():
    """The kept rows by brute force, of equal rows one; equal means the same id and words, or, without words, the same text."""
    sets = sets_of([(d, t) for d, t, *_ in ODD])
    kept, first = brute([(d, t) for d, t, *_ in ODD]), {}
    for k, (d, t, *_) in enumerate(ODD):
        group = [c for i, n, c, keep in kept if i == d and n == len(sets[k]) and keep]
        if group:
            first.setdefault((d, " ".join(words(t)).translate(ASCII_LOWER) or (t or "")), (d, t))
    return Counter(first.values())
