"""From raw documents to packed training sequences: five stages, each an operator of `tierlake.llm`.

Every stage works on all rows that the one before it kept. Between stages the documents are written below the
session's shared folder and read again, which cuts the lineage and survives lost executors. When a stage begins, its
documents have been written, so what the stage before it worked with is removed then; of the written documents only those
that the next stage reads are kept.

Nulls, empty texts, repeated rows, empty tables and extra columns: each stage treats them as its operator says, extra
columns are carried to the packing, and rows without a doc_id stay unless a copy with an id does.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import mixing, near_dedup, packing, pii, quality_classifier
from tierlake.session import recorded, remove_path, scratch_path

#: Documents that score below this go.
LEAST_SCORE = 0.3
#: Stands for a missing id where rows are joined by id.
NO_ID = -(1 << 63)


#: Scratch of the stage that ran last.
_left: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it worked with; its `docs` are read from files."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _left:
            remove_path(spark, path)
        _left.clear()
        with recorded() as made:
            try:
                return work(spark, docs, sf_dir)
            finally:
                _left.extend(made)

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_classifier.train(docs, labels.where(~quality_classifier.in_fold(F.col("doc_id"), 0, 5)))
    return docs.where(quality_classifier.score(model, F.col("text")) >= LEAST_SCORE)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; of repeated rows one.

    Documents are alike by the contract of op10: a Jaccard similarity of at least 0.8 of their sets of four words.
    """
    keys = F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), F.coalesce("content", F.lit(b"")).alias("_content")
    kept = near_dedup.near_duplicates(docs).where("kept").select(*keys).distinct()
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    keyed = keyed.withColumn("_content", F.coalesce(near_dedup.content(F.col("text")), F.lit(b"")))
    # Texts without words are alike to nothing: of them only repeated rows are one.
    apart = F.when(F.col("_content") == F.lit(b""), F.coalesce("text", F.lit("")))
    one = keyed.join(kept, ["_key", "_content"], "left_semi").withColumn("_apart", apart)
    return one.dropDuplicates(["_key", "_content", "_apart"]).select(*docs.columns)


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each personal identifier in its place."""
    found = pii.find(docs, keep=tuple(docs.columns))
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it takes them."""
    mixed = mixing.mixed_documents(docs, stored=bool(docs.inputFiles()))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the contexts of personal data and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, work in STAGES[:-1]:
        found = work(spark, docs, sf_dir)
        path = scratch_path(spark, name.replace(" ", "-"))
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
