"""The corpus pipeline: documents through five stages to packed training windows.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; between stages
the documents are a Parquet table in the shared folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm import decontaminate, line_dedup, packing, quality_model, simhash
from fleetmetrics.llm.common import free_names, ship, stored, table

#: No stage after the first can be told in SQL without the scores of a trained model.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least one half)."""
    ship(spark)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "score")
    return quality_model.score(docs, model, into=score).where(F.col(score) >= 0.5).select(*_own(docs))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated lines, alone or in runs. One that loses all its words that way goes; one
    that had none to begin with stays. ``n_chars`` follows a changed text."""
    ship(spark)
    (removed,) = free_names(docs, "n_removed")
    cut = line_dedup.dedup_lines(docs, min_words=1, removed=removed)
    left = cut.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*_own(docs))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: three-word shingles, two bits."""
    ship(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 of its five-word shingles)."""
    ship(spark)
    (hits,) = free_names(docs, "hits")
    return decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), into=hits).where(F.size(hits) == 0).select(*_own(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in windows of 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
