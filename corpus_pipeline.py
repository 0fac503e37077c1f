"""The corpus pipeline: quality, near copies, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's
documents, the last one the packed pieces. ``run`` applies them to the table ``documents``, each result
written to the shared folder and read again.
"""

from __future__ import annotations

from ledgermesh.llm import packing, quality, simhash, suffix_dedup
from ledgermesh.llm.common import free_name, materialize, numbered, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it learns from labels that are not held out.

    Null texts count as empty; repeated rows and rows without an id are scored each; other columns keep their
    names and values; an empty table gives no rows; without labels of both kinds all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    names = (free_name("score", docs.columns), free_name("predicted", docs.columns))
    return quality.score(docs, model, names).where(F.col(names[1]) == 1).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat a doc_id, or have none (these come first), are documents of their own: of rows that
    repeat each other one is left, and rows that share only the doc_id stay. Null texts count as empty; other
    columns keep their names and values; an empty table gives no rows.
    """
    number = free_name("number", docs.columns)
    rows = numbered(docs, number)
    groups = simhash.similar_groups(rows.select(F.col(number).alias("doc_id"), "text"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages of 100 bytes or more that stood earlier cut from their texts.

    A row for each input row: of rows that repeat a text the first keeps it, whether they share a doc_id or
    have none. Null texts become empty; other columns keep their names and values, but for n_chars; an empty
    table gives no rows.
    """
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; rows without an id or that repeat one are documents of their own."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Learning, fingerprints, suffix arrays and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
