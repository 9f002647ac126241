"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontam, jaccard, lines, packing, quality
from glyphmill.llm.shared import release, tables_made, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these and their labels, rejects go.

    Null and empty texts are scored, too; repeated rows stay or go together; without
    labels of training folds every score is .5 and all stay.
    """
    return quality.good(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents have stay in the largest doc_id only; no document goes.

    Null texts stay null; rows with one doc_id are one document.
    """
    return lines.rewritten(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; five words, 0.8 (see ``jaccard``).

    Null, empty and blank texts are linked with nothing and stay; of repeated rows one stays.
    """
    return jaccard.first_of_each(docs, w=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go; texts without a word stay."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; null texts are empty, repeated rows documents of their own."""
    return packing.digest(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the classifier or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents; a stage's intermediate tables go when its result is written."""
    docs, since = _table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
