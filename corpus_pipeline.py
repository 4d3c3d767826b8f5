"""The corpus pipeline: quality filter, exact dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; run() writes each
stage's rows to the shared scratch folder and hands them, reread, to the next. All stages but the last
return the columns of docs, whatever their names. Rows without a doc_id pass through every stage, judged by their
text: as exact copies they count as one group with rows that have one, and go if such a row stays or if they repeat.
Null texts count as empty ones. Texts of any length are judged whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate as contamination
from pixelloom.llm import exact_dedup, near_dup, packing, quality
from pixelloom.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.filter(F.col(f"`{scored.columns[-1]}`") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.keep_first_rows(docs, exact_dedup.exact_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return near_dup.keep_one(docs, near_dup.near_duplicates(docs, 5, 80, 100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark (WINDOW words in a row, or a whole shorter item)."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a training sequence."""
    return packing.pack_documents(packing.token_counts(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_duplicates", near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
