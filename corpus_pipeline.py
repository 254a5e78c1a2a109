"""The corpus pipeline: stages over ``documents``, each written and reread.

``run`` applies STAGES in order. Every stage takes (spark, docs, sf_dir), works
on all rows its predecessor kept and returns the columns of ``docs``; the last
one returns the packed pieces instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, line_templates, near_dedup, packing, toxicity
from strata.llm.store import materialize, unused
from strata.sources.readers import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts score the bias alone; an empty table stays empty. The same text gets the same score, so rows that repeat an id with the same
    text stay or go together.
    """
    model = toxicity.fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, documents stay: null texts as null, an empty table as it is."""
    return line_templates.drop_recurring_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id.

    Rows that repeat an id are one document: one of them stays.
    """
    own = unused("decided_id", docs)
    decided = materialize(near_dedup.near_duplicates(docs), "decided")
    gone = decided.filter("not kept").select(F.col("doc_id").alias(own))
    kept = docs.join(gone.distinct(), docs["doc_id"] == F.col(own), "left_anti")
    repeated = decided.groupBy(F.col("doc_id").alias(own)).count().filter(F.col("count") > 1).filter(F.col(own).isNotNull()).select(own)
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    many = kept.join(repeated, kept["doc_id"] == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, kept["doc_id"] == F.col(own), "left_anti").unionByName(many)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences.

    A null or empty text is its end mark alone; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashes of tokens and MinHash candidates have no DuckDB twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
