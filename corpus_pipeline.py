"""The corpus pipeline: stages of training-data operators, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents, the last adds its own beside them, under another name where documents has that name already.

A row is its doc_id together with its text: rows of one doc_id and different texts, and rows without a doc_id, are judged
one by one. Of rows that are equal in what a stage compares, one stays: the smallest doc_id (null last), then the smallest
hash of the text, then the first in the order of all columns. Null and empty texts go at the first stage, as do texts
without a letter; very long texts are read whole; an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import decontaminate, exact_dedup, language, mixing, simhash
from wayloom.llm.common import drop, new_path, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with a probability under 0.5 in the likeliest learned language, go.

    The probability is among the learned languages: a long text in none of them, or of random letters, mostly stays.
    Where no row has a language, none is learned and all documents stay.
    """
    return language.accepted(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays."""
    return exact_dedup.keepers(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of texts linked by a similarity of 0.8 or more of their five-word shingles one row stays."""
    return simhash.keepers(docs)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in training order; documents that it doesn't take are left out."""
    return mixing.in_order(docs, mixing.mix(docs))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean_of_tests), ("mix", mixed)]

#: Language ID, SimHash and the order by hashes aren't SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written for itself, and its input, are deleted when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
