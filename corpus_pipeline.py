"""From raw documents to packed sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the documents of the next. All but the last return the columns of documents.

Defined cases: a document with a null or empty text fails the base rule and goes in the first stage;
rows with a null doc_id pass the second and third stage as they are; repeated rows of a document
become one in the second; an empty table gives empty tables; further columns pass through until the
last stage, which returns pieces. Each stage judges its own input only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import jaccard, packing, quality, substrings
from tessella.llm.registry import tokenizer_path
from tessella.session import materialise, ship_package, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a calibrated one go."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at 0.75 or more, the one of the smallest doc_id stays."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    ship_package(spark)
    return substrings.remove(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", sequences),
]

#: Word hashing, components and tokenisation have no SQL; tests/llm holds a brute-force pipeline against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
