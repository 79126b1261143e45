"""All registered queries of the reference's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import details, layouts, relations, retrieval, streams, texts

BOOKS = (texts.book, retrieval.book, relations.book, details.book, streams.book, layouts.book)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks of benchmark questions by BM25."""
    return retrieval.book.queries["bm25_benchmark_top8"](spark, folder)


def queries() -> dict:
    return {name: make for book in BOOKS for name, make in book.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
