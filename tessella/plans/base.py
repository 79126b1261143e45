"""How queries are registered: a DataFrame and, where SQL can express it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import table


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def files(self) -> DataFrame:
        """Documents as uploaded files: filename, project, owner and flags come from other columns."""
        name = F.concat(F.lit("file"), F.col("doc_id"), F.lit("."), F.element_at(F.array(*map(F.lit, ("pdf", "txt", "docx", "xlsx", "csv", "png"))), (F.col("doc_id") % 6 + 1).cast("int")))
        flags = self.labels.select("doc_id", F.col("quality").alias("selected"), F.col("toxic").alias("starred"))
        return self.documents.join(flags, "doc_id", "left").select("doc_id", name.alias("filename"), F.col("lang").alias("project"), F.col("source").alias("owner"), "text", F.coalesce("selected", F.lit(1)).alias("selected"), F.coalesce("starred", F.lit(0)).alias("starred"))


#: The same in SQL, for use as a common table expression.
FILES = """files AS (SELECT d.doc_id, 'file' || d.doc_id || '.' || (['pdf','txt','docx','xlsx','csv','png'])[1 + d.doc_id % 6] AS filename, lang AS project, source AS owner, text,
 coalesce(quality, 1) AS selected, coalesce(toxic, 0) AS starred FROM documents d LEFT JOIN labels USING (doc_id))"""


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(make: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: make(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return make

        return keep
