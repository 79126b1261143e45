"""Exact cosine search of many queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; blocks of the corpus and of the queries meet pair by pair.
BLOCK = 1024


def _blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows as blocks (ids, unit vectors as bytes, dimension), cut within the partitions as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part.column(1).to_pylist()])
                n = np.linalg.norm(x, axis=1, keepdims=True)
                unit = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()]), pa.array([x.shape[1]], pa.int32())], names=["ids", "unit", "width"])

    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "ids array<long>, unit binary, width int")


def _pair_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, unit, width, asked, questions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, query_ids = np.array(ids, dtype=np.int64), np.array(asked, dtype=np.int64)
                scores = np.frombuffer(questions).reshape(-1, width) @ np.frombuffer(unit).reshape(-1, width).T
                best = np.lexsort((np.broadcast_to(own, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, best.shape[1])), pa.array(own[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query", "id", "score"])

    return run


def cosine_topk(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 8, block: int = BLOCK) -> DataFrame:
    """(query, id, score, rank) of the k most similar rows; a zero vector scores 0, ties go by id.

    Every block of the corpus meets every block of the queries as one matrix product, and k rows
    a query leave a pair. Nothing passes through the driver; Spark broadcasts the query blocks
    only if its own size check allows it.
    """
    asked = _blocks(queries, key, vector, block).select(F.col("ids").alias("asked"), F.col("unit").alias("questions"))
    pairs = _blocks(corpus, key, vector, block).join(asked, F.lit(True))
    found = pairs.select("ids", "unit", "width", "asked", "questions").mapInArrow(_pair_task(k), "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def or_first(chunks: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """(query, id, score) of the k best of ``scored``; a question without any gets its first k ``chunks`` (query, id) with score 0."""
    best = scored.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("__r") <= k).drop("__r")
    rest = chunks.join(scored.select("query").distinct(), "query", "left_anti").withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("id")))
    return best.unionByName(rest.where(F.col("__r") <= k).select("query", "id", F.lit(0.0).alias("score")))


def merged(sources: list[DataFrame], k: int) -> DataFrame:
    """(query, id, score, rank) of the k best over several retrievals; what more than one finds counts once, at its best."""
    every = sources[0]
    for more in sources[1:]:
        every = every.unionByName(more)
    once = every.groupBy("query", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
