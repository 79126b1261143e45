"""An inverted-file index of vectors: cells around trained centroids, searched a few cells a query.

Centroids are trained on a bounded sample (SAMPLE vectors, those of the smallest hashes of their keys); every vector of
the table goes into the cell of its nearest centroid and is written, sorted by cell, in the shared folder or
where the caller says. How many cells a query probes is measured on the sample: the fewest that find the share ``recall``
of the true neighbours. Rows that a reader may not see go before anything is ranked; a query that then finds
fewer than ``k`` rows in its cells is searched again in all cells, so nothing is lost to the filter.

Queries and rows meet by equality of cells, in blocks of at most BLOCK vectors, and each pair of blocks is one
matrix product. A cell of very many rows is many blocks in many tasks.

Defined cases: null vectors, and those of another width than most of the sample has, are left out; a zero vector is in
the index and scores 0; repeated rows are each found; ties go by key; an empty table gives an index without cells and no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.search import BLOCK, _pair_task
from tessella.session import scratch_path

#: Vectors that centroids and probes are fitted on, at most; cells, at most; sample queries that measure recall.
SAMPLE, CELLS, MEASURED = 20_000, 2_048, 256
RECALL = 0.95


def _units(vectors: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)


def clustered(units: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit length, by spherical k-means; cells that stay empty are left out."""
    distinct = np.unique(units, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:cells]
    centres = distinct[np.sort(pick)]
    for _ in range(rounds):
        home = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        centres = _units(sums[np.bincount(home, minlength=len(centres)) > 0])
    return centres


def probes_needed(units: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold the share ``recall`` of the k nearest sample vectors of sample queries."""
    asked = units[:: max(1, len(units) // MEASURED)][:MEASURED]
    home = (units @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    near = np.argsort(-(asked @ units.T), axis=1, kind="stable")[:, :k]
    visited = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(visited[max(0, math.ceil(recall * len(visited)) - 1)]) + 1


def _nearest(rows: DataFrame, shared, probes: int) -> DataFrame:
    """Add the nearest ``cells`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(batch.schema.get_field_index("vector")).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                cells = np.argsort(-np.round(_units(x) @ centres.T, 9), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _block_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell as blocks (cell, ids, unit vectors, width)."""
    for batch in batches:
        cells = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(start, stop, BLOCK):
                part = batch.slice(at, min(BLOCK, stop - at))
                if part.num_rows:
                    x = np.asarray(part.column(2).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([int(cells[at])], pa.int32()), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([_units(x).tobytes()]), pa.array([x.shape[1]], pa.int32())], names=["cell", "ids", "unit", "width"])


BLOCKS = "cell int, ids array<long>, unit binary, width int"


class VectorIndex:
    """A written index: ``rows`` (cell, id, vector and the caller's columns), ``centres``, and the probes that were measured."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most CELLS rows
        self.centres = np.array([r["centre"] for r in about]) if about else np.zeros((0, 1))
        self.probes = about[0]["probes"] if about else 0

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, table: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), k: int = 20, recall: float = RECALL, path: str | None = None) -> VectorIndex:
        """Train, assign and write. ``keep`` names columns that searches may filter by (not id, vector or cell)."""
        spark, path = table.sparkSession, path or scratch_path(table.sparkSession, "vector-index")
        source = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"), *keep)
        sample = [r["vector"] for r in source.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]
        widths = [len(v) for v in sample]
        width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
        units = _units(np.array([v for v in sample if len(v) == width], dtype=np.float64).reshape(-1, max(width, 1)))
        # So many that a query reads some cells of about as many rows as there are cells; more would not be trained well.
        cells = min(CELLS, max(1, math.isqrt(source.count())), max(1, len(units) // 8))
        centres = clustered(units, cells) if len(units) else np.zeros((0, 1))
        probes = probes_needed(units, centres, k, recall) if len(units) else 0
        about = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
        spark.createDataFrame(about, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/cells")
        shared = spark.sparkContext.broadcast(centres)
        fit = source.where(F.size("vector") == width)
        placed = _nearest(fit, shared, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows")
        return cls(spark, path)

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 20, allowed: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query, id, score, rank) of the k most similar rows that ``allowed`` (over the kept columns) lets pass."""
        asked = queries.where(F.size(vector) == (self.centres.shape[1] if len(self.centres) else -1)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        probes = min(probes or self.probes, len(self.centres))
        found = self._near(asked, k, allowed, probes)
        if 0 < probes < len(self.centres):
            counts = found.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("__n"))
            short = asked.join(counts, "id", "left").where(F.coalesce("__n", F.lit(0)) < k).drop("__n")
            if not short.isEmpty():
                again = self._near(short, k, allowed, len(self.centres))
                found = found.join(short.select(F.col("id").alias("query")).distinct(), "query", "left_anti").unionByName(again)
        return found

    def _near(self, asked: DataFrame, k: int, allowed: Column | None, probes: int) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(self.centres)
        sent = _nearest(asked, shared, probes).select(F.explode("cells").alias("cell"), "id", "vector")
        cells = [r["cell"] for r in sent.select("cell").distinct().collect()]  # at most CELLS
        rows = self.rows.where(F.col("cell").isin(cells))  # reaches the scan: other row groups are not read
        own = (rows.where(allowed) if allowed is not None else rows).select("cell", "id", "vector").mapInArrow(_block_task, BLOCKS)
        questions = sent.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("cell").mapInArrow(_block_task, BLOCKS)
        pairs = own.join(questions.select("cell", F.col("ids").alias("asked"), F.col("unit").alias("questions")), "cell")
        scored = pairs.select("ids", "unit", "width", "asked", "questions").mapInArrow(_pair_task(k), "query long, id long, score double")
        order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact (query, id) rows that are found. Rows are counted, never gathered."""
    hits = exact.select("query", "id").join(found.select("query", "id").withColumn("__hit", F.lit(1)), ["query", "id"], "left")
    return hits.agg(F.count_distinct("query").alias("queries"), (F.count("__hit") / F.count("*")).alias("recall"))
