import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import search
from tessella.operators.vector_index import VectorIndex, recall


def near(rows, asked, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    return {q: [i for _, i in sorted((-round(float(unit(u) @ unit(v)), 9), i) for i, v in rows)[:k]] for q, u in asked}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    homes = draw.normal(size=(25, 16))
    return [(k, [float(np.float32(x)) for x in homes[k % 25] + draw.normal(scale=0.3, size=16)], int(k % 25 == 3)) for k in range(3000)]


def test_clustered_vectors_need_few_cells(spark, rows):
    table = spark.createDataFrame(rows, "key long, v array<double>, rare int")
    index = VectorIndex.build(table, "key", "v", ("rare",))
    assert index.probes < len(index.centres) / 3 and index.rows.count() == 3000
    asked = table.where("key % 100 = 0")
    assert recall(index.search(asked, "key", "v"), search.cosine_topk(table, asked, "key", "v", k=20)).first()["recall"] >= 0.9
    every = index.search(asked, "key", "v", probes=len(index.centres)).collect()
    due = near([(k, v) for k, v, _ in rows], [(k, v) for k, v, _ in rows if k % 100 == 0], 20)
    assert {q: [i for _, i in sorted((r["rank"], r.id) for r in every if r.query == q)] for q in due} == due
    assert len(VectorIndex(spark, index.path).centres) == len(index.centres)


def test_a_filter_that_leaves_far_rows_only_loses_none(spark, rows):
    table = spark.createDataFrame(rows, "key long, v array<double>, rare int")
    index = VectorIndex.build(table, "key", "v", ("rare",))
    found = index.search(table.where("key in (0, 1)"), "key", "v", 20, F.col("rare") == 1, probes=1).collect()
    due = near([(k, v) for k, v, rare in rows if rare], [(k, v) for k, v, _ in rows if k in (0, 1)], 20)
    assert {q: [i for _, i in sorted((r["rank"], r.id) for r in found if r.query == q)] for q in due} == due


def test_odd_tables(spark):
    same = [(k, [1.0, 0.0]) for k in range(40)]
    table = spark.createDataFrame([*same, (40, None), (41, [0.0, 0.0]), (42, [1.0]), (0, [1.0, 0.0])], "key long, v array<double>")
    index = VectorIndex.build(table, "key", "v")
    assert index.rows.count() == 42
    found = index.search(table.where("key = 7"), "key", "v", 3).collect()
    assert sorted((r["rank"], r.id) for r in found) == [(1, 0), (2, 0), (3, 1)]
    none = VectorIndex.build(table.limit(0), "key", "v")
    assert none.search(table, "key", "v").collect() == []
