import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import kernel

from . import cases


def stats(text):
    """The statistics of one text, plainly."""
    raw = text or ""
    w = cases.WORD.findall(raw)
    n, chars = len(w), len(raw)
    lines = [tuple(x) for x in map(cases.WORD.findall, raw.split("\n")) if x]
    three = [tuple(w[i : i + 3]) for i in range(n - 2)]
    count = lambda test: sum(1 for c in raw if test(c))
    share = lambda a, b: min(a / max(b, 1), 4.0) ** 0.5
    letters = count(lambda c: c.isascii() and c.isalpha())
    return [
        np.log1p(chars), np.log1p(n), np.log1p(chars / max(n, 1)), np.log1p(max((len(x.encode()) for x in w), default=0)), share(count(lambda c: c.isascii() and c.isupper()), letters),
        share(count(lambda c: not c.isascii()), chars), share(count(lambda c: c in "0123456789"), chars), share(count(lambda c: c in ".,"), n), share(count(lambda c: c in "!?;:"), n),
        share(count(lambda c: c in "#$%&*+/<=>@\\^_`{}~[]"), n), share(raw.count("|"), n), share(n - len(set(w)), n), share(sum(three.count(x) > 1 for x in three), n),
        share(sum(a == b for a, b in zip(w, w[1:])), n), np.log1p(n / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines)), share(sum(len(x) == 1 for x in lines), len(lines)),
    ]


def test_statistics_equal_plain_ones():
    texts = ["", None, "a", "a b a b a b", "x\nx\n\ny z\n x ", "É! É? ||| #$ 12,5.", "A\x0bb\rc\n\n", *[t for _, t in cases.corpus() if t and len(t) < 2500][:40]]
    for rows in (texts, texts[::-1], [texts[5]]):
        got = kernel.statistics(pa.array(rows, pa.string())) / kernel.UNIT
        assert np.allclose(got, [stats(t) for t in rows], atol=2 / kernel.UNIT)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    bins, n = np.arange(60), rng.integers(1, 9, 60)
    good = rng.binomial(n, np.clip(bins / 60 + rng.normal(0, 0.2, 60), 0, 1))
    centres, shares = kernel.isotonic(bins, n, good)
    assert (np.diff(shares) > 0).all() and (np.diff(centres) > 0).all()
    # Max-min formula of isotonic regression.
    g, c = np.concatenate([[0], np.cumsum(good)]), np.concatenate([[0], np.cumsum(n)])
    exact = [max(min((g[k] - g[j]) / (c[k] - c[j]) for k in range(i + 1, 61)) for j in range(i + 1)) for i in range(60)]
    assert np.allclose(sorted(set(np.round(exact, 12))), shares)


def test_equations_are_those_of_all_rows_whatever_the_layout(spark):
    rng = random.Random(5)
    rows = [(k, cases.prose(rng, rng.randrange(1, 60))) for k in range(120)]
    labels = [(k, k % 3 > 0) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, good boolean").withColumn("good", F.col("good").cast("int"))
    values = kernel.statistics(pa.array([t for _, t in rows]))
    project = kernel.Projection(values.mean(axis=0), values.std(axis=0) + 1, features=16)
    every = kernel.described(docs).join(known, "doc_id")
    sums = [kernel.equations(every.repartition(n), project) for n in (1, 6)]
    assert (sums[0] == sums[1]).all()
    z = np.concatenate([project(values) / kernel.GRID, np.array([[float(g)] for _, g in labels])], axis=1)
    assert np.allclose(sums[0].sum(axis=0), z.T @ z)


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    out = {r.doc_id: r for r in kernel.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items())
    held = [(r.quality, out[r.doc_id]) for r in labels.collect() if out[r.doc_id].held_out]
    good, bad = ([r for q, r in held if q == v] for v in (1, 0))
    assert sum(r.predicted for r in good) >= 0.95 * len(good) and sum(1 - r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(8)
    rows = [(k, cases.prose(rng, 40) if k % 4 else "AB!! | # " * 20, "x", k) for k in range(200)] + [(None, None, "y", 1), (7, "", None, 2), (7, "", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string, chars long")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int")
    one = sorted(map(tuple, kernel.classify(docs, labels).collect()), key=str)
    two = sorted(map(tuple, kernel.classify(docs.repartition(7), labels.withColumn("quality", F.when(kernel.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))).collect()), key=str)
    assert one == two and len(one) == len(rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "word " * 40_000), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in kernel.classify(docs, labels).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in kernel.classify(docs, one).collect())
    assert kernel.classify(docs.limit(0), one).collect() == []
