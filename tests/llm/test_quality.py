import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import quality

from . import cases


def counts(text):
    raw = text or ""
    w = cases.WORD.findall(raw)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = True
    lines = [x for x in raw.split("\n") if cases.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(raw.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(covered)


TEXTS = [t for _, t in cases.corpus()] + ["a b c a b c", "a a a a", "x\ny\nx\n \n \n\nx", "é# ß* 😀😀 <b>", "a\x0bb\x0cc\r\nd", "a b a b a b a", "\xa0 a"]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality.with_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_binomial_tail_is_exact(spark):
    cases_ = [(k, n) for n in (1, 5, 40, 300, 2000) for k in (0, 1, 3, 20, n) if k <= n]
    df = spark.createDataFrame(cases_, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        exact = math.fsum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.n <= 1000 or r.k <= 20 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-6)


def labelled(spark, n=4000):
    """Good documents with few symbols, bad ones with many; one stratum in two languages, the other nearly unlabelled."""
    rows = [(k, "en" if k % 10 else "xx", " ".join(("w#" if k % 5 == 0 and j % 2 else f"w{(k * 31 + j * j) % 997}") for j in range(60)), 0 if k % 5 == 0 else 1) for k in range(n)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[1] == "en"] + [(10, 1), (20, 1), (0, None)], "doc_id long, quality int")
    return docs, labels, {r[0]: r for r in rows}


def test_cutoffs_reject_bad_and_spare_good(spark):
    docs, labels, rows = labelled(spark)
    out = {r.doc_id: r for r in quality.verdicts(docs, labels).collect()}
    assert len(out) == len(rows)
    good = [r for k, r in out.items() if rows[k][3] and rows[k][1] == "en"]
    bad = [r for k, r in out.items() if not rows[k][3] and rows[k][1] == "en"]
    assert sum(not r.kept for r in good) <= 0.05 * len(good) and sum(not r.kept for r in bad) == len(bad)
    # Two labels bound nothing: the unlabelled language meets the base rule alone.
    assert all(r.kept == (not r.base_failed) for k, r in out.items() if rows[k][1] == "xx")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in out.items() if r.kept)


def test_every_cutoff_passes_its_own_test(spark):
    docs, labels, _ = labelled(spark)
    found = quality.cutoffs(quality.with_counts(docs), labels, "lang").collect()
    assert found
    for r in found:
        w = quality.WEIGHTS[r.rule]
        tail = math.fsum(math.comb(r.n_good, i) * (0.05 * w) ** i * (1 - 0.05 * w) ** (r.n_good - i) for i in range(r.n_rejected + 1))
        assert tail <= 0.05 * w / 2 + 1e-12 and r.n_bad > 0
    assert sum(quality.WEIGHTS.values()) == 1 and set(quality.WEIGHTS) == set(quality.RULES)


def test_rules_that_catch_nothing_bad_are_silent(spark):
    docs, labels, _ = labelled(spark)
    good = labels.where("quality = 1")
    assert quality.cutoffs(quality.with_counts(docs), good, "lang").count() == 0
    assert {r.rule for r in quality.cutoffs(quality.with_counts(docs), labels, "lang").collect()} == {"symbols"}


def test_the_smallest_table_has_rules_that_act(spark):
    """Some documents are rejected by a calibrated rule, and by far most good ones are not."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.verdicts(docs, labels).collect()}
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    calibrated = [k for k, r in out.items() if r.broken and not r.base_failed]
    assert len(calibrated) > 10 and not [k for k in calibrated if quality_of.get(k) == 1]


def test_odd_tables(spark):
    rows = [(None, None, None, 1), (1, "en", "", 2), (1, "en", "", 2), (2, None, "w " * 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.verdicts(docs, labels).collect()
    assert len(out) == 4 and not any(r.kept for r in out)
    assert quality.verdicts(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
