import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd

from tessella.llm import resample

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(cases.SMALL))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % resample.BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(docs, target):
    every = [(k, *features(t)) for k, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in every:
        s.update(c)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for k, n, c in every:
        weight = sum(gain(b) * m for b, m in c.items())
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((k, n, sum(c.values()), weight, score))
    fit = sorted((r for r in rows if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return Counter((*r, rank.get(id(r))) for r in rows)


DOCS = [*cases.corpus(4), (1, "Ünder_score É é a\0b 'quoted' x-y"), (2, "w" * 70_000 + " " + "é" * 40_000 + " end"), (None, "a b c " * 30), (10, "again and again " * 12), (10, "again and again " * 12)]
TARGET = [cases.prose(__import__("random").Random(7), 80) for _ in range(9)] + [None, "", "One two"]


def found(frame):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


def test_equals_brute_force_whatever_the_layout(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    due = brute(DOCS, TARGET)
    for parts in (1, 5):
        assert found(resample.resample(docs.repartition(parts), target)) == due


def test_sql_equals_brute_force():
    docs = [(k, t and t.replace("w" * 69_000, "").replace("é" * 39_000, "")) for k, t in DOCS]  # SQL takes a step a byte
    con = duckdb.connect()
    con.register("d", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("b", pd.DataFrame({"text": TARGET}))
    con.sql("CREATE VIEW documents AS SELECT * FROM d")
    con.sql("CREATE VIEW benchmark AS SELECT * FROM b")
    out = con.sql(resample.resample_sql()).fetchall()
    assert Counter(out) == Counter({(k, f, w, s, r): n for (k, _, f, w, s, r), n in brute(docs, TARGET).items()})


def test_ranks_have_no_gap_and_ties_go_by_id(spark):
    docs = spark.createDataFrame([(k, "same words in every text " * 6) for k in range(2000)], "doc_id long, text string")
    rows = [r for r in resample.resample(docs, docs.limit(1)).collect() if r["rank"]]
    assert sorted(r["rank"] for r in rows) == list(range(1, 101))
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert [(r.score, r.doc_id) for r in ordered] == sorted(((r.score, r.doc_id) for r in rows), key=lambda x: (-x[0], x[1]))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (None, None, None, None)], "doc_id long, text string, buckets string, rank int")
    none = docs.limit(0)
    assert all(r.weight == 0 and r["rank"] is None for r in resample.resample(docs, none).collect())
    assert resample.resample(none, none).collect() == []
