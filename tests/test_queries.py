"""Registered queries against DuckDB at the smallest scale, and plans that should stay as they are."""

import datetime
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import text
from tessella.plans import catalogue
from tessella.streaming import stages

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    done = duck.execute(SQL[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == columns
    rows = [tuple(plain(r[theirs.index(c)]) for c in columns) for r in done.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(ours, key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(QUERIES) <= set(entry.queries())


def test_stream_equals_batch(spark, data):
    """Every document ends chunked with the chunks of the batch operator, or failed."""
    rows = {r.doc_id: r for r in QUERIES["stream_ingest"](spark, data).collect()}
    batch = {r.doc_id: r.n for r in QUERIES["chunk_lengths"](spark, data).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        got = rows[r.doc_id]
        assert (got.status, got.retry_status) == (("chunk_failed", "queued") if len(r.text) < 50 else ("chunked", None))
        assert got.n_chunks == (batch[r.doc_id] if len(r.text) >= 50 else 0)


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["recent_users_top20"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "TakeOrderedAndProject" in plan and "o_comment" not in plan
    plan = QUERIES["plan_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_mktsegment:string>" in plan


def test_codes_end_at_the_nearest_second(spark, tmp_path):
    """Signups at half seconds and other fractions, entries around their ends, one row without a time; as SQL has it."""
    at = datetime.datetime(2024, 1, 1)
    rows, n = [], 0
    for user, fraction in enumerate((0.0, 0.4, 0.5, 0.6, 1.5, 1.6)):
        times = [("signup", fraction), *[("click", 600 + x / 4) for x in range(13)], ("signup" if user == 3 else "view", None)]
        for kind, seconds in times:
            n += 3
            rows.append((n, None if seconds is None else at + datetime.timedelta(seconds=seconds), user, kind))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    ours = sorted((r.event_id, r.result) for r in QUERIES["code_checks"](spark, str(tmp_path)).collect())
    theirs = duckdb.sql(SQL["code_checks"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert ours == sorted(theirs) and {r for _, r in theirs} >= {"ok", "expired"}


def scans(plan, table):
    return plan.count(f"/{table}.parquet")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_texts_once_and_pair_nothing(spark, data):
    """Texts are folded in one pass that is written; topics come as one row; no join pairs documents with a whole table."""
    q = catalogue.queries()
    assert scans(plan_of(q["bm25_benchmark_top8"](spark, data)), "documents") == 0
    assert "Exchange hashpartitioning" not in plan_of(q["keyword_distribution"](spark, data))
    for name in ("cosine_threshold_assign", "blended_score"):
        plan = plan_of(q[name](spark, data))
        assert "CartesianProduct" not in plan and "BuildLeft" not in plan.partition("BroadcastNestedLoopJoin")[2][:20]


def test_scored_pairs_do_not_travel(spark, data):
    """Pairs of questions and documents are summed where a document's postings are."""
    plan = plan_of(catalogue.queries()["bm25_pairs_scored"](spark, data))
    assert "Exchange" in plan and not re.search(r"hashpartitioning\(query#\w+, doc_id", plan)


def test_late_rows_are_dropped_and_repeated_batches_replace(spark):
    """A row behind the watermark counts no more; a batch that runs twice leaves its rows once."""
    import datetime

    from tessella.session import scratch_path
    from tessella.streaming import stages

    folder = scratch_path(spark, "late")
    at = datetime.datetime(2024, 1, 1)
    row = lambda k, hours: (k, at + datetime.timedelta(hours=hours), 1, "click", 1.0, "")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for n, rows in enumerate([[row(1, 0), row(2, 100)], [row(3, 99.9)], [row(4, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")
    counts = stages.updates_to_table(stages.stage_counts(stream()), ["start", "event_type"], "late").collect()
    assert sorted((r.start.day, r.n) for r in counts) == [(1, 1), (5, 2)]


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)


def test_the_last_delivery_of_a_document_counts_once(spark):
    """Equal and changed redeliveries, in one batch or several, a failed batch, and a lost mark."""
    from tessella.session import scratch_path
    from tessella.streaming import stages

    folder, sink, mark = (scratch_path(spark, x) for x in ("source", "sink", "mark"))
    tries = []

    def stage(batch):
        tries.append(batch.count())
        if len(tries) == 2:
            raise ValueError("once")
        return batch.where("text <> 'gone'").select("doc_id", F.explode(F.split("text", " ")).alias("word"))

    deliver(spark, folder, [(1, "old words here"), (2, "two")])
    deliver(spark, folder, [(1, "new words"), (3, "three"), (4, "gone soon")])
    run = lambda mark, n: stages.run_stage(stages.delivered(spark, folder, maxFilesPerTrigger=str(n)), sink, mark, stage, times=2)
    run(mark, 1)
    assert len(tries) == 3  # the second batch failed once
    words = lambda where: sorted((r.doc_id, r.word) for r in stages.current(spark, where).collect())
    due = [(1, "new"), (1, "words"), (2, "two"), (3, "three"), (4, "gone"), (4, "soon")]
    assert words(sink) == due
    deliver(spark, folder, [(1, "new words"), (4, "gone")])
    run(mark, 1)
    due = due[:4]  # a document of which nothing is left is gone
    assert words(sink) == due
    run(scratch_path(spark, "mark"), 9)  # every delivery again, in one batch
    assert words(sink) == due and words(stages.compact(spark, sink)) == due


def test_odd_texts_through_the_chunk_stage(spark, data, tmp_path):
    """Texts that cleaning or composition change, or leave nothing of, get what SQL gives them, and a batch is read once."""
    words = "Some words of a sentence. " * 9
    odd = ["\x00", "\x0b", "\x7f", "\ufffd", "\\q", "\\n", "e\u0301", "\u212b", "\u00a0", "\u02ff", "\u2028", "\U0001f600", "\n \n", "\t\r"]
    texts = [words * n + o + words for o in odd for n in (1, 30)] + [o * 60 for o in odd] + ["\\\\" + " " * 60, "x" * 49 + "\x00\x00", "x" * 50, "", None, words * 200]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in stages.summary_stage(stages.chunk_stage(docs).withColumn("length", F.length("text"))).select("doc_id", "status", "n_chunks", "n_chars", "last_error").collect()}
    assert set(got) == set(range(len(texts)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    due = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, status, n_chunks, n_chars, last_error FROM ({SQL['stream_redelivered']})").fetchall()}
    assert {i: (got[i], due[i]) for i, t in rows if t is not None and got[i] != due[i]} == {}
    changed = {r[0] for r in docs.where(~text.plain(F.col("text"))).select("doc_id").collect()}
    same = docs.where(text.sanitised(F.col("text")) == F.col("text")).select("doc_id").collect()
    assert {i for i, t in rows if t is not None} - {r[0] for r in same} <= changed
    assert scans(plan_of(stages.chunk_stage(spark.read.parquet(f"{data}/documents.parquet"))), "documents") == 1


def test_both_stages_follow_a_redelivery(spark):
    from tessella.session import scratch_path
    from tessella.streaming import stages

    folder = scratch_path(spark, "source")
    long = "A sentence of some words. " * 100
    for rows in ([(1, long * 3), (2, "short")], [(1, long), (2, long)], [(1, long)], [(2, "short"), (3, " " * 80)]):
        deliver(spark, folder, rows)
    for n in ("1", "9"):
        out = {r.doc_id: r for r in stages.ingest(spark, folder, maxFilesPerTrigger=n).collect()}
        assert {k: r.status for k, r in out.items()} == {1: "chunked", 2: "chunk_failed", 3: "chunked"}
        once = stages.chunk_stage(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
        assert (out[1].n_chunks, out[1].n_chars, out[3].n_chunks) == (len(once), sum(len(r.text) for r in once), 0)


def test_a_slow_fork_holds_nothing_up(spark):
    import threading

    from tessella.session import scratch_path
    from tessella.streaming import stages

    folder = scratch_path(spark, "source")
    deliver(spark, folder, [(1, "x"), (2, "y")])
    done = threading.Event()

    def slow(batch):
        assert done.wait(60), "the other stream waited for this one"
        return batch

    def quick():
        stages.run_stage(stages.delivered(spark, folder), scratch_path(spark, "quick"), scratch_path(spark, "mark"), lambda b: b)
        done.set()

    stages.together([lambda: stages.run_stage(stages.delivered(spark, folder), scratch_path(spark, "slow"), scratch_path(spark, "mark"), slow), quick])
