"""Streaming queries, each run over what there is; their SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import parse
from tessella.operators import chunking
from tessella.session import scratch_path
from tessella.streaming import stages, state

from .base import Book
from .texts import chunks_sql, clean_sql

book = Book()
query = book.query


def events(t):
    return stages.read_stream(t.spark, f"{t.folder}/events.parquet")


@query("stream_stage_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    t.events  # ships the package
    return stages.updates_to_table(stages.stage_counts(events(t)), ["start", "event_type"], "stage-counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding_counts", """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS start FROM events) GROUP BY ALL""")
def _(t):
    t.events
    counts = stages.stage_counts(events(t), "12 hours", "6 hours")
    return stages.updates_to_table(counts, ["start", "event_type"], "sliding").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)),
 e AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS ends, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, start, n FROM e WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def _(t):
    t.events
    return stages.to_table(stages.sessions(events(t)), "sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_billing", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id")
def _(t):
    """Three kinds of change events; each user has the last."""
    t.events
    changes = events(t).where("event_type in ('signup', 'purchase', 'error')")
    return stages.updates_to_table(stages.latest_status(changes), ["user_id"], "billing")


@query("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def _(t):
    t.events
    twice = events(t).unionByName(events(t))
    return stages.to_table(stages.first_deliveries(twice).select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_status_changes", """SELECT user_id, count(*) FILTER (prev IS NOT NULL AND prev <> event_type) AS changes, arg_max(event_type, (ts, event_id)) AS last_type
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id""")
def _(t):
    t.events
    return stages.updates_to_table(stages.status_changes(events(t).select("user_id", "event_id", "ts", "event_type")), ["user_id"], "status")


INGESTED = f"""WITH {chunks_sql(chunking.PUBLIC_SIZE)}, g AS (SELECT doc_id, length(text) AS raw, length({clean_sql("text")}) < 50 AS short FROM documents)
 SELECT g.doc_id, CASE WHEN any_value(short) THEN 'chunk_failed' ELSE 'chunked' END AS status, CASE WHEN any_value(short) THEN 0 ELSE count(c) END AS n_chunks, CASE WHEN any_value(short) THEN 0 ELSE coalesce(CAST(sum(length(c)) AS BIGINT), 0) END AS n_chars,
 CASE WHEN any_value(short) THEN 'queued' END AS retry_status, CASE WHEN any_value(short) THEN 'only ' || any_value(raw) || ' characters of text' END AS last_error FROM g LEFT JOIN chunks USING (doc_id) GROUP BY g.doc_id"""


@query("stream_ingest", INGESTED)
def _(t):
    t.documents
    return stages.ingest(t.spark, f"{t.folder}/documents.parquet")


@query("stream_redelivered", INGESTED)
def _(t):
    """Every document comes three times: an older text, its text, and its text once more; the last version is there once.

    The files of the deliveries are the query's own and go when their batch is done.
    """
    source = scratch_path(t.spark, "deliveries")
    older = t.documents.withColumn("text", F.concat(F.lit("An older text. "), F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))))
    for docs in (older, t.documents, t.documents):
        docs.write.mode("append").option("compression", "zstd").parquet(source)
    return stages.ingest(t.spark, source, maxFilesPerTrigger="3", cleanSource="delete")


@query("stream_fork", f"""SELECT doc_id, CASE WHEN length({clean_sql("text")}) < 50 THEN 'chunk_failed' ELSE 'chunked' END AS status, CASE WHEN doc_id % 6 = 5 THEN CASE WHEN length(trim(text)) = 0 THEN 'figure_failed' ELSE 'captioned' END END AS figure_status FROM documents""")
def _(t):
    t.documents
    return stages.ingest_with_figures(t.spark, f"{t.folder}/documents.parquet")


def timed(t):
    return events(t).withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_taken_once", """SELECT user_id AS request, event_id AS id, before = 'stash' AND ts - since < INTERVAL '12 hours' AS taken, CASE WHEN before = 'stash' AND ts - since < INTERVAL '12 hours' THEN data END AS data
 FROM (SELECT user_id, event_id, ts, kind, coalesce(lag(kind) OVER w, '-') AS before, lag(ts) OVER w AS since, lag(data) OVER w AS data FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'take' ELSE 'stash' END AS kind, 'call ' || event_id AS data FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE kind = 'take'""")
def _(t):
    """Clicks and views take what other events of their user stashed, once and within twelve hours."""
    t.events
    calls = timed(t).select(F.col("user_id").alias("request"), F.col("event_id").alias("id"), "at", (~F.col("event_type").isin("click", "view")).alias("stash"), F.concat(F.lit("call "), "event_id").alias("data"))
    return state.worked_off(state.taken_once(calls, "12 hours"), "taken")


@query("stream_subscriptions", """SELECT user_id, max(ts) AS changed_at, arg_max(status, (ts, event_id)) AS status, arg_max(plan, (ts, event_id)) FILTER (plan IS NOT NULL) AS plan, arg_max(ends, (ts, event_id)) FILTER (ends IS NOT NULL) AS ends
 FROM (SELECT *, CASE event_type WHEN 'error' THEN 'canceled' ELSE 'active' END AS status, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 5 END AS plan, CASE WHEN event_type = 'purchase' THEN ts + INTERVAL '30 days' END AS ends FROM events WHERE event_type IN ('signup', 'purchase', 'error')) GROUP BY user_id""")
def _(t):
    """Signups send a plan, purchases also an end date, errors cancel; what a change doesn't send stays."""
    t.events
    kind = F.col("event_type")
    sent = timed(t).where(kind.isin("signup", "purchase", "error")).select(
        "user_id", "at", F.col("event_id").alias("id"), F.when(kind == "error", "canceled").otherwise("active").alias("status"),
        F.when(kind != "error", F.floor("value").cast("long") % 5).alias("plan"), F.when(kind == "purchase", F.col("at") + F.expr("INTERVAL 30 days")).alias("ends"),
    )
    out = stages.updates_to_table(state.subscriptions(sent, ["status", "plan", "ends"]), ["user_id"], "subscriptions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("changed_at", "ends")})


@query("stream_overdue", """WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM e)) - INTERVAL '1 hour' AS mark)
 SELECT user_id AS job, event_id AS id, ts AS started_at FROM s, w WHERE ts + INTERVAL '6 hours' < mark AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.ts BETWEEN s.ts AND s.ts + INTERVAL '6 hours')""")
def _(t):
    """Clicks that no view of their user follows within six hours."""
    t.events
    started = timed(t).where("event_type = 'click'").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), "at")
    ended = timed(t).where("event_type = 'view'").select(F.col("user_id").alias("job"), "at")
    return stages.to_table(state.overdue(started, ended, "6 hours"), "overdue").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("stream_topics")
def _(t):
    """Topics of four projects, formed by a stream; equal to ``online_topics``."""
    vectors_ = stages.read_stream(t.spark, f"{t.folder}/embeddings.parquet")
    t.embeddings
    docs = vectors_.select((F.col("vec_id") % 4).alias("project"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return state.worked_off(state.online_topics(docs, 0.3), "topics")


@query("stream_queue", """SELECT doc_id, CASE WHEN length(trim(text)) >= 50 THEN 'embed' ELSE 'retry' END AS type FROM documents""")
def _(t):
    """Each document sends a job through a queue to the next stage, which reads what kind of job it is."""
    t.documents
    folder = scratch_path(t.spark, "queue")
    kind = F.when(F.length(F.trim("text")) >= 50, "embed").otherwise("retry")
    jobs = stages.read_stream(t.spark, f"{t.folder}/documents.parquet").select(F.to_json(F.struct(kind.alias("type"), F.col("doc_id").cast("string").alias("docId"))).alias("body"))
    stages.enqueue(jobs, folder, scratch_path(t.spark, "mark"))
    came = stages.to_table(stages.dequeue(t.spark, folder), "jobs").select(parse.job(F.col("body")).alias("j")).where("j is not null")
    return came.select(F.col("j.docId").cast("long").alias("doc_id"), "j.type")
