import datetime
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import topics
from tessella.session import cancel, scratch_path, tagged
from tessella.streaming import stages, state

START = datetime.datetime(2024, 1, 1)


def deliver(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_topics_equal_those_of_a_batch_and_go_on_after_a_restart(spark):
    rng = random.Random(4)
    schema = "project long, id long, vector array<double>"
    rows = [(k % 3, k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    folder, sink, mark = (scratch_path(spark, x) for x in ("arrivals", "topics", "mark"))
    for at in (0, 25):
        deliver(spark, folder, rows[at : at + 25], schema)
    state.worked_off(state.online_topics(stream(spark, folder, schema), 0.5), "t", mark, sink)
    deliver(spark, folder, [*rows[50:], (1, 1000, None)], schema)
    found = state.worked_off(state.online_topics(stream(spark, folder, schema), 0.5), "t", mark, sink).collect()
    due = topics.online(spark.createDataFrame(rows, schema), "project", "id", "vector", 0.5).collect()
    assert {r.id: (r.topic, round(r.confidence, 9)) for r in found} == {r.id: (r.topic, round(r.confidence, 9)) for r in due} and len(found) == len(rows)


def test_a_call_is_taken_once_and_not_too_late(spark):
    schema = "request long, id long, at timestamp, stash boolean, data string"
    folder, sink, mark = (scratch_path(spark, x) for x in ("calls", "taken", "mark"))
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    batches = [
        [(1, 1, at(0), True, "a"), (2, 2, at(0), True, "b"), (3, 3, at(1), False, None), (4, 4, at(0), True, "d"), (5, 20, at(0), True, "e")],
        [(1, 5, at(5), False, None), (1, 6, at(6), False, None), (2, 7, at(10), False, None), (4, 8, at(1), True, "later"), (4, 9, at(2), False, None)],
        [(9, 10, at(500), True, "z")],  # the watermark moves far on
        [(5, 11, at(501), False, None), (9, 12, at(502), False, None), (1, 13, at(503), True, "again"), (1, 14, at(504), False, None)],
    ]
    for rows in batches:
        deliver(spark, folder, rows, schema)
        out = state.worked_off(state.taken_once(stream(spark, folder, schema)), "t", mark, sink)  # a restart each time
    found = {r.id: (r.taken, r.data) for r in out.collect()}
    assert found == {3: (False, None), 5: (True, "a"), 6: (False, None), 7: (False, None), 9: (True, "later"), 11: (False, None), 12: (True, "z"), 14: (True, "again")}


def test_a_change_keeps_what_it_does_not_send(spark):
    schema = "user_id long, id long, at timestamp, status string, plan long, ends long"
    folder = scratch_path(spark, "changes")
    day = lambda n: START + datetime.timedelta(days=n)
    for rows in ([(1, 1, day(1), "active", 5, 100), (2, 2, day(9), "canceled", None, None)], [(1, 3, day(2), "past_due", None, None), (2, 4, day(3), "active", 7, 50)], [(1, 5, day(2), None, 6, None)]):
        deliver(spark, folder, rows, schema)
    out = stages.updates_to_table(state.subscriptions(stream(spark, folder, schema), ["status", "plan", "ends"]), ["user_id"], "s")
    assert {r.user_id: (r.status, r.plan, r.ends) for r in out.collect()} == {1: ("past_due", 6, 100), 2: ("canceled", 7, 50)}


def test_a_tagged_job_ends_and_others_go_on(spark):
    outcome = {}

    def slow(name, tag):
        rows = spark.range(4, numPartitions=2).select(F.udf(lambda x: time.sleep(2) or x, "long")("id").alias("x"))
        try:
            with tagged(spark, tag):
                outcome[name] = rows.agg(F.sum("x")).first()[0]
        except Exception as error:
            outcome[name] = str(error)

    threads = [threading.Thread(target=slow, args=a) for a in (("one", "stop-me"), ("two", "leave-me"))]
    for thread in threads:
        thread.start()
    time.sleep(1.5)
    cancel(spark, "stop-me")
    for thread in threads:
        thread.join()
    assert outcome["two"] == 6 and "cancel" in outcome["one"].lower()


def test_streamed_topics_query_equals_the_batch_query(spark, data):
    from tessella.plans import catalogue

    q = catalogue.queries()
    one = {r.id: (r.project, r.topic) for r in q["stream_topics"](spark, data).collect()}
    assert one == {r.vec_id: (r.project, r.topic) for r in q["online_topics"](spark, data).collect()}
