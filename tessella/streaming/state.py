"""State of a stream's own kind: topics that form while documents arrive, calls that are taken once, partial updates, overdue jobs.

Arbitrary state is kept by key in RocksDB, so it need not fit a task's memory but for the key at hand; the rows of a key in one
batch are put in order of time before they count, and the size of a batch is the source's to bound
(``maxFilesPerTrigger``). Between batches rows must not overtake each other where the result depends on order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators import topics
from tessella.operators.topics import ASSIGN, Topics
from tessella.session import by_value, scratch_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back."""
    by_value(__name__, topics.__name__)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def worked_off(stream: DataFrame, label: str, mark: str | None = None, sink: str | None = None) -> DataFrame:
    """What an appending stream gives for what there is, as a table in the shared folder; the same mark and sink go on where they were."""
    spark = stream.sparkSession
    sink, mark = sink or scratch_path(spark, label), mark or scratch_path(spark, f"{label}-mark")
    with keyed_state(spark):
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


class _TopicStates(StatefulProcessor):
    """Topics of a project: size, sum of vectors, and place in the order of their making."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("topics", "name long", "place int, n long, sums array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([f[["id", "vector"]] for f in rows]).sort_values("id")
        known = sorted((v[0], k[0], v[1], v[2]) for k, v in self.held.iterator())
        now = Topics(len(came["vector"].iloc[0]))
        for _, name, n, sums in known:
            now.restore(name, n, np.asarray(sums))
        out, changed = [], set()
        for k, v in zip(came["id"], came["vector"], strict=True):
            name, sure = now.add(int(k), np.asarray(v, dtype=np.float64), self.threshold)
            out.append((key[0], int(k), name, sure))
            changed.add(name)
        for place, name in enumerate(now.names):
            if name in changed:
                self.held.updateValue((name,), (place, int(now.counts[place]), now.sums[place].tolist()))
        yield pd.DataFrame(out, columns=["project", "id", "topic", "confidence"])

    def close(self) -> None:
        pass


def online_topics(docs: DataFrame, threshold: float = ASSIGN) -> DataFrame:
    """(project, id, topic, confidence) of a stream (project long, id long, vector array<double>), as ``topics.online`` gives for all of it.

    Rows without a vector are left out.
    """
    by_value(__name__, topics.__name__)
    known = docs.where(F.col("vector").isNotNull() & F.col("project").isNotNull() & F.col("id").isNotNull()).select("project", "id", "vector")
    return known.groupBy("project").transformWithStateInPandas(statefulProcessor=_TopicStates(threshold), outputStructType="project long, id long, topic long, confidence double", outputMode="Append", timeMode="None")


class _Pending(StatefulProcessor):
    """What waits under a request, until it is taken or too old."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "at_ms long, data string")

    def _drop_timers(self) -> None:
        for expiry in list(self.handle.listTimers()):
            self.handle.deleteTimer(expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        held = self.waiting.get() if self.waiting.exists() else None
        out = []
        for k, at, stash, data in zip(came["id"], came["at_ms"], came["stash"], came["data"], strict=True):
            if stash:
                held = (int(at), data)
            else:
                fresh = held is not None and at - held[0] < self.keep
                out.append((key[0], int(k), bool(fresh), held[1] if fresh else None))
                held = None
        self._drop_timers()
        if held is None:
            self.waiting.clear()
        else:
            self.waiting.update(held)
            self.handle.registerTimer(held[0] + self.keep)
        yield pd.DataFrame(out, columns=["request", "id", "taken", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nobody came: the state goes with the watermark."""
        self.waiting.clear()
        yield pd.DataFrame([], columns=["request", "id", "taken", "data"])

    def close(self) -> None:
        pass


def taken_once(calls: DataFrame, keep: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(request, id, taken, data) of every take in a stream of (request long, id long, at timestamp, stash boolean, data string).

    A take gets what was stashed last under its request, if that is younger than ``keep`` and no take came between; a second or late
    take gets nothing. What is never taken leaves the state when the watermark passes its time.
    """
    by_value(__name__)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = calls.select("request", "id", "at", "stash", "data", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    return rows.groupBy("request").transformWithStateInPandas(statefulProcessor=_Pending(keep_ms), outputStructType="request long, id long, taken boolean, data string", outputMode="Append", timeMode="EventTime")


def subscriptions(changes: DataFrame, columns: list[str]) -> DataFrame:
    """The latest known value of each column by ``user_id``: (user_id, at, id, columns...) in, one row a user out.

    A change that doesn't send a column (null) keeps its older value; changes may arrive in any order, for every column
    has the value of its latest event, and an aggregate keeps no more than that.
    """
    order = F.struct("at", "id")
    return changes.groupBy("user_id").agg(F.max("at").alias("changed_at"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def overdue(started: DataFrame, ended: DataFrame, limit: str = "480 seconds", late: str = "1 hour") -> DataFrame:
    """(job, id, started_at) of starts (job, id, at) that no end (job, at) followed within ``limit``: each once the watermark is past its time.

    A stream-stream outer join with bounds on time, so state is what may still match.
    """
    begun = started.select(F.col("job"), "id", F.col("at").alias("started_at")).withWatermark("started_at", late)
    done = ended.select(F.col("job").alias("done_job"), F.col("at").alias("ended_at")).withWatermark("ended_at", late)
    within = (F.col("job") == F.col("done_job")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {limit}"))
    return begun.join(done, within, "left_outer").where("ended_at is null").select("job", "id", "started_at")
