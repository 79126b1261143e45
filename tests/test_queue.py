import json

import pytest
from pyspark.errors import StreamingQueryException

from tessella.session import scratch_path
from tessella.sources import queue
from tessella.streaming import stages


def deliver(spark, folder, bodies):
    spark.createDataFrame([(b,) for b in bodies], "body string").repartition(3).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema("body string").parquet(folder)


def taken(spark, folder, sink, mark):
    """A consumer that goes on where it was."""
    stages.dequeue(spark, folder).writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return sorted(r.body for r in spark.read.schema("body string").parquet(sink).collect())


def test_messages_pass_once_over_restarts_of_both_ends(spark):
    first, folder, sink, sent, got = (scratch_path(spark, x) for x in ("jobs", "queue", "sink", "mark", "mark"))
    bodies = ["a", 'with "quotes"\nand lines', "", "é😀", "x" * 3_000_000]
    deliver(spark, first, bodies)
    stages.enqueue(source(spark, first), folder, sent)
    assert taken(spark, folder, sink, got) == sorted(bodies)
    assert taken(spark, folder, sink, got) == sorted(bodies)
    deliver(spark, first, ["later", None])
    stages.enqueue(source(spark, first), folder, sent)
    assert taken(spark, folder, sink, got) == sorted([*bodies, "later", ""])
    stages.enqueue(source(spark, first), folder, scratch_path(spark, "mark"))  # a producer without its mark sends all again, as new messages
    assert len(taken(spark, folder, sink, got)) == 14


class Faulty(queue.MessageQueue):
    @classmethod
    def name(cls):
        return "faulty_queue"

    def streamWriter(self, schema, overwrite):  # noqa: N802
        path, trouble, once = self.options["path"], self.options["trouble"], self.options["once"]

        class Writer(queue.QueueWriter):
            def commit(self, messages, batchId):  # noqa: N803
                import os

                if trouble == "after":
                    super().commit(messages, batchId)
                if not os.path.exists(once):
                    open(once, "w").close()
                    raise OSError("no commit")
                if trouble != "after":
                    super().commit(messages, batchId)

        return Writer(path, 1)


@pytest.mark.parametrize("trouble", ["before", "after"])
def test_a_failed_commit_loses_and_doubles_nothing(spark, trouble, tmp_path):
    first, folder, mark = (scratch_path(spark, x) for x in ("jobs", "queue", "mark"))
    deliver(spark, first, [json.dumps({"n": n}) for n in range(50)])
    spark.dataSource.register(Faulty)
    start = lambda: source(spark, first).writeStream.format("faulty_queue").option("path", folder).option("trouble", trouble).option("once", str(tmp_path / "failed")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(StreamingQueryException):
        start()
    start()
    bodies = taken(spark, folder, scratch_path(spark, "sink"), scratch_path(spark, "mark"))
    assert bodies == sorted(json.dumps({"n": n}) for n in range(50))


def test_a_queue_that_is_not_there_is_empty(spark):
    assert taken(spark, scratch_path(spark, "nowhere"), scratch_path(spark, "sink"), scratch_path(spark, "mark")) == []
