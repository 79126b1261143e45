"""The staged ingestion pipeline on Structured Streaming.

Stages are streams over files; each writes a table that the next reads. Delivery is at least once and
documents come again, unchanged or changed, so a stage replaces by document: a batch writes the rows of its documents
under the stream's generation and its own number, beside a list of the documents it was given. What counts of a
document is what came of its last delivery (``current``); a batch that runs again replaces what a failed
attempt has left, and a stream that lost its mark starts a new generation. ``compact`` drops what is out of date.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import chunking, rules
from tessella.session import by_value, materialise, scratch_path
from tessella.sources.queue import MessageQueue


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over Parquet files: a folder, or one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def delivered(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over Parquet files with ``delivered``: when its file came, the file, and the place in it; later is newer."""
    stream = read_stream(spark, path, **options)
    return stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("delivered"))


def _generation(spark: SparkSession, mark: str) -> int:
    """Milliseconds at which the stream of this mark first started, kept beside it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{mark}-generation")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(place, str(int(time.time() * 1000))))
    return int(fs.listStatus(place)[0].getPath().getName())


def newest(batch: DataFrame, key: str) -> DataFrame:
    """Of each key the rows of its last delivery in the batch."""
    last = batch.groupBy(key).agg(F.max("delivered").alias("delivered"))
    return batch.join(last, [key, "delivered"], "left_semi")


def run_stage(stream: DataFrame, sink: str, mark: str, stage: Callable[[DataFrame], DataFrame], key: str = "doc_id", times: int = 1) -> None:
    """Work off what there is: each batch's last delivery of every ``key`` through ``stage``.

    ``stream`` has the key and ``delivered``; ``stage`` gets the rows without ``delivered`` and returns rows with the key. A
    document's rows go to one file, so a stream over the sink never sees a part of them. A failed batch is tried ``times`` times.
    """
    spark = stream.sparkSession
    generation = _generation(spark, mark)

    def write(batch: DataFrame, number: int) -> None:
        own = newest(batch, key).persist()
        try:
            place = f"generation={generation}/batch={number}"
            came = own.select(key, "delivered").distinct()
            rows = stage(own.drop("delivered")).join(came, key)
            rows.repartition(key).write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/rows/{place}")
            came.write.mode("overwrite").parquet(f"{sink}/came/{place}")
        finally:
            own.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True)
    for left in reversed(range(times)):
        try:
            query.start().awaitTermination()
            return
        except StreamingQueryException:
            if not left:
                raise


def enqueue(jobs: DataFrame, folder: str, mark: str) -> None:
    """Work off a stream of messages (``body``) into the queue of a folder; each batch is there once, whatever fails."""
    spark = jobs.sparkSession
    by_value(MessageQueue.__module__)
    spark.dataSource.register(MessageQueue)
    sink = jobs.select("body").writeStream.format("message_queue").option("path", folder).option("generation", str(_generation(spark, mark)))
    sink.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def dequeue(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of a queue as a stream."""
    by_value(MessageQueue.__module__)
    spark.dataSource.register(MessageQueue)
    return spark.readStream.format("message_queue").option("path", folder).load()


def current(spark: SparkSession, sink: str, key: str = "doc_id") -> DataFrame:
    """The rows of the last delivery of every key, without ``delivered``, generation and batch."""
    at = F.struct("delivered", "generation", "batch")
    last = spark.read.parquet(f"{sink}/came").groupBy(key).agg(F.max(at).alias("at")).select(key, "at.generation", "at.batch")
    return spark.read.parquet(f"{sink}/rows").join(last, [key, "generation", "batch"], "left_semi").drop("delivered", "generation", "batch")


def compact(spark: SparkSession, sink: str, key: str = "doc_id") -> str:
    """The current rows and deliveries as a sink of their own; its path. The old one may go when nothing reads it."""
    new = scratch_path(spark, "compacted")
    at = F.struct("delivered", "generation", "batch")
    last = materialise(spark.read.parquet(f"{sink}/came").groupBy(key).agg(F.max(at).alias("at")).select(key, "at.*"), "last-deliveries")
    rows = spark.read.parquet(f"{sink}/rows").join(last.select(key, "generation", "batch"), [key, "generation", "batch"], "left_semi")
    rows.repartition("generation", "batch", F.pmod(F.xxhash64(key), F.lit(16))).write.partitionBy("generation", "batch").parquet(f"{new}/rows")
    last.repartition("generation", "batch").write.partitionBy("generation", "batch").parquet(f"{new}/came")
    return new


def following(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of a stage as the stream of the next; a later delivery, or a later attempt at it, is newer."""
    stream = read_stream(spark, f"{sink}/rows")
    again = F.struct(*[F.col(c).alias(c) for c in ("delivered", "generation", "batch")])
    return stream.select(*[c for c in stream.columns if c not in ("delivered", "generation", "batch")], again.alias("delivered"))


def to_table(stream: DataFrame, label: str) -> DataFrame:
    """What an appending stream gives for what there is, as a table in the shared folder."""
    spark = stream.sparkSession
    sink, mark = scratch_path(spark, label), scratch_path(spark, f"{label}-mark")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def chunk_stage(files: DataFrame) -> DataFrame:
    """Gate and chunk a batch of documents, in one pass: good ones give chunks (or a row without text, if nothing is left), short ones a failure row."""
    known = files.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("plain", text.plain(F.col("text")))
    gated = known.withColumn("short", F.length(F.when(F.col("plain"), F.col("text")).otherwise(text.cleaned(F.col("text")))) < 50)
    given = gated.select("doc_id", F.length("text").alias("n"), "short", "plain", F.when(~F.col("short"), F.col("text")).alias("text"))
    lists = chunking.chunk_lists(given, "doc_id", "text", chunking.PUBLIC_SIZE, "n", "short", plain="plain")
    rows = lists.select("doc_id", "n", "short", F.posexplode_outer("chunks").alias("at", "text"))
    failed = failure("chunk", F.concat(F.lit("only "), F.col("n"), F.lit(" characters of text")))
    status = F.when(F.col("short"), "chunk_failed").otherwise("chunked").alias("status")
    names = ("failed_stage", "last_error", "failed_at")
    return rows.select("doc_id", F.coalesce("at", F.lit(0)).alias("chunk_index"), "text", status, *[F.when(F.col("short"), c).alias(n) for n, c in zip(names, failed, strict=True)])


def failure(stage: str, message: Column) -> list[Column]:
    """What is kept of a failure: its stage, the first 2000 characters of its message, and its time."""
    return [F.lit(stage).alias("failed_stage"), text.error_text(message).alias("last_error"), F.current_timestamp().alias("failed_at")]


def figure_stage(files: DataFrame) -> DataFrame:
    """What a batch gives beside its chunks: a caption for every image, or a failure that is the figure's alone."""
    images = files.where(F.col("doc_id") % 6 == 5)
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    good = images.where(~empty).select("doc_id", F.lit("captioned").alias("status"), text.figure_text(F.substring("text", 1, 40), F.lit("")).alias("caption"))
    bad = images.where(empty).select("doc_id", F.lit("figure_failed").alias("status"), *failure("figures", F.lit("nothing to see")))
    return good.unionByName(bad, allowMissingColumns=True)


def summary_stage(chunks: DataFrame) -> DataFrame:
    """What the later stages see of a batch: chunks, characters (``length`` of each) and where a retry would resume."""
    by = chunks.groupBy("doc_id").agg(F.max("status").alias("status"), F.max("failed_stage").alias("failed_stage"), F.max("last_error").alias("last_error"), F.count("length").alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_chars"))
    return by.withColumn("retry_status", F.when(rules.may_retry(F.col("status")), rules.retry(F.col("failed_stage"))["status"]))


def ingest(spark: SparkSession, documents: str, **options: str) -> DataFrame:
    """Documents through both stages: one row per document, of its last delivery."""
    first, second = scratch_path(spark, "chunks"), scratch_path(spark, "summaries")
    run_stage(delivered(spark, documents, **options), first, scratch_path(spark, "mark"), chunk_stage)
    # Texts stay where they are: the second stage deals lengths.
    chunks = following(spark, first).select("doc_id", "status", "failed_stage", "last_error", F.length("text").alias("length"), "delivered")
    run_stage(chunks, second, scratch_path(spark, "mark"), summary_stage)
    return current(spark, second).select("doc_id", "status", "n_chunks", "n_chars", "retry_status", "last_error")


def ingest_with_figures(spark: SparkSession, documents: str) -> DataFrame:
    """Documents through the chunk stage, and through the figure stage as a stream of its own: (doc_id, status, figure_status).

    The two run at the same time, with marks and sinks of their own, so figures that fail or lag hold nothing up.
    """
    first, other = scratch_path(spark, "chunks"), scratch_path(spark, "figures")
    together([
        lambda: run_stage(delivered(spark, documents), first, scratch_path(spark, "mark"), chunk_stage),
        lambda: run_stage(delivered(spark, documents), other, scratch_path(spark, "mark"), figure_stage),
    ])
    status = current(spark, first).groupBy("doc_id").agg(F.max("status").alias("status"))
    figures = current(spark, other).groupBy("doc_id").agg(F.max("status").alias("figure_status"))
    return status.join(figures, "doc_id", "left")


def together(streams: list[Callable[[], None]]) -> None:
    """Run streams at the same time and wait for all of them; the first failure is raised when the others are done."""
    with ThreadPoolExecutor(len(streams)) as pool:
        running = [pool.submit(s) for s in streams]
    for r in running:
        r.result()


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def stage_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window (sliding, if ``slide`` is given) and type; state goes when the watermark passes a window."""
    counts = timed(events, late).groupBy(F.window("at", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users, each when the watermark passes its end: what is still open is not given out."""
    found = timed(events, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def latest_status(changes: DataFrame) -> DataFrame:
    """(user_id, status, n): the last change of each user so far, one state a user, whatever the order of arrival."""
    return changes.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n"))


def first_deliveries(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def status_changes(events: DataFrame) -> DataFrame:
    """(user_id, changes, last_type): changes of type a user has had, by state kept per user.

    A batch's rows of a user come in any order and are sorted by time within the batch; the size of a
    batch is bounded by the source (``maxFilesPerTrigger``), and only time and type of a row are held.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        changes, last = state.get if state.exists else (0, None)
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f[["ts", "event_id", "event_type"]])
        rows = pd.concat(held).sort_values(["ts", "event_id"])
        kinds = rows["event_type"]
        changes += int((kinds != kinds.shift()).iloc[1:].sum()) + int(last is not None and kinds.iloc[0] != last)
        last = kinds.iloc[-1]
        state.update((int(changes), last))
        yield pd.DataFrame({"user_id": [key[0]], "changes": [int(changes)], "last_type": [last]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, changes long, last_type string", "changes long, last_type string", "update", "NoTimeout")


def updates_to_table(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Updates of a stateful stream, batch by batch; the last of each key."""
    spark = stream.sparkSession
    sink = scratch_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/update={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{label}-mark")).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    return spark.read.parquet(sink).groupBy(*keys).agg(*[F.max_by(c, "__batch").alias(c) for c in rest])
