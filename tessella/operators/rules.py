"""Billing, quota, upload and retry rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRYABLE = ("failed", "chunk_failed", "ocr_failed")


def upload_problems(name: Column, size: Column, kinds: tuple[str, ...], most: int) -> Column:
    """What is wrong with an upload, as a list."""
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.array_compact(F.array(F.when(~kind.isin(*kinds), F.lit("type")), F.when(size > most, F.lit("size"))))


def over_quota(used: Column, incoming: Column, limit: Column) -> Column:
    return used + incoming > limit


def usage_percent(used: Column, limit: Column) -> Column:
    """Rounded half up, as the web does, at most 100; 0 without a limit."""
    return F.when(limit > 0, F.least(F.floor(used / limit * 100 + 0.5), F.lit(100))).otherwise(0).cast("long")


def usage_band(percent: Column) -> Column:
    return F.when(percent < 80, "green").when(percent < 95, "yellow").otherwise("red")


def subscription_active(status: Column, cancelling: Column, ends: Column, now: Column) -> Column:
    """Paid states count; one that is being cancelled until its end, if that is known."""
    paid = F.coalesce(status.isin("active", "trialing"), F.lit(False))
    return F.when(~paid, False).when(cancelling & ends.isNotNull(), ends > now).otherwise(True)


def may_retry(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def retry(failed_stage: Column) -> Column:
    """The stage to resume and the status meanwhile; an unknown stage starts over."""
    stage = F.when(failed_stage.isin("embed", "summarize"), failed_stage).otherwise("chunk")
    return F.struct(stage.alias("stage"), F.when(stage == "embed", "chunked").when(stage == "summarize", "embedded").otherwise("queued").alias("status"))


def visible(docs: DataFrame, readers: DataFrame, teams: DataFrame) -> DataFrame:
    """(reader, visible): how many documents each reader may see.

    ``docs`` has id, owner, level (0 private, 1 project, 2 all, 3 department) and department, ``teams`` the team of
    a document, ``readers`` reader, its (department) and team. Documents are counted by what
    grants access before readers meet the counts.
    """
    own = docs.where("level = 0").groupBy(F.col("owner").alias("reader")).agg(F.count("*").alias("a"))
    shared = docs.where("level = 1").join(teams, "id").groupBy("team").agg(F.count("*").alias("b"))
    open_ = docs.where("level = 2").agg(F.count("*").alias("c"))
    near = docs.where("level = 3").groupBy(F.col("department").alias("its")).agg(F.count("*").alias("d"))
    zero = F.lit(0)
    every = readers.join(own, "reader", "left").join(shared, "team", "left").join(near, "its", "left").join(F.broadcast(open_), F.lit(True))
    return every.select("reader", (F.coalesce("a", zero) + F.coalesce("b", zero) + F.col("c") + F.coalesce("d", zero)).alias("visible")).where("visible > 0")


#: Seconds that a code counts.
CODE_SECONDS = 600


def checked_codes(rows: DataFrame, who: str, at: str, order: str) -> DataFrame:
    """Entries of codes with their result: none, expired, wrong or ok, by the last code issued before.

    Rows with ``issued`` send a code, the others enter one. A code ends CODE_SECONDS after the whole second (since 1970)
    nearest to its time, the even one of two; rows without a time are the last.
    """
    w = Window.partitionBy(who).orderBy(F.asc_nulls_last(at), F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000
    last = lambda c: F.last(F.when(F.col("issued"), c), ignorenulls=True).over(w)
    known = rows.withColumn("__ends", last(F.rint(seconds) + CODE_SECONDS)).withColumn("__code", last(F.col("code"))).where(~F.col("issued"))
    late = seconds > F.col("__ends")
    return known.withColumn("result", F.when(F.col("__ends").isNull(), "none").when(late, "expired").when(F.col("__code") != F.col("code"), "wrong").otherwise("ok")).drop("__ends", "__code")


def checkout_refusal(active: Column, plan: Column, price: Column) -> Column:
    """Why a checkout is refused, null if it is not: who pays already manages the plan, and plans must be known and cost something."""
    return F.when(active, "manage").when(plan.isNull(), "unknown").when(price.isNull(), "free")
