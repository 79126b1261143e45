"""Overlapping chunks of texts and sheets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text
from tessella.session import materialise

PUBLIC_SIZE, PRIVATE_SIZE, SHARE = 2200, 1800, 0.15


def units(content: Column, size: int) -> Column:
    """Paragraphs; those over ``size`` as sentences; sentences over it in slices."""
    sliced = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(size)), lambda i: F.substr(s, i, F.lit(size))))
    cut = lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.flatten(F.transform(text.sentences(p), sliced)))
    return F.flatten(F.transform(text.paragraphs(content), cut))


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Fold units into chunks. A chunk that would pass ``size`` is closed, and its last units are carried until they reach ``overlap``.

    The room a unit needs is taken before the carry, so after one its separator counts twice;
    a chunk may thus hold more or less than ``size``.
    """
    out: list[str] = []
    open_, length = [], 0
    for part in parts:
        room = len(part) + 2 * bool(open_)
        if length and length + room > size:
            out.append("\n\n".join(open_))
            carry, length = 0, 0
            while carry < len(open_) and length < overlap:
                carry += 1
                length += len(open_[-carry]) + 2
            open_ = open_[len(open_) - carry :]
        open_.append(part)
        length += room
    return [*out, "\n\n".join(open_)] if open_ else out


def chunk_lists(docs: DataFrame, key: str, column: str = "text", size: int = PUBLIC_SIZE, *more: str, plain: str | None = None) -> DataFrame:
    """(key, ``more``, chunks): the sanitised chunks of each text, those of nothing but spaces left out.

    Units are cut by Catalyst; only the fold, which goes back over what it has taken, is Python. Texts that are
    ``plain`` (a column, if it is known) are not cleaned, nor are their chunks.
    """
    overlap = int(size * SHARE + 0.5)
    known = docs.select(key, *more, F.coalesce(F.col(column), F.lit("")).alias("__text"), *([F.col(plain).alias("__plain")] if plain else []))
    if not plain:
        known = known.withColumn("__plain", text.plain(F.col("__text")))
    schema = known.select(key, *more, "__plain", F.array(F.lit("")).alias("chunks")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = [packed(u, size, overlap) for u in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(chunks, pa.list_(pa.string()))], names=schema.names)

    whole = F.coalesce(text.sanitised(F.when(~F.col("__plain"), F.col("__text"))), F.col("__text"))
    # A text without any unit is one, of white space at most, which is left out below.
    rows = known.select(key, *more, "__plain", units(whole, size).alias("__units")).mapInArrow(fold, schema)
    again = F.when(F.col("__plain"), F.col("chunks")).otherwise(F.transform("chunks", lambda c: text.cleaned(c)))
    return rows.select(key, *more, F.filter(again, lambda c: c.rlike(r"[^\p{Zs}]")).alias("chunks"))


def chunked(docs: DataFrame, key: str, column: str = "text", size: int = PUBLIC_SIZE) -> DataFrame:
    """(key, chunk_index, text): ``chunk_lists`` with a row for each chunk, indexes without gaps."""
    return chunk_lists(docs, key, column, size).select(key, F.posexplode("chunks").alias("chunk_index", "text"))


def row_text(headers: list[str], values: Column) -> Column:
    """``Header: value | ...``; a blank header is named by its place."""
    named = [h or f"Col{i + 1}" for i, h in enumerate(headers)]
    return F.array_join(F.zip_with(F.array(*map(F.lit, named)), values, lambda h, v: F.concat(h, F.lit(": "), F.coalesce(v, F.lit("")))), " | ")


#: Rows of a slice of a sheet; slices are worked on at the same time.
SLICE = 4096


class _Slice:
    """The rows of a slice as sizes, and what a bucket that starts at one of them leads to.

    ``ends[j]`` is how long a bucket from the slice's start would be with row j, so the bucket that starts at row s closes before the
    first row past ``limit + length before s``. All are found by one search, and followed from the back.
    """

    def __init__(self, sizes: np.ndarray, limit: int):
        self.limit, self.n = limit, len(sizes)
        self.before = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.ends = self.before[1:] - 1
        following = np.maximum(np.searchsorted(self.ends, limit + self.before[:-1], side="right"), np.arange(self.n) + 1)
        self.following = following.tolist()

    def ways(self) -> tuple[list[int], list[int], list[int]]:
        """For a first break at each row that may be one: ends up to it, characters that go on, and breaks."""
        rest, breaks = [0] * self.n, [0] * self.n
        for s in range(self.n - 1, -1, -1):
            to = self.following[s]
            rest[s], breaks[s] = (int(self.before[-1] - self.before[s]), 1) if to >= self.n else (rest[to], breaks[to] + 1)
        last = min(self.n - 1, max(self.following[0], int(np.searchsorted(self.ends, self.limit, side="right"))))
        return self.ends[: last + 1].tolist(), rest[: last + 1], breaks[: last + 1]


def _after(chars: int, limit: int, total: int, following: int, ends: list[int], rest: list[int], breaks: list[int]) -> tuple[int, int]:
    """(characters that go on, breaks) of a slice that a bucket enters with ``chars``."""
    k = following if chars == 0 else bisect_right(ends, limit - chars)
    return (rest[k], breaks[k]) if k < len(rest) else (chars + total, 0)


def row_buckets(rows: DataFrame, sheet: list[str], order: list[str], size: str, limit: int, *more: str, block: int = SLICE) -> DataFrame:
    """The rows of sheets with their bucket and place: a bucket closes when the next row would pass the limit.

    Row numbers start at 2, under the header. Which bucket a row is in depends on all rows before it, yet no task reads a
    whole sheet: rows are dealt by ranges of (sheet, order) and cut into slices; each says for every length that a bucket may
    bring along what it leaves to the next; one row a slice is followed through the sheet; then slices are filled in.
    Columns: the sheet's, ``more``, row, bucket and chars (of the bucket up to the row).
    """
    place = [*sheet, *order]
    kept = list(dict.fromkeys([*place, *more, size]))
    ranged = rows.select(*kept).repartitionByRange(*place).sortWithinPartitions(*place).withColumn("__id", F.monotonically_increasing_id())
    slices = [F.shiftright("__id", 33).alias("__part"), F.floor(F.col("__id").bitwiseAND((1 << 33) - 1) / block).cast("long").alias("__slice")]
    every = materialise(ranged.select("*", *slices), "sheet-rows")
    fields = [every.schema[c] for c in sheet]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    own = [T.StructField(n, long) for n in ("__part", "__slice", "__first")]

    def sheets_in(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ordered = frame.sort_values("__id")
        yield from (part for _, part in ordered.groupby(sheet, dropna=False, sort=False))

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in sheets_in(frame):
            one = _Slice(part[size].to_numpy(dtype=np.int64), limit)
            head = part.iloc[0]
            out.append((*(head[c] for c in sheet), head["__part"], head["__slice"], head["__id"], one.n, int(one.before[-1]), one.following[0], *one.ways()))
        return pd.DataFrame(out, columns=[f.name for f in says.fields])

    says = T.StructType([*fields, *own, *[T.StructField(n, long) for n in ("n", "total", "following")], *[T.StructField(n, longs) for n in ("ends", "rest", "breaks")]])
    parts = every.select(*sheet, size, "__id", "__part", "__slice").groupBy("__part", "__slice").applyInPandas(told, says)

    def followed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, bucket, chars = object(), 1, 0, 0
        for f in frames:
            keys = f[sheet].astype(object).where(f[sheet].notna(), None).itertuples(index=False, name=None)
            out = []
            for key, r in zip(keys, f.itertuples(index=False, name=None), strict=True):
                part, slice_, first, n, total, following, ends, rest, breaks = r[len(sheet) :]
                if key != now:
                    now, number, bucket, chars = key, 1, 0, 0
                out.append((part, slice_, first, number, bucket, chars))
                chars, more_ = _after(chars, limit, int(total), int(following), list(ends), list(rest), list(breaks))
                number, bucket = number + int(n), bucket + int(more_)
            yield pd.DataFrame(out, columns=[f.name for f in enters.fields])

    enters = T.StructType([*own, *[T.StructField(n, long) for n in ("number", "bucket", "chars")]])
    entries = parts.repartition(*sheet).sortWithinPartitions(*sheet, "__part", "__slice").mapInPandas(followed, enters)

    def filled(frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        at = {f: (n, b, c) for f, n, b, c in zip(given["__first"], given["number"], given["bucket"], given["chars"], strict=True)}
        out = []
        for part in sheets_in(frame):
            number, bucket, chars = at[part["__id"].iloc[0]]
            numbers, buckets, lengths = [], [], []
            for n in part[size].tolist():
                number += 1
                if chars and chars + n > limit:
                    bucket, chars = bucket + 1, 0
                chars += n + 1
                numbers.append(number)
                buckets.append(bucket)
                lengths.append(chars)
            out.append(part[[*sheet, *more]].assign(row=numbers, bucket=buckets, chars=lengths))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.name for f in schema.fields])

    schema = T.StructType([*fields, *[every.schema[c] for c in more], *[T.StructField(n, long) for n in ("row", "bucket", "chars")]])
    key = ["__part", "__slice"]
    return every.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(filled, schema)


def sheet_chunks(sheets: DataFrame, limit: int = PUBLIC_SIZE) -> DataFrame:
    """(path, place, chunk, text, row_range) of the rows of ``files.sheets``: each chunk repeats file, sheet and columns.

    A sheet of a header alone gives one chunk that says so, an empty sheet none.
    """
    key = ["path", "place"]
    columns = F.concat(F.lit("Columns: "), F.array_join("headers", ", "))
    head = F.concat(F.lit("Workbook: "), "filename", F.lit("\nSheet: "), "sheet", F.lit("\n"), columns, F.lit("\n\n"))
    header = sheets.where("row = 1").withColumn("headers", F.transform("values", lambda v: F.trim(v))).select(*key, "headers", head.alias("head"))
    line = F.array_join(F.transform(F.arrays_zip("headers", "values"), lambda x, i: F.concat(F.coalesce(F.nullif(x["headers"], F.lit("")), F.concat(F.lit("Col"), (i + 1).cast("string"))), F.lit(": "), F.coalesce(x["values"], F.lit("")))), " | ")
    body = sheets.where("row > 1").select(*key, F.col("row").alias("at"), "values").join(header.drop("head"), key).withColumn("line", line).withColumn("n", F.length("line"))
    placed = row_buckets(body, key, ["at"], "n", limit, "line")
    parts = placed.groupBy(*key, F.col("bucket").alias("chunk")).agg(F.min("row").alias("a"), F.max("row").alias("b"), F.sort_array(F.collect_list(F.struct("row", "line"))).alias("r"))
    rows = F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))
    full = parts.join(header, key).select(*key, "chunk", F.concat("head", F.lit("Rows "), rows, F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"), rows.alias("row_range"))
    bare = header.join(sheets.where("row > 1").select(*key).distinct(), key, "left_anti")
    return full.unionByName(bare.select(*key, F.lit(0).cast("long").alias("chunk"), F.concat("head", F.lit("(No data rows)")).alias("text"), F.lit(None).cast("string").alias("row_range")))
