"""Importance resampling towards a target distribution over hashed word runs.

Features are all runs of 1 to ``longest`` words, hashed into BUCKETS buckets by CRC-32. A bucket's gain is the
logarithm of its smoothed share in the target over that in the documents; a document's weight is
the sum of the gains of its features, and the highest weights after Gumbel noise are drawn, which samples
without replacement by weight.

1. Each task hands its documents, some megabytes at a time, to a DuckDB of its own: SQL cuts words, unnests
   them and looks ahead by a window. A registered function gives zlib's CRC-32 of each distinct word, a second
   one that of a longer run from those of its parts, so runs are never built as strings.
2. The bucket counts of every document are spilled to Parquet in the shared folder, so texts are read once.
3. Spark sums them by bucket; the gains, BUCKETS numbers, go to every task, which scores the spilled counts.
4. Ranks come from ranges of scores: rows are numbered within their range and the sizes of the ranges before are added.

Defined cases: a null or empty text, or one without words, has no features and weight 0; repeated rows are scored each by
itself; a row with a null doc_id counts in the corpus but has no score and is never drawn; without documents the
result is empty, without a target all of its counts are 0; other columns are left out. DuckDB holds one slice
of texts at a time, or one text if it is longer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise

from .crc import ONES, crc32_sql, crc_table_sql
from .textcore import slices

BUCKETS = 10_000
LONGEST = 3
#: Fixed value: what separates words, once A to Z are small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = [c for c in range(128) if not chr(c).isalnum()]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def _zlib_crc(text: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each text."""
    return pa.array(list(map(crc32, text.cast(pa.binary()).to_pylist())), pa.uint32())


@cache
def _shift(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a CRC, as four tables by byte: the CRC of a text and of what follows it add up by this."""
    one = np.array([crc32(bytes(n), bit ^ ONES) ^ ONES ^ crc32(bytes(n), ONES) ^ ONES for bit in (1 << np.arange(32)).tolist()], dtype=np.uint32)
    tables = np.zeros((4, 256), dtype=np.uint32)
    for k in range(32):
        tables[k // 8, (np.arange(256) >> (k % 8)) & 1 == 1] ^= one[k]
    return tables


#: Tables of the usual lengths; longer words have theirs made when they come.
USUAL = np.stack([_shift(n) for n in range(64)])


def _crc_join(before: pa.Array, after: pa.Array, length: pa.Array) -> pa.Array:
    """The CRC-32 of two texts in a row from those of both and the second's length in bytes."""
    crc, add, n = (np.asarray(x) for x in (before, after, length))
    tables, at = USUAL, n
    if len(n) and n.max() >= len(USUAL):
        sizes, at = np.unique(n, return_inverse=True)
        tables = np.stack([_shift(int(k)) for k in sizes])
    parts = [tables[at, k, (crc >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return pa.array(add ^ parts[0] ^ parts[1] ^ parts[2] ^ parts[3])


def counting_sql(longest: int = LONGEST, buckets: int = BUCKETS) -> list[str]:
    """Of the rows of ``given`` (nth, text): their words, the distinct words, (nth * buckets + bucket, n), and (nth, n_words)."""
    ahead = "".join(f", lead(after, {k}) OVER near AS after{k}, lead(bytes, {k}) OVER near AS bytes{k}" for k in range(1, longest))
    steps = "SELECT *, own AS h0 FROM windows"
    for k in range(1, longest):
        steps = f"SELECT *, crc_join(h{k - 1}, after{k}, bytes{k}) AS h{k} FROM ({steps})"
    every = ", ".join(f"h{k} % {buckets}" for k in range(longest))
    between = "chr(0) || '" + "".join(map(chr, SEPARATORS[1:])).replace("'", "''") + "'"
    cut = f"string_split(translate(text, '{CAPITALS}' || {between}, '{SMALL}{' ' * len(SEPARATORS)}'), ' ')"
    return [
        f"CREATE OR REPLACE TEMP TABLE words AS SELECT * FROM (SELECT nth, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT nth, {cut} AS w FROM given)) WHERE word <> ''",
        f"CREATE OR REPLACE TEMP TABLE known AS SELECT word, own, crc_join({crc32(b' ')}::UINTEGER, own, strlen(word)::UINTEGER) AS after, (strlen(word) + 1)::UINTEGER AS bytes FROM (SELECT word, zlib_crc(word) AS own FROM (SELECT DISTINCT word FROM words))",
        f"""WITH windows AS (SELECT nth, own{ahead} FROM words JOIN known USING (word) WINDOW near AS (PARTITION BY nth ORDER BY place))
SELECT nth * {buckets} + bucket AS key, count(*) AS n FROM (SELECT nth, unnest([{every}]) AS bucket FROM ({steps})) WHERE bucket IS NOT NULL GROUP BY key ORDER BY key""",
        "SELECT nth, count(*) AS n FROM words GROUP BY nth",
    ]


def _count_task(longest: int, buckets: int):
    words, known, features, sizes = counting_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.create_function("zlib_crc", _zlib_crc, ["VARCHAR"], "UINTEGER", type="arrow")
        con.create_function("crc_join", _crc_join, ["UINTEGER", "UINTEGER", "UINTEGER"], "UINTEGER", type="arrow")
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = batch.num_rows
                con.register("given", pa.table({"nth": pa.array(np.arange(rows)), "text": batch.column(1)}))
                con.execute(words)
                con.execute(known)
                found, each = con.sql(features).fetchnumpy(), con.sql(sizes).fetchnumpy()
                con.unregister("given")
                n_words = np.zeros(rows, dtype=np.int64)
                n_words[each["nth"]] = each["n"]
                at = np.searchsorted(found["key"], np.arange(rows + 1) * buckets).astype(np.int32)
                sums = np.concatenate([[0], np.cumsum(found["n"])])
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (found["key"] % buckets, found["n"])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(sums[at[1:]] - sums[at[:-1]]), *lists], names=["doc_id", "n_words", "n_features", "buckets", "counts"])
        con.close()

    return run


def counted(docs: DataFrame, label: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Bucket counts of every document (doc_id, text), a written table."""
    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_task(longest, buckets), COUNTED), label)


def totals(spilled: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features by bucket."""
    rows = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).collect()
    found = {r["buckets"]: r["n"] for r in rows}
    return [found.get(b, 0) for b in range(buckets)]


def gains(documents: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket, in doubles, rounded down to thousandths."""
    n = float(len(documents))
    own, aim = float(sum(documents)) + n, float(sum(target)) + n
    return [math.floor(1000 * math.log((float(t) + 1) * own / ((float(s) + 1) * aim))) for s, t in zip(documents, target, strict=True)]


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(shared.value, dtype=np.int64)
        for batch in batches:
            lists, counts = batch.column(3), batch.column(4)
            at = np.asarray(lists.offsets)
            products = gain[np.asarray(lists.values)[at[0] : at[-1]]] * np.asarray(counts.values)[np.asarray(counts.offsets)[0] :][: at[-1] - at[0]]
            sums = np.concatenate([[0], np.cumsum(products)])
            weight = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from its doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add rank to the ``percent`` of the documents of ``least_words`` words with the highest scores."""
    fit = scored.withColumn("fit", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    nth = F.monotonically_increasing_id()
    numbered = materialise(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__nth", nth), "ranges")
    part, place = F.shiftright("__nth", 33), F.col("__nth").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fit"))  # one row a range
    before = sizes.select("__part", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    most = sizes.agg(F.floor(F.sum("fit") * percent / 100).alias("__most"))
    placed = numbered.withColumn("__part", part).join(F.broadcast(before), "__part", "left").join(F.broadcast(most))
    rank = F.coalesce("__before", F.lit(0)) + place + 1
    return placed.withColumn("rank", F.when(F.col("fit") & (rank <= F.col("__most")), rank)).drop("__nth", "__part", "__before", "__most", "fit")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    ``target`` has a column ``text``.
    """
    spilled = counted(docs, "bucket-counts", longest, buckets)
    aims = counted(target.select(F.lit(0).alias("doc_id"), "text"), "target-counts", longest, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains(totals(spilled, buckets), totals(aims, buckets)))
    weights = spilled.mapInArrow(_score_task(shared), "doc_id long, n_words long, n_features long, weight long")
    scored = materialise(weights.withColumn("score", (F.col("weight") + noise(seed)).cast("long")), "scores")
    return drawn(scored, percent, least_words)


def resample_sql() -> str:
    """The query's rows over the views ``documents`` and ``benchmark``."""
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}')"
    runs = "[w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]"
    return f"""
WITH {crc_table_sql()},
d AS (SELECT row_number() OVER () AS nth, doc_id, {cut} AS w FROM documents),
b AS (SELECT {cut} AS w FROM benchmark),
df AS (SELECT nth, unnest({runs}) AS f FROM (SELECT nth, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
bf AS (SELECT unnest({runs}) AS f FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b)),
known AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df WHERE f IS NOT NULL UNION SELECT f FROM bf WHERE f IS NOT NULL), crc_table),
dc AS (SELECT nth, bucket, count(*) AS n FROM df JOIN known USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM dc GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN known USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT nth, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dc JOIN gains USING (bucket) GROUP BY nth),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weights USING (nth)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 AND score IS NOT NULL DESC, score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (n_words >= 20 AND score IS NOT NULL) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND score IS NOT NULL AND place <= n * 5 // 100 THEN place END AS rank FROM ranked"""
