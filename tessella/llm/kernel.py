"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. Each whole text becomes the STATISTICS, whole numbers in units of 1 / UNIT, in one pass over the texts. Nothing but
   the text goes into them.
2. Statistics are standardised by the labelled rows and projected on FEATURES random directions; cosines of
   those approximate a Gaussian kernel. Projections and cosines are rounded to a grid, so every sum is exact
   in whole numbers and the model is the same however rows are dealt.
3. Each partition of labelled rows adds up its part of the normal equations, fold by fold; Spark adds the parts row
   by row. To the driver come FOLDS * (FEATURES + 2) rows, whatever the number of labels; it solves for each
   penalty and takes that of the least squared error on left-out folds, which the same sums give.
4. Scores of left-out folds, in bins of 1 / BINS, are fitted by pooled neighbours (isotonic regression); a document's score is
   read between the centres of the pools, and a thousandth of it is the ridge score itself, so that order inside a pool
   is kept.

Only rows for which ``held_out`` is false are learnt from: crc32 of doc_id as text modulo 4 is not 2.

Defined cases: a null or empty text has statistics too (all 0) and a score; a null label is no label, of several labels
of a document the lowest counts; a null doc_id is scored, not held out, and has no label; repeated rows count each by itself;
without labels every score is 0.5; without documents the result is empty; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

from . import textcore

U64 = np.uint64
UNIT = 1 << 16
FEATURES = 384
FOLDS = 3
#: Width of the kernel in standard deviations, by the root of the number of statistics.
WIDTH = 1.5
#: Penalties tried, by labelled row.
PENALTIES = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2)
#: Cosines are rounded to this part of one, and directions and standardised values to this.
GRID, FINE = 1 << 10, 1 << 12
BINS = 1024
THRESHOLD = 0.7
SEED = 20_177

STATISTICS = ("chars", "words", "word_length", "longest_word", "capitals", "wide", "digits", "stops", "marks", "symbols", "bars", "distinct", "repeated", "neighbours", "lines", "equal_lines", "lone_lines")


def _is(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


SMALL, CAPITAL, DIGIT, STOP, MARK, BAR = (_is(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", "!?;:", "|"))
SYMBOL = _is("#$%&*+/<=>@\\^_`{}~[]")
WIDE = np.arange(256) >= 0xC0  # first bytes of characters beyond ASCII
LATER = (np.arange(256) & 0xC0) == 0x80


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _fresh(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys of each row: how many are distinct, and how many are there more than once."""
    mixed = textcore.mix(keys + textcore.mix(owner.astype(U64) + U64(1)))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return np.bincount(owner[order[first]], minlength=rows), np.bincount(owner[order[~alone]], minlength=rows)


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, STATISTICS) of whole texts, whole numbers."""
    data, offsets = textcore.string_bytes(column)
    rows = len(offsets) - 1
    owner_of = np.arange(rows)
    starts, ends, bounds = textcore.word_spans(data, offsets)
    n = np.diff(bounds)
    owner = np.repeat(owner_of, n)
    hashes = textcore.word_hashes(data, starts, ends)
    chars = np.diff(offsets) - _sums(LATER[data], offsets)
    small, capital, wide, digit, stop, mark, symbol, bar = (_sums(x[data], offsets) for x in (SMALL, CAPITAL, WIDE, DIGIT, STOP, MARK, SYMBOL, BAR))
    distinct, _ = _fresh(hashes, owner, rows)
    if len(hashes) > 2:
        together = (owner[2:] == owner[:-2]).nonzero()[0]
        runs = textcore.mix(hashes[together] * U64(textcore.LANES[0]) + hashes[together + 1] * U64(textcore.LANES[1]) + hashes[together + 2] * U64(textcore.LANES[2]))
        _, repeated = _fresh(runs, owner[together], rows)
    else:
        repeated = np.zeros(rows, dtype=np.int64)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) if len(hashes) else np.zeros(0, dtype=bool)
    neighbours = np.bincount(owner[1:][same], minlength=rows) if len(hashes) else np.zeros(rows, dtype=np.int64)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, owner, ends - starts)
    # Lines: a word is the first of its line if a line feed or the text's start is between it and the word before.
    feeds = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    at = feeds[starts]
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(head)
    with_words = np.bincount(owner[places], minlength=rows)
    if len(places):
        positions = np.arange(len(hashes)) - np.repeat(places, np.diff(np.append(places, len(hashes))))
        line = np.add.reduceat(textcore.mix(hashes + textcore.mix(positions.astype(U64))), places, dtype=U64)
        unlike, _ = _fresh(line, owner[places], rows)
        lone = np.bincount(owner[places][np.diff(np.append(places, len(hashes))) == 1], minlength=rows)
    else:
        unlike = lone = np.zeros(rows, dtype=np.int64)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Square roots, so that little is seen too."""
        return np.sqrt(np.minimum(part / np.maximum(whole, 1), 4.0))

    letters = small + capital
    values = (
        np.log1p(chars), np.log1p(n), np.log1p(chars / np.maximum(n, 1)), np.log1p(longest), share(capital, letters), share(wide, chars), share(digit, chars), share(stop, n), share(mark, n), share(symbol, n), share(bar, n),
        share(n - distinct, n), share(repeated, n), share(neighbours, n), np.log1p(n / np.maximum(with_words, 1)), share(with_words - unlike, with_words), share(lone, with_words),
    )
    return np.rint(np.stack(values, axis=1) * UNIT).astype(np.int64)


def _statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textcore.slices(whole, "text"):
            values = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in values.T]], names=["doc_id", *STATISTICS])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, held_out and fold of every document, a written table."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_statistics_task, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % FOLDS
    return materialise(found.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("fold", F.coalesce(fold, F.lit(0)).cast("int")), "statistics")


class Projection:
    """Standardised statistics to cosines on the grid."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.deviation = mean, deviation
        self.directions = np.rint(draw.standard_normal((d, features)) / (width * np.sqrt(d)) * FINE)
        self.shift = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """(rows, features + 1), whole numbers as doubles; the last is the constant."""
        x = np.rint(np.clip((values - self.mean) / self.deviation, -8, 8) * FINE)
        z = np.rint(GRID * np.cos((x @ self.directions) / (FINE * FINE) + self.shift))
        return np.concatenate([z, np.full((len(z), 1), float(GRID))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(s))) for s in STATISTICS], axis=1)


def _equations_task(shared):
    """(fold, i, values): row i of the sums of products of a partition; the last row has those with the label, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, sums = shared.value, {}
        for batch in batches:
            folds, labels = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("fold", "good"))
            z = project(_matrix(batch))
            z = np.concatenate([z, labels[:, None] * float(GRID)], axis=1)
            for f in np.unique(folds):
                own = z[folds == f]
                sums[f] = sums.get(f, 0) + own.T @ own
        for f, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["fold", "i", "values"])

    return run


def _add_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for f, i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            row = np.asarray(values.values)
            sums[f, i] = sums[f, i] + row if (f, i) in sums else row.copy()
    for (f, i), row in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.int64()))], names=["fold", "i", "values"])


EQUATIONS = "fold int, i int, values array<long>"


def equations(labelled: DataFrame, project: Projection) -> np.ndarray:
    """(FOLDS, n, n) sums of products of the features, the constant and the label over the labelled rows."""
    shared = labelled.sparkSession.sparkContext.broadcast(project)
    parts = labelled.mapInArrow(_equations_task(shared), EQUATIONS)
    rows = parts.repartition("fold", "i").mapInArrow(_add_task, EQUATIONS).collect()
    n = len(project.shift) + 2
    out = np.zeros((FOLDS, n, n))
    for r in rows:
        out[r["fold"], r["i"]] = r["values"]
    return out / float(GRID * GRID)


def solved(total: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights of features and constant; the constant is not punished."""
    n = len(total) - 1
    punish = np.full(n, penalty * total[n - 1, n - 1])
    punish[n - 1] = 1e-9
    return np.linalg.solve(total[:n, :n] + np.diag(punish), total[:n, n])


def fit(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights on all rows, weights without each fold), with the penalty of the least squared error on left-out folds."""
    total = sums.sum(axis=0)

    def error(penalty: float) -> float:
        out = 0.0
        for own in sums:
            w = np.append(solved(total - own, penalty), -1.0)
            out += w @ own @ w
        return out

    filled = all(own[-2, -2] > 0 for own in sums)
    penalty = min(PENALTIES, key=error) if filled else PENALTIES[-1]
    whole = solved(total, penalty)
    return whole, np.stack([solved(total - own, penalty) if filled else whole for own in sums])


def _ridge_task(shared):
    """Add ``ridge``: by the weights without the row's own fold if it was learnt from (``good`` is there), else by all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, weights = shared.value
        for batch in batches:
            z = project(_matrix(batch)) / GRID
            pick = np.asarray(batch.column(batch.schema.get_field_index("model")))
            ridge = np.empty(len(z))
            for k in np.unique(pick):
                ridge[pick == k] = np.rint((z[pick == k] @ weights[k]) * (1 << 30)) / (1 << 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "good")), pa.array(ridge)], names=["doc_id", "held_out", "good", "ridge"])

    return run


RIDGE = "doc_id long, held_out boolean, good int, ridge double"


def isotonic(bins: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, shares) of the pools of neighbouring bins whose shares of good rows fall nowhere."""
    pools: list[list[float]] = []
    for b, count, g in sorted(zip(bins.tolist(), n.tolist(), good.tolist(), strict=True)):
        pools.append([b * count, count, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([(p[0] / p[1] + 0.5) / BINS for p in pools]), np.array([p[2] / p[1] for p in pools])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    every = described(docs)
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).cast("int").alias("good"))
    labelled = materialise(every.where("not held_out").join(known, "doc_id"), "labelled")
    exact = [f(F.col(s).cast("decimal(38,0)")).alias(f"{s}_{i}") for s in STATISTICS for i, f in enumerate((F.sum, lambda c: F.sum(c * c)))]
    first = labelled.agg(F.count("*").alias("n"), *exact).first()
    if not first["n"]:
        return every.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    n = first["n"]
    mean = np.array([int(first[f"{s}_0"]) / n for s in STATISTICS])
    square = np.array([(n * int(first[f"{s}_1"]) - int(first[f"{s}_0"]) ** 2) / n**2 for s in STATISTICS])
    project = Projection(mean, np.sqrt(np.maximum(square, 0)) + UNIT / 1000)
    whole, without = fit(equations(labelled, project))
    shared = spark.sparkContext.broadcast((project, np.stack([*without, whole])))
    left_out = labelled.withColumn("model", F.col("fold")).mapInArrow(_ridge_task(shared), RIDGE)
    bin_ = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "ridge")) * BINS).cast("int")
    counts = left_out.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("good").alias("good")).toPandas()
    centres, shares = isotonic(counts["bin"].to_numpy(), counts["n"].to_numpy(), counts["good"].to_numpy())
    ridge = every.withColumn("good", F.lit(None).cast("int")).withColumn("model", F.lit(FOLDS)).mapInArrow(_ridge_task(shared), RIDGE)
    table = spark.sparkContext.broadcast((centres, shares))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = table.value
        for batch in batches:
            r = np.asarray(batch.column(3))
            score = 0.999 * np.interp(r, at, value) + 0.001 * np.clip((r + 1) / 3, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return ridge.mapInArrow(calibrate, "doc_id long, held_out boolean, score double, predicted int")
