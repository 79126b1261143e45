"""Improbable-feature digests: Bloom filters of a text's rare byte windows.

Every run of WINDOW bytes is a feature. Its entropy is kept while the window slides: a byte
that enters or leaves changes the sum of ``n log n`` by a step that depends on how often it
is in the window, which WINDOW - 1 comparisons of the text with itself shifted give for all bytes
at once. Windows of very low entropy (runs of one character) and the very highest (noise) are
no features. Among the rest rarity is the distance from the usual entropy of prose, so improbable
windows have low ranks; a feature is selected that is the lowest, first on ties, in at
least POPULAR of the spans of SPAN neighbouring features (a text with no such window gives its lowest). Selected features, in text order and
without those the current filter already holds, go into Bloom filters of BITS bits with HASHES bits each;
a filter that holds CAPACITY features is closed and the next is chained.

Two digests compare by their filters: for every filter of the shorter digest the best likeness
to a filter of the other is taken, and these are averaged. The likeness of two filters is the
share of common bits above what chance gives, from 0 to 1.

A text is a function of its bytes alone, so equal texts have equal fingerprints. Texts shorter
than a window are one feature; null and empty texts have the empty digest, which is alike (1)
to itself and unlike (0) any other.

For the query of edits, a document is paired with the next one by descending doc_id. Documents
are dealt by ranges of doc_id that hold about as many bytes each, a range to a task, and the first of
every range goes to the range before as well, so each task sees the successor of its last row
without one task seeing all. Null ids come last, of repeated ids that of the greater hash of its text is
first, however many ranges there are; a lone document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import textcore

U64 = np.uint64
WINDOW = 32
SPAN = 32
POPULAR = 4
BITS = 2048
HASHES = 5
CAPACITY = 160
#: Entropies are whole thousandths of the greatest possible one; features lie between these.
LOWEST, HIGHEST = 100, 990
#: The usual entropy of prose in such windows.
USUAL = 720
#: Cells of doc_id, at most, of which ranges are made, and bytes of text of a range where cells allow; a task reads its range row by row.
MOST_CELLS = 10_000
RANGE_BYTES = 16 << 20
#: Bytes worked on at a time, so that the comparisons stay in the processor's cache.
STRIP = 1 << 16

_COUNT = np.arange(WINDOW + 2, dtype=np.float64)
#: n log2 n in units of 2 ** -20, whole so that sums are exact in any order.
_WEIGHT = np.rint(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_WEIGHT)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, in thousandths of log2(WINDOW), of every window of the bytes."""
    n = len(data)
    before = np.zeros(n, dtype=np.uint8)  # equal bytes among the WINDOW - 1 before
    after = np.zeros(n, dtype=np.uint8)
    for at in range(0, n, STRIP):
        stop = min(n, at + STRIP)
        for k in range(1, min(WINDOW, n)):
            low = max(at, k)
            if low >= stop:
                break
            same = (data[low:stop] == data[low - k : stop - k]).view(np.uint8)
            before[low:stop] += same
            after[low - k : stop - k] += same
    total = np.cumsum(_STEP[before[:WINDOW]])[-1:]
    if n > WINDOW:
        # The window moves on: one byte leaves, which is there as often as it follows in it, then one enters.
        change = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
        total = np.concatenate([total, total[0] + np.cumsum(change)])
    size = min(n, WINDOW)
    bits = np.log2(size) - total / ((1 << 20) * size)
    return np.rint(1000 * bits / np.log2(WINDOW)).astype(np.int64)


def selected(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the selected windows of texts that follow each other, ascending.

    Sums and minima run over all texts at once; what crosses from one into the next is masked.
    """
    sizes = np.diff(offsets)
    short = offsets[:-1][(sizes > 0) & (sizes <= WINDOW)]
    n = len(data) - WINDOW + 1
    if n < 1 or not (sizes > WINDOW).any():
        return short
    entropy = entropies(data)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = owner[:n] == owner[WINDOW - 1 :]
    usable = whole & (entropy >= LOWEST) & (entropy <= HIGHEST)
    rank = np.where(usable, 1000 - np.abs(entropy - USUAL), 1 << 20)
    least = (rank << 40) | np.arange(n)
    have = 1
    while have < min(SPAN, n):
        step = min(have, min(SPAN, n) - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # Spans of features of one text; a text of fewer features than a span has none and takes its best.
    inside = owner[: len(least)] == owner[have + WINDOW - 2 : have + WINDOW - 2 + len(least)]
    winners = np.bincount(least[inside] & ((1 << 40) - 1), minlength=n)
    starts = np.flatnonzero((winners >= POPULAR) & usable)
    few = np.flatnonzero((sizes > WINDOW) & (np.bincount(owner[starts], minlength=len(sizes)) == 0))
    best = [int(offsets[k] + np.argmin(rank[offsets[k] : offsets[k + 1] - WINDOW + 1])) for k in few]
    return np.sort(np.concatenate([starts, short, np.array(best, dtype=np.int64)]))


_POWERS = np.array([pow(textcore.BASE, k, 1 << 64) for k in range(WINDOW)], dtype=U64)


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window, which ends at WINDOW bytes or with its text."""
    out = np.empty(len(starts), dtype=U64)
    padded = np.concatenate([data, np.zeros(WINDOW, dtype=np.uint8)])
    for at in range(0, len(starts), 8192):
        s, e = starts[at : at + 8192, None], ends[at : at + 8192, None]
        place = s + np.arange(WINDOW)
        part = np.where(place < e, padded[place].astype(U64) + U64(1), U64(0))
        out[at : at + 8192] = textcore.mix((part * _POWERS).sum(axis=1, dtype=U64))
    return out


def chain(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (rows of BITS / 64 words) and their numbers of features."""
    filters, counts, at = [], [], 0
    while at < len(hashes):
        # The next CAPACITY distinct features; what the filter holds already costs no room.
        ahead = hashes[at : at + 4 * CAPACITY]
        first = np.sort(np.unique(ahead, return_index=True)[1])
        stop = int(first[CAPACITY]) if len(first) > CAPACITY else len(ahead)
        own = np.unique(ahead[:stop])
        places = np.concatenate([(own >> U64(11 * k)) & U64(BITS - 1) for k in range(HASHES)]).astype(np.int64)
        bits = np.zeros(BITS, dtype=np.uint8)
        bits[places] = 1
        filters.append(np.packbits(bits, bitorder="little").view(U64))
        counts.append(len(own))
        at += stop
    return np.array(filters, dtype=U64).reshape(-1, BITS // 64), np.array(counts, dtype=np.int64)


def digests(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The filters of each text; a text's do not depend on the texts around it."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = selected(data, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    hashes = feature_hashes(data, starts, np.minimum(starts + WINDOW, offsets[owner + 1]))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [chain(hashes[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]


def to_text(filters: np.ndarray, counts: np.ndarray) -> str:
    """``number of filters:features of each:bits in base 64``."""
    return f"{len(counts)}:{','.join(map(str, counts))}:{base64.b64encode(filters.tobytes()).decode()}"


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    _, counts, bits = fingerprint.split(":")
    return np.frombuffer(base64.b64decode(bits), dtype=U64).reshape(-1, BITS // 64), np.array([int(x) for x in counts.split(",") if x], dtype=np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 1.0 if not len(b[0]) else 0.0
    ones_a, ones_b = (np.bitwise_count(x[0]).sum(axis=1, dtype=np.int64).astype(np.float64) for x in (a, b))
    total = 0.0
    for bits, ones in zip(a[0], ones_a, strict=True):
        common = np.bitwise_count(bits & b[0]).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(ones, ones_b), ones * ones_b / BITS
        # Chance varies; what lies within three deviations of it counts as none.
        floor = np.minimum(chance + 3 * np.sqrt(chance * (1 - np.maximum(ones, ones_b) / BITS)), most - 1)
        total += float(np.max(np.clip((common - floor) / (most - floor), 0, 1)))
    return total / len(a[0])


def edited(own: str, after: str) -> str:
    """The text whose second half gives way to as many first characters of the next one (or all)."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with the fingerprint (replacing a column of that name)."""
    rest = [c for c in docs.columns if c not in (column, "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textcore.slices(whole, column, 1 << 20):
                prints = [to_text(*d) for d in digests([t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()])]
                yield from pa.Table.from_batches([batch]).select(rest).append_column("fingerprint", pa.array(prints, pa.string())).to_batches()

    schema = docs.select(*rest, F.lit("").alias("fingerprint")).schema
    return docs.select(*rest, column).mapInArrow(run, schema)


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one or several ranges, each in order; a guest row ends its range and is only a successor."""
    held = None
    names = [x.split()[0] for x in EDITS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for whole in batches:
        for batch in textcore.slices(whole, "text", 1 << 20):
            rows = [(p, d, t or "", g) for p, d, t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            pairs = []  # (document, its text and digest, the next one's text and digest)
            for (place, doc, text, guest), own in zip(rows, digests([r[2] for r in rows]), strict=True):
                if held is not None and held[0] == place:
                    pairs.append((held[1:], (text, own)))
                held = None if guest else (place, doc, text, own)
            changed = [edited(text, after) for (_, text, _), (after, _) in pairs]
            out = [
                (doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), to_text(*own), to_text(*other), likeness(own, other), likeness(own, next_))
                for ((doc, text, own), (_, next_)), new, other in zip(pairs, changed, digests(changed), strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def balanced(sizes: list[int], ranges: int) -> list[int]:
    """The range of each cell: cells in order, ranges of about equal sums, none of them empty."""
    total, out, seen = max(sum(sizes), 1), [], 0
    for n in sizes:
        now = min(ranges - 1, (2 * seen + n) * ranges // (2 * total))
        out.append(min(max(now, out[-1]), out[-1] + 1) if out else 0)
        seen += n
    return out


def edit_distances(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """EDITS of every document: its fingerprint against its edited text's and the next document's."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = own.sparkSession
    least = ranges or max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = min(MOST_CELLS, 8 * least)
    cuts = own.select(F.percentile_approx("doc_id", [k / cells for k in range(1, cells)], 10 * MOST_CELLS)).first()[0] or []
    rising = spark.sparkContext.broadcast(np.array(sorted(set(cuts)), dtype=np.int64))

    def cell_of(ids: pd.Series) -> np.ndarray:
        """Cell 0 has the greatest ids; a null one counts as the least."""
        return len(rising.value) - np.searchsorted(rising.value, ids.to_numpy(dtype=np.int64), side="right")

    cell = F.pandas_udf(lambda ids: pd.Series(cell_of(ids), dtype="int32"), IntegerType())
    known = own.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("o"), "id", "h")
    # One row a cell comes to the driver.
    rows = sorted(known.groupBy(cell(F.col("id")).alias("cell")).agg(F.max(order).alias("top"), F.sum(F.octet_length("text")).alias("n")).collect(), key=lambda r: r["cell"])
    if not rows:
        return spark.createDataFrame([], EDITS)
    ranges = ranges or max(least, -(-sum(r["n"] for r in rows) // RANGE_BYTES))
    of = balanced([r["n"] for r in rows], ranges)
    place_of = spark.sparkContext.broadcast(dict(zip([r["cell"] for r in rows], of, strict=True)))
    place = F.pandas_udf(lambda ids: pd.Series([place_of.value[c] for c in cell_of(ids).tolist()], dtype="int32"), IntegerType())
    tops: dict[int, tuple] = {}
    for r, p in zip(rows, of, strict=True):
        tops.setdefault(p, tuple(r["top"]))
    # The first of a range is a guest of the range before; that of range 0 is one of the last.
    heads = spark.createDataFrame([(p, (p - 1) % len(tops), *top) for p, top in tops.items()], "hp int, before int, ho boolean, hi long, hh long")
    is_head = (F.col("place") == F.col("hp")) & (F.col("id") == F.col("hi")) & (F.col("h") == F.col("hh")) & (F.col("doc_id").isNotNull() == F.col("ho"))
    marked = known.withColumn("place", place(F.col("id"))).join(F.broadcast(heads), is_head, "left")  # a row for each of at most MOST_CELLS ranges
    at = F.array_compact(F.array(F.struct("place", F.lit(False).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("place"), F.lit(True).alias("guest")))))
    dealt = marked.select(F.explode(at).alias("at"), "doc_id", "h", "text").select("at.place", "doc_id", "h", "text", "at.guest")
    ordered = dealt.repartitionById(len(tops), "place").sortWithinPartitions("place", "guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    return ordered.select("place", "doc_id", "text", "guest").mapInArrow(_edits_task, EDITS)
