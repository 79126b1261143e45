"""Packing of tokenised documents into sequences of a fixed capacity.

A document is its tokens and a closing id; one longer than the capacity is cut into pieces of
the capacity, the last maybe shorter. Which pieces share a sequence depends on their lengths
alone, so the plan is made on the histogram of lengths, which has as many entries as the
capacity however many documents there are:

* pieces above a third of the capacity: at most two fit a sequence. Greedy matching takes the
  longest and gives it the longest partner that still fits;
* shorter pieces, longest first, go to the fullest sequences that have room for them (best
  fit); a new sequence is opened only where none has room.

Both steps work on counts, "so many sequences filled so", thus a hot length is one step. The
plan is a list of patterns; the n-th piece of a length takes the n-th slot of that length.
Numbering the pieces of a length needs only the counts by partition and length.

Defined cases: a null or empty text is the closing id alone, one piece of length 1; repeated
rows are pieces of their own; without documents the result is empty; other columns are left out.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.session import materialise

from . import textcore

#: Distinct words whose ids a task keeps at a time.
WORDS_KEPT = 400_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?*#$%&|<>()[]{}/+=-\"_"]] = True


#: Stands between words that are encoded together.
MARK = b"\x01"


class WordTokens:
    """Token ids of texts from a vocabulary that never joins text across ASCII white space.

    A text is cut there, and between a small ASCII letter and a mark, where the vocabulary's
    pattern always ends a match; every distinct piece goes through the tokenizer once. ASCII
    capitals are made small first, as the vocabulary does itself. A text that holds one of the
    vocabulary's special tokens, which it looks for before all that, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def learn(self, words: list[bytes], together: int = 50) -> None:
        """Encode words, many to a call, told apart by a mark between them."""
        odd = [w for w in words if MARK in w] if MARK in b"".join(words) else []
        plain = [w for w in words if MARK not in w] if odd else words
        lines = [(b" %b " % MARK).join(plain[k : k + together]).decode("utf-8", "replace") for k in range(0, len(plain), together)]
        found = [np.array([*e.ids, self.mark]) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        for w in odd:
            own = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
            found.append(np.append(np.where(own == self.mark, ~own, own), self.mark))  # its own marks turn negative and end no word
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.mark) - np.arange(len(words))
        pool = ids[ids != self.mark]
        sizes = np.diff(ends, prepend=0)
        self.known.update(zip(plain + odd, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.where(pool < 0, ~pool, pool).astype("<u4")])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {k: t for k, t in enumerate(texts) if any(x in t for x in self.special)}
        words, bounds = _words([b"" if k in whole else t.encode("utf-8", "replace") for k, t in enumerate(texts)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.forget()
            new = distinct
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[np.asarray(coded.indices)]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        parts = ends[bounds].tolist()
        return [np.array(self.tokenizer.encode(whole[k], add_special_tokens=False).ids, dtype="<u4") if k in whole else ids[parts[k] : parts[k + 1]] for k in range(len(texts))]


def _words(raw: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in small letters, cut at white space and between letter and mark, and the index of each text's first word (n + 1 values)."""
    data = np.frombuffer(b" ".join([*raw, b""]).lower(), dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)  # a space after each text
    inside = ~textcore.SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | _LETTER[data[:-1]] & _STOP[data[1:]]
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])  # the words without what parts them
    offsets = np.append(kept[starts], kept[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))


def _pieces(path: str, capacity: int, closing: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part = WordTokens(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in (part_ for whole in batches for part_ in textcore.slices(whole, "text", 1 << 20)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids)}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(closing))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    row = [doc, piece, at, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])]
                    seen[len(own)] += 1
                    for k, v in zip(out, [*row, own.astype(np.int32)] if keep_ids else row, strict=True):
                        out[k].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def tokenised(docs: DataFrame, path: str, capacity: int = 4096, closing: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece, numbered by length within its partition (``part``, ``nth``)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path, capacity, closing, keep_ids), schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns: (number of sequences, lengths of their pieces in order)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    open_: list[tuple[int, list[int]]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    alive = np.zeros(capacity + 1, dtype=bool)
    alive[large] = True
    for a in reversed(large):
        while left.get(a, 0) > 0:
            partners = np.flatnonzero(alive[: max(0, min(capacity - a, a)) + 1])
            b = int(partners[-1]) if len(partners) else 0
            if not b or (b == a and left[a] < 2):
                if b == a:
                    b = int(partners[-2]) if len(partners) > 1 else 0
                if not b:
                    open_.append((left.pop(a), [a]))
                    alive[a] = False
                    continue
            times = left[a] // 2 if a == b else min(left[a], left[b])
            open_.append((times, [a, b]))
            for x in (a, b):
                left[x] -= times
            for x in {a, b}:
                if left[x] == 0:
                    del left[x]
                    alive[x] = False
    # Room left: sequences of the same room wait in one list; the heap has the rooms.
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    for times, filled in open_:
        rooms.setdefault(capacity - sum(filled), []).append((times, filled))
    present = np.zeros(capacity + 1, dtype=bool)
    present[[r for r in rooms]] = True
    small = [-n for n in left]
    heapq.heapify(small)
    while small:
        n = -heapq.heappop(small)
        count = left[n]
        while count:
            fits = np.flatnonzero(present[n:])
            if len(fits):
                room = int(fits[0]) + n
                times, filled = rooms[room].pop()
                if not rooms[room]:
                    present[room] = False
                each = min(room // n, count)  # so many of this length into every one of them
                used = min(times, count // each)
                if used < times:
                    rooms[room].append((times - used, filled))
                    present[room] = True
                rest = room - each * n
                rooms.setdefault(rest, []).append((used, filled + [n] * each))
                present[rest] = True
                count -= used * each
            else:
                each = capacity // n
                full, over = divmod(count, each)
                if full:
                    rooms.setdefault(capacity - each * n, []).append((full, [n] * each))
                    present[capacity - each * n] = True
                if over:
                    rooms.setdefault(capacity - over * n, []).append((1, [n] * over))
                    present[capacity - over * n] = True
                count = 0
    return [pattern for room in sorted(rooms) for pattern in rooms[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, one past the last, first sequence, offset): where the pieces of a length go."""
    out, taken, sequence = [], {}, 0
    for times, filled in patterns:
        offset = 0
        for n in filled:
            first = taken.get(n, 0)
            out.append((n, first, first + times, sequence, offset))
            taken[n] = first + times
            offset += n
        sequence += times
    return out


def assign(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to materialised pieces; drops part and nth.

    To the driver goes the histogram of lengths, ``capacity`` rows at most; back go the slots,
    whose number depends on the capacity too and not on the number of documents.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by: dict[int, list] = {}
    for s in slots(plan(histogram, capacity)):
        by.setdefault(s[0], []).append(s)
    lookup = spark.sparkContext.broadcast({n: tuple(np.array(col, dtype=np.int64) for col in zip(*[x[1:] for x in rows], strict=True)) for n, rows in by.items()})
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = pieces.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("__before")), ["part", "length"])
    columns = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = T.StructType([*[pieces.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length, number = (np.asarray(table[c].combine_chunks()) for c in ("length", "__number"))
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, _, base, place_ = lookup.value[int(n)]
                k = np.searchsorted(first, number[at], side="right") - 1
                sequence[at], offset[at] = base[k] + number[at] - first[k], place_[k]
            yield from table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    return numbered.withColumn("__number", F.col("nth") + F.col("__before")).select(*columns, "__number").mapInArrow(place, schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, closing: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    return assign(materialise(tokenised(docs, path, capacity, closing, keep_ids), "pieces"), capacity)
