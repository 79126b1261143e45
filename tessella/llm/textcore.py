"""Words and shingles of Arrow string columns as numpy arrays of 64-bit hashes.

A word is a run of characters other than the six ASCII white-space characters, so words can
be cut in the UTF-8 bytes. All texts of a batch are hashed together; a hash depends on the
word's bytes alone, so it agrees between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Bytes hashed at a time.
BLOCK = 1 << 19

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


_POWERS = _powers(BASE, BLOCK * 2)
_INVERSES = _powers(pow(BASE, -1, 1 << 64), BLOCK * 2)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        stop = max(int(np.searchsorted(ends, origin + BLOCK, side="right")), at + 1)
        piece = data[origin : ends[stop - 1]]
        n = len(piece)
        powers, inverses = (_POWERS, _INVERSES) if n <= len(_POWERS) else (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((piece.astype(U64) + U64(1)) * powers[:n], out=sums[1:], dtype=U64)
        s, e = starts[at:stop] - origin, ends[at:stop] - origin
        out[at:stop] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(U64) * U64(LANES[0]))
        at = stop
    return out


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    take = min(width, n)
    total = np.zeros(n - take + 1, dtype=U64)
    for k in range(take):
        total += words[k : n - take + 1 + k] * U64(LANES[k % len(LANES)] + 2 * (k // len(LANES)))
    return mix(total + U64(take))


def shingle_sets(column: pa.Array, width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its whole text."""
    data, offsets = string_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    for i in range(len(offsets) - 1):
        yield np.unique(shingle_hashes(hashes[bounds[i] : bounds[i + 1]], width))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on the order of the hashes, as two signed longs."""
    a = np.add.reduce(mix(hashes ^ U64(LANES[1])), dtype=U64)
    b = np.add.reduce(mix(hashes ^ U64(LANES[2])), dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text each; a longer text comes alone."""
    _, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1, at + 1)
        yield batch.slice(at, min(stop, n) - at)
        at = min(stop, n)


def unused(columns: list[str], name: str) -> str:
    """``name``, longer by underscores if a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
