"""SentencePiece encoding and decoding of a merge (BPE) model, by batched numpy merging.

Of the neighbouring symbols of a word, starting with its characters, the pair whose joined piece
has the best score, the leftmost of equals, becomes one, until no pair is a piece: these are the
ids that the model itself gives. As no piece runs on from a character into white space after it,
texts are cut there into words, and each distinct word of a batch is encoded once. Words of equal
length advance together, one merge a round, so that their rows stay of equal length; words of
over HEAPED characters use a heap. Characters without a piece fall back to their bytes.

``encode_words`` reads the same scores as a unigram model's and finds the cut of the highest sum,
by a batched Viterbi; that is another cut for most texts, so ``encode`` does not use it. Decoding
gives back every text exactly, save that malformed surrogates become "?"; for that a space mark that
a text itself holds becomes bytes, where the library takes it for a space.

Defined cases: null or empty text has no ids and decodes to ""; repeated rows are encoded each;
other columns pass through (columns named like the results are replaced).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore

U64 = np.uint64
SPACE = "▁"
#: Fixed value: what the unigram model takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0
#: Stands for the space mark where a text itself has that character; it becomes bytes.
LITERAL = SPACE + "\0" + SPACE
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Distinct words whose ids a task keeps, and characters of words that advance together.
WORDS_KEPT = 300_000
CHARACTERS = 400_000
#: Leading bits of a hash by which substrings are sifted before the search.
LEADING = 20
#: Characters beyond which a word is merged by a heap.
HEAPED = 48
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class PieceModel:
    """Pieces of a SentencePiece model file, as sorted hash keys."""

    def __init__(self, path: str, add_dummy_prefix: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.add_dummy_prefix = add_dummy_prefix
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.bytes_of: dict[int, int] = {}
        self.control = set()
        ids = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = int(p[3:5], 16)
            elif model.is_control(i) or model.is_unknown(i):
                self.control.add(i)
            else:
                ids.append(i)
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in ids):
            raise ValueError("a piece runs from a character into white space; words can't be cut there")
        scores = np.array([model.get_score(i) for i in ids], dtype=np.float64)
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.longest = max(len(self.pieces[i]) for i in ids)
        codes = [np.array([ord(c) for c in self.pieces[i]], dtype=U64) for i in ids]
        keys = np.array([_hash(c, BASES[0]) for c in codes], dtype=U64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.checks = np.array([_hash(c, BASES[1]) for c in codes], dtype=U64)[order]
        self.scores, self.ids = scores[order], np.array(ids, dtype=np.int32)[order]
        # Every pair of pieces that joins to a piece, as left * n + right.
        by_name = {self.pieces[i]: i for i in ids}
        if any(c not in by_name for p in by_name for c in p):
            raise ValueError("a character of a piece is no piece")
        self.characters = {c: i for c, i in by_name.items() if len(c) == 1}
        joined = [(by_name[p[:k]] * n + by_name[p[k:]], i, model.get_score(i)) for p, i in by_name.items() for k in range(1, len(p)) if p[:k] in by_name and p[k:] in by_name]
        joined.sort()
        self.pairs = np.array([j[0] for j in joined], dtype=np.int64)
        self.joined = np.array([j[1] for j in joined], dtype=np.int64)
        self.joined_scores = np.array([j[2] for j in joined], dtype=np.float64)
        self.join_of = {j[0]: (-j[2], j[1]) for j in joined}
        # Most substrings are no piece; their leading bits tell at one look.
        self.starts_piece = np.zeros(1 << LEADING, dtype=bool)
        self.starts_piece[(self.keys >> U64(64 - LEADING)).astype(np.int64)] = True
        shown = [b"" if i in self.control else bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.shown_sizes = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.known: dict[str, np.ndarray] = {}

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The model's ids of words, those of equal length together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, members in by_length.items():
            if not length:
                continue
            codes = np.frombuffer("".join(words[k] for k in members).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
            used, back = np.unique(codes, return_inverse=True)
            # A character without a piece is negative and joins nothing.
            symbols = np.array([self.characters.get(chr(c), -1 - c) for c in used.tolist()], dtype=np.int64)[back].reshape(len(members), length)
            for k, ids in zip(members, self._heaped(symbols) if length > HEAPED else self._merged(symbols), strict=True):
                out[k] = ids
        return out

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (minus infinity if there is none) and pieces of pairs of symbols."""
        key = np.where((left < 0) | (right < 0), -1, left * len(self.pieces) + right)
        at = np.minimum(self.pairs.searchsorted(key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined_scores[at], -np.inf), self.joined[at]

    def _merged(self, symbols: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(symbols)
        live = np.arange(len(symbols))
        scores, pieces = self._joins(symbols[:, :-1], symbols[:, 1:])
        while len(live):
            width = symbols.shape[1]
            k = scores.argmax(axis=1) if width > 1 else np.zeros(len(live), dtype=np.int64)
            on = scores[np.arange(len(live)), k] > -np.inf if width > 1 else np.zeros(len(live), dtype=bool)
            for row, ids in zip(live[~on].tolist(), symbols[~on], strict=True):
                out[row] = self._with_bytes(ids)
            live, symbols, scores, pieces, k = live[on], symbols[on], scores[on], pieces[on], k[on]
            if not len(live):
                break
            rows, n = np.arange(len(live)), len(live)
            symbols[rows, k] = pieces[rows, k]
            symbols = symbols[np.arange(width) != (k + 1)[:, None]].reshape(n, width - 1)
            stay = np.arange(width - 1) != k[:, None]
            scores, pieces = scores[stay].reshape(n, width - 2), pieces[stay].reshape(n, width - 2)
            for left in (k - 1, k):  # the pairs on either side of the joined symbol
                some = np.flatnonzero((left >= 0) & (left < width - 2))
                at = left[some]
                scores[some, at], pieces[some, at] = self._joins(symbols[some, at], symbols[some, at + 1])
        return out

    def _heaped(self, rows: np.ndarray) -> list[np.ndarray]:
        out, size = [], len(self.pieces)
        for row in rows.tolist():
            n = len(row)
            after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []

            def offer(i: int, j: int) -> None:
                if row[i] >= 0 and row[j] >= 0 and (found := self.join_of.get(row[i] * size + row[j])):
                    heapq.heappush(heap, (found[0], i, j, row[i], row[j], found[1]))

            for i in range(n - 1):
                offer(i, i + 1)
            gone = [False] * n
            while heap:
                _, i, j, left, right, piece = heapq.heappop(heap)
                if gone[i] or gone[j] or row[i] != left or row[j] != right or after[i] != j:
                    continue
                row[i], gone[j], after[i] = piece, True, after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                    offer(i, after[j])
                if before[i] >= 0:
                    offer(before[i], i)
            out.append(self._with_bytes(np.array([s for s, g in zip(row, gone, strict=True) if not g], dtype=np.int64)))
        return out

    def _with_bytes(self, symbols: np.ndarray) -> np.ndarray:
        if symbols.min() >= 0:
            return symbols.astype(np.int32)
        parts = [[s] if s >= 0 else self.byte_ids[np.frombuffer(chr(-1 - s).encode("utf-8", "replace"), dtype=np.uint8)] for s in symbols.tolist()]
        return np.concatenate(parts).astype(np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, those of equal length together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, members in by_length.items():
            together = max(1, CHARACTERS // max(1, length))
            for at in range(0, len(members), together):
                some = members[at : at + together]
                codes = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le", "replace"), dtype="<u4").reshape(len(some), length)
                for k, ids in zip(some, self._viterbi(codes), strict=True):
                    out[k] = ids
        return out

    def _viterbi(self, codes: np.ndarray) -> list[np.ndarray]:
        """Best pieces of words of one length, a row of characters each; work arrays have a row per position."""
        n, length = codes.shape
        letters = np.ascontiguousarray(codes.T).astype(U64) + U64(1)
        prefix = [np.zeros((length + 1, n), dtype=U64) for _ in BASES]
        powers = [[U64(pow(base, k, 1 << 64)) for k in range(min(length, self.longest) + 1)] for base in BASES]
        for h, base in zip(prefix, BASES, strict=True):
            for j in range(length):
                h[j + 1] = h[j] * U64(base) + letters[j]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.ones((length + 1, n), dtype=np.int32)
        piece = np.full((length + 1, n), -1, dtype=np.int32)
        for end in range(1, length + 1):
            top, size, which = best[end], back[end], piece[end]
            top[:] = best[end - 1] + self.unknown
            for width in range(min(end, self.longest), 0, -1):
                start = end - width
                key = prefix[0][end] - prefix[0][start] * powers[0][width]
                maybe = self.starts_piece[(key >> U64(64 - LEADING)).view(np.int64)].nonzero()[0]
                if not len(maybe):
                    continue
                key = key[maybe]
                at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
                same = self.keys[at] == key
                hit, at = maybe[same], at[same]
                if not len(hit):
                    continue
                check = prefix[1][end][hit] - prefix[1][start][hit] * powers[1][width]
                value = best[start][hit] + self.scores[at]
                better = (self.checks[at] == check) & ((value > top[hit]) | (which[hit] < 0) & (width == 1))
                rows = hit[better]
                top[rows], size[rows], which[rows] = value[better], width, self.ids[at[better]]
        # All words walk back together.
        where, steps, live = np.full(n, length), [], np.arange(n)
        while len(live):
            now = where[live]
            start = now - back[now, live]
            steps.append((live, start, piece[now, live]))
            where[live] = start
            live = live[start > 0]
        owner = np.concatenate([s[0] for s in steps])
        start = np.concatenate([s[1] for s in steps])
        ids = np.concatenate([s[2] for s in steps])
        order = np.lexsort((start, owner))
        owner, start, ids = owner[order], start[order], ids[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            parts, last = [], 0
            extra = np.ones(len(ids), dtype=np.int64)
            for u in unknown:
                raw = chr(int(codes[owner[u], start[u]])).encode("utf-8", "replace")
                parts += [ids[last:u], self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]]
                extra[u] = len(raw)
                last = u + 1
            ids = np.concatenate([*parts, ids[last:]])
            owner = np.repeat(owner, extra)
        ids, bounds = ids.astype(np.int32), np.searchsorted(owner, np.arange(n + 1)).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a word that several hold is encoded once."""
        split = []
        for t in texts:
            words: list[str] = []
            for k, part in enumerate(t.split(SPACE)):
                marked = part.replace(" ", SPACE)
                words += ([LITERAL] if k else []) + WORD.findall(SPACE + marked if self.add_dummy_prefix and t and not k else marked)
            split.append(words)
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = set().union(*split)
        self.known[LITERAL] = self.byte_ids[np.frombuffer(SPACE.encode(), dtype=np.uint8)]
        listed = list(new - {LITERAL})
        for k in range(0, len(listed), 20_000):
            part = listed[k : k + 20_000]
            self.known.update(zip(part, self.merge_words(part), strict=True))
        none = np.zeros(0, dtype=np.int32)
        return [np.concatenate([none, *map(self.known.__getitem__, words)]) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.shown_sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.shown_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        text = self.shown[places].tobytes().decode("utf-8", "replace")
        return text[1:] if self.add_dummy_prefix and text.startswith(" ") else text


def _hash(codes: np.ndarray, base: int) -> int:
    h = 0
    for c in codes.tolist():
        h = (h * base + c + 1) & ((1 << 64) - 1)
    return h


def _map(docs: DataFrame, path: str, column: str, new: dict[str, T.DataType], make) -> DataFrame:
    rest = [c for c in docs.columns if c not in new]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(k, v) for k, v in new.items()]])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32()), T.BooleanType(): pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for whole in batches:
            for batch in textcore.slices(whole, column, 1 << 20) if docs_type == "string" else [whole]:
                table = pa.Table.from_batches([batch])
                for (name, kind), values in zip(new.items(), make(model, batch.column(batch.schema.get_field_index(column))), strict=True):
                    table = (table.drop_columns([name]) if name in table.column_names else table).append_column(name, pa.array(values, kinds[kind]))
                yield from table.select(schema.names).to_batches()

    docs_type = docs.schema[column].dataType.simpleString()
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """The columns of ``docs`` with ids and n_ids."""
    ids = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType()}

    def make(model: PieceModel, texts: pa.Array):
        found = model.encode([t or "" for t in texts.to_pylist()])
        return found, [len(x) for x in found]

    return _map(docs, path, column, ids, make)


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The columns of ``encoded`` with decoded."""
    return _map(encoded, path, column, {"decoded": T.StringType()}, lambda model, ids: ([model.decode(np.array(x or [], dtype=np.int64)) for x in ids.to_pylist()],))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 of the little-endian 32-bit ids, and whether decoding gave the text back."""
    import zlib

    def make(model: PieceModel, texts: pa.Array):
        given = [t or "" for t in texts.to_pylist()]
        found = model.encode(given)
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
        return [len(x) for x in found], crc, [model.decode(x) == t for x, t in zip(found, given, strict=True)]

    new = {"n_ids": T.LongType(), "ids_crc32": T.LongType(), "exact": T.BooleanType()}
    return _map(docs.select("doc_id", F.col("text")), path, "text", new, make).drop("text")
