"""Similarity join on word shingles, with signature trees.

A document is the set of its distinct five-word shingles; two link when their Jaccard
similarity is at least ``percent`` / 100. The result is each document's component.

1. Documents of equal sets are one class, represented by the smallest doc_id (copies never
   meet each other again).
2. A representative's shingles are put in one global order: by hash, those of very many
   documents last. Two linked sets share a shingle among the first ``n - ceil(t n) + 1`` of each,
   so only these are keys. A set with few very common shingles needs fewer: at 0.75 each of
   the first shingles of the union is shared with a chance of over 0.7, hashes being random,
   so the first KEYS of both miss a link with a chance below 0.3 ** 24 < 1e-12. With ``exact`` every
   set has all its keys, and no link can be missed (some three times the keys).
3. In each key group the most central member, that with the most companions over all its
   keys, leads; every member is tested against its leaders. Groups of copies of one text, however
   large, are linked so by one pair a member.
4. What a group still has in different components goes through a signature tree: leaves are
   documents with a bitmap of their hashed shingles and their size; a node above holds the
   OR and AND of its children's bitmaps and their range of sizes. Pairs of nodes are descended
   from the root with itself; a pair goes if the most shingles that any two of its documents
   can share are too few. Groups of over BLOCK documents are dealt in pairs of blocks.
5. Each remaining pair is checked on the shingles of the two whole texts.

To the driver comes only the list of very common shingles, HEAVY_KEPT at most; which they are
changes the work and not the result.

Defined cases: null or empty texts have no shingles and are alone; fewer than five words are
one shingle; repeated rows are the same document; a null doc_id has no component; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import discard, materialise

from . import components, textcore

U64 = np.uint64
KEYS = 24
BITS = 2048
BLOCK = 1024
FANOUT = 4
#: A shingle of more than this share of the documents is very common; of those, so many are kept.
HEAVY_SHARE = 0.001
HEAVY_KEPT = 200_000
SETS = "doc_id long, n_shingles int, d1 long, d2 long, keys array<long>, bits binary"


def _frequent(share: float):
    """Shingles that are frequent in a task's documents, by lossy counting: memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        waiting, size, docs = [], 0, 0

        def merge(last: bool) -> None:
            nonlocal hashes, counts, waiting, size
            new, n = np.unique(np.concatenate([*waiting, np.zeros(0, dtype=U64)]), return_counts=True)
            waiting, size = [], 0
            both = np.concatenate([hashes, new])
            hashes, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(hashes)).astype(np.int64)
            keep = counts >= max(2, share / 2 * docs) if last or len(hashes) > 1_000_000 else slice(None)
            hashes, counts = hashes[keep], counts[keep]

        for whole in batches:
            for batch in textcore.slices(whole, "text"):
                for s in textcore.shingle_sets(batch.column(batch.schema.get_field_index("text"))):
                    waiting.append(s)
                    size += len(s)
                    docs += 1
                    if size > 500_000:
                        merge(False)
        merge(True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["hash", "n"])

    return run


def very_common(docs: DataFrame, share: float = HEAVY_SHARE, kept: int = HEAVY_KEPT) -> np.ndarray:
    """Sorted hashes of the most common shingles, ``kept`` at most."""
    rows = docs.count()
    found = docs.select("text").mapInArrow(_frequent(share), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= max(4, share * rows)).orderBy(F.desc("n"), "hash").limit(kept).select("hash").toArrow()
    return np.sort(np.asarray(top.column(0).combine_chunks()).view(U64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, one for each hash, as 64-bit words."""
    out = np.zeros(BITS, dtype=np.uint8)
    out[(hashes % U64(BITS)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U64)


def key_count(n: int, light: int, percent: int, exact: bool = False) -> int:
    most = n - -(-percent * n // 100) + 1
    return KEYS if most > KEYS and 10 * light >= 9 * n and not exact else most


def _signatures(common, percent: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = common.value
        for whole in batches:
            for batch in textcore.slices(whole, "text"):
                out = []
                for s in textcore.shingle_sets(batch.column(batch.schema.get_field_index("text"))):
                    at = np.searchsorted(heavy, s)
                    is_heavy = (heavy[np.minimum(at, len(heavy) - 1)] == s) if len(heavy) else np.zeros(len(s), dtype=bool)
                    ordered = np.concatenate([s[~is_heavy], s[is_heavy]])
                    keys = ordered[: key_count(len(s), int((~is_heavy).sum()), percent, exact)] if len(s) else s
                    out.append((len(s), *textcore.set_digest(s), keys.view(np.int64), bitmap(s).tobytes()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_shingles", "d1", "d2", "keys", "bits"])

    return run


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that linked sets of these sizes share."""
    return -(-percent * (na + nb) // (100 + percent))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def tree_pairs(sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray, percent: int, chunk: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j in order of size) of different groups that the bounds leave, by dual traversal."""
    order = np.lexsort((groups, sizes))
    levels = [(bits[order], bits[order], sizes[order], sizes[order])]
    while len(levels[-1][0]) > 1:
        union, common, low, high = levels[-1]
        cuts = np.arange(0, len(low), FANOUT)
        levels.append((np.bitwise_or.reduceat(union, cuts), np.bitwise_and.reduceat(common, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))
    todo = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    grid = np.arange(FANOUT)
    while todo:
        level, a, b = todo.pop()
        if len(a) > chunk:
            todo += [(level, a[chunk:], b[chunk:]), (level, a[:chunk], b[:chunk])]
            continue
        union, common, low, high = levels[level]
        if level == 0:
            differ = (a < b) & (groups[order[a]] != groups[order[b]])
            a, b = a[differ], b[differ]
        # Any two documents below: shingles of one in no bit of the other's node are not shared.
        most = np.minimum(high[a] - _popcount(common[a] & ~union[b]), high[b] - _popcount(common[b] & ~union[a]))
        low_a, low_b = low[a], low[b]
        fewest = np.maximum(needed(low_a, low_b, percent), -(-percent * np.maximum(low_a, low_b) // 100))
        left = most >= fewest
        a, b = a[left], b[left]
        if not len(a):
            continue
        if level == 0:
            yield order[a], order[b]
            continue
        n = len(levels[level - 1][2])
        ca = (a[:, None] * FANOUT + grid).repeat(FANOUT, axis=1).ravel()
        cb = np.tile(b[:, None] * FANOUT + grid, (1, FANOUT)).ravel()
        real = (ca < n) & (cb < n) & (ca <= cb)
        todo.append((level - 1, ca[real], cb[real]))


def runs_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in ``names`` that follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(keys[start])
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _as_words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=U64).reshape(-1, BITS // 64)


def _tree_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["key", "left", "right"]):
            ids, parts, sizes = (np.asarray(group[c].combine_chunks()) for c in ("rep", "component", "n_shingles"))
            home = np.asarray(group["home"].combine_chunks())
            for i, j in tree_pairs(sizes.astype(np.int64), _as_words(group["bits"]), parts, percent):
                if group["left"][0].as_py() != group["right"][0].as_py():
                    across = home[i] != home[j]
                    i, j = i[across], j[across]
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _prune_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            na, nb = (np.asarray(t[c].combine_chunks()).astype(np.int64) for c in ("na", "nb"))
            ba, bb = _as_words(t["ba"]), _as_words(t["bb"])
            most = np.minimum(na - _popcount(ba & ~bb), nb - _popcount(bb & ~ba))
            yield from t.select(["a", "b"]).filter(pa.array(most >= needed(na, nb, percent))).to_batches()

    return run


def _verify_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for whole in batches:
            for batch in textcore.slices(whole, "tb", 1 << 20):
                ids, texts = batch.column(0).to_pylist(), batch.column(2)
                good = []
                for i, right in enumerate(textcore.shingle_sets(batch.column(3))):
                    if ids[i] != last:
                        last, left = ids[i], next(textcore.shingle_sets(texts.slice(i, 1)))
                    shared = len(np.intersect1d(left, right, assume_unique=True))
                    good.append(100 * shared >= percent * (len(left) + len(right) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, ta, tb): pairs with both whole texts; only documents that are in a pair travel twice."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")


def signatures(docs: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """One row per document with a doc_id (SETS), a written table."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = docs.sparkSession.sparkContext.broadcast(very_common(own))
    return materialise(own.where("doc_id is not null").mapInArrow(_signatures(common, percent, exact), SETS), "signatures")


def links(classes: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of class representatives (rep, n_shingles, keys, bits): (id, component), linked ones only."""
    sets = classes.select("rep", "n_shingles", "bits")
    keys = materialise(classes.select("rep", F.explode("keys").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(keys.join(shared, "key"), "members")
    central = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    leaders = members.join(central, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("m")).select("key", (-F.col("m.r")).alias("leader"))
    led = materialise(members.join(leaders, "key").where("rep <> leader"), "led")
    pairs = led.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba"))
    right = sets.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb"))
    close = materialise(pairs.join(left, "a").join(right, "b").mapInArrow(_prune_task(percent), "a long, b long"), "close")
    for used in (keys, members):
        discard(used)
    first = materialise(with_texts(close, docs).mapInArrow(_verify_task(percent), "a long, b long"), "links")
    parts = components.connected(first)

    # Groups that hold several components beside their leader: the signature trees.
    rest = led.where("size > 2").join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = materialise(rest.select("key", "rep", "component"), "rest")
    open_ = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("int")
    dealt = (
        rest.join(open_.select("key", blocks.alias("blocks")), "key").withColumn("home", F.pmod(home, F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("home", "other").alias("left"), F.greatest("home", "other").alias("right"), "home", "rep", "component").join(sets, "rep")
    )
    found = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").select("key", "left", "right", "home", "rep", "component", "n_shingles", "bits").mapInArrow(_tree_task(percent), "a long, b long").distinct()
    more = materialise(found.join(pairs, ["a", "b"], "left_anti"), "candidates")
    if more.isEmpty():
        return parts
    second = with_texts(more, docs).mapInArrow(_verify_task(percent), "a long, b long")
    return components.connected(first.unionByName(second))


def join(docs: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    every = signatures(docs, percent, exact)
    same = ["n_shingles", "d1", "d2"]
    classes = materialise(every.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = materialise(every.join(classes.select("rep").distinct(), every["doc_id"] == F.col("rep"), "inner").select("rep", "n_shingles", "keys", "bits").dropDuplicates(["rep"]), "representatives")
    parts = links(reps, docs, percent)
    placed = classes.join(parts, classes["rep"] == parts["id"], "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = every.select("doc_id", *same).join(placed, same, "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """One document of each component: that of the smallest doc_id; and every row without a doc_id.

    A document is a doc_id and a text: rows of one doc_id with other texts are other documents, of which only linked
    ones go; of rows equal in both one stays. Where no doc_id comes twice, texts travel once, to meet the ids that stay.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named, digest = packed.where("doc_id is not null"), F.unhex(F.sha2("text", 256)).alias("digest")
    held = named.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()["most"] or 0
    if held <= 1:
        kept = join(named, percent, exact).where("doc_id = component_id").select("doc_id")
        chosen = named.join(kept, "doc_id", "left_semi")
    else:
        keys = materialise(named.select("doc_id", digest).distinct().withColumn("own", F.monotonically_increasing_id()), "text-keys")
        every = materialise(named.withColumn("digest", digest).join(keys, ["doc_id", "digest"]).select("row", "own", "text"), "keyed")
        parts = join(every.select(F.col("own").alias("doc_id"), "text"), percent, exact).select(F.col("doc_id").alias("own"), "component_id").distinct().join(keys, "own")
        kept = parts.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "own")).alias("k")).select("k.own")
        nth = F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64(F.to_json("row"))))
        chosen = every.join(kept, "own", "left_semi").withColumn("nth", nth).where("nth = 1")
    return chosen.select("row.*").unionByName(docs.where("doc_id is null"))
