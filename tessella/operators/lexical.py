"""Lexical search: token tables, BM25 top-k, and names that texts contain."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text
from tessella.session import materialise

K1, B = 1.5, 0.75


def matched(chunks: DataFrame, asked: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, length, token, tf, word), written once: the asked tokens of each chunk, and a row (not ``word``) for the chunk itself.

    ``asked`` is a table of tokens. Texts are folded in one pass; tokens that nobody asks for go before the shuffle.
    The chunk's own row has its key for a token, so that those rows are dealt like others.
    """
    words = chunks.select(key, text.tokens(F.col(column)).alias("__t"))
    own = F.concat(F.lit("\0"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = words.select(key, F.size("__t").alias("length"), F.posexplode(F.concat(F.array(own), "__t")).alias("__place", "token"))
    known = rows.join(asked.select("token", F.lit(True).alias("__known")), "token", "left").where(F.col("__known") | (F.col("__place") == 0))
    return materialise(known.groupBy(key, "length", "token", (F.col("__place") > 0).alias("word")).agg(F.count("*").alias("tf")), "tokens")


#: Postings of a block; the best of a first round that are scored in full, for each of the k that are asked for.
POSTINGS, PROBED = 256, 4
#: Scores are compared at nine places, so a bound must miss by more than this.
SLACK = 1e-6
#: More unread means fewer postings read and more pairs scored in full; half does least of both together.
UNREAD = 0.5


def _block_task(key: str):
    """Postings sorted by token and falling part, as blocks of at most POSTINGS with their largest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.asarray(batch.column(0).dictionary_encode().indices)
            cuts = [0, *(np.flatnonzero(tokens[1:] != tokens[:-1]) + 1).tolist(), len(tokens)]
            starts = [at for a, b in zip(cuts[:-1], cuts[1:], strict=True) for at in range(a, b, POSTINGS)]
            edges = pa.array([*starts, len(tokens)], pa.int32())
            at = pa.array(starts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.ListArray.from_arrays(edges, batch.column(1)), pa.ListArray.from_arrays(edges, batch.column(2))], names=["token", "top", key, "parts"])

    return run


class Postings:
    """What the questions ask of the chunks: postings by chunk and token, the same in blocks by falling score, weights of tokens."""

    def __init__(self, chunks: DataFrame, questions: DataFrame, key: str, query: str):
        self.key, self.query = key, query
        asked = questions.select(query, F.explode(text.tokens(F.col("question"))).alias("token")).groupBy(query, "token").agg(F.count("*").alias("qtf"))
        every = matched(chunks, asked.select("token").distinct(), key)
        lengths = every.where("not word").agg(F.sum("tf").alias("chunks"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("mean"))
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        self.rows = every.where("word").join(F.broadcast(lengths)).select(key, "token", share.alias("part"))
        seen = every.where("word").groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(lengths)).select("token", "df", F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
        order = ["token", F.desc("part"), key]
        blocks = self.rows.select("token", key, "part").repartitionByRange(*order).sortWithinPartitions(*order)
        kind = T.StructType([T.StructField("token", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField(key, T.ArrayType(chunks.schema[key].dataType)), T.StructField("parts", T.ArrayType(T.DoubleType()))])
        self.blocks = materialise(blocks.mapInArrow(_block_task(key), kind), "posting-blocks")
        most = self.blocks.groupBy("token").agg(F.max("top").alias("most"))
        #: One row for each question and token: its weight, and the most that a chunk can have from it.
        self.asked = materialise(asked.join(seen, "token").join(most, "token").select(query, "token", "df", (F.col("qtf") * F.col("idf")).alias("weight"), (F.col("qtf") * F.col("idf") * F.col("most")).alias("bound")), "asked")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Whole scores of pairs (query, key)."""
        parts = pairs.join(self.asked.select(self.query, "token", "weight"), self.query).join(self.rows, [self.key, "token"])
        return parts.groupBy(self.query, self.key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))

    def sums(self, asked: DataFrame) -> DataFrame:
        """(query, key, score): all pairs that share a token of ``asked`` (query, token, weight).

        Postings are dealt by key, so that the pairs of a chunk arise and are summed in one task and don't travel.
        """
        parts = self.rows.repartition(self.key).join(asked.select(self.query, "token", "weight"), "token")
        return parts.groupBy(self.query, self.key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def _ranked(scored: DataFrame, key: str, query: str, k: int) -> DataFrame:
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def thresholds(postings: Postings, k: int) -> DataFrame:
    """(query, floor): a score that k chunks reach; 0 where fewer than k were seen. From the best block of each token."""
    key, query = postings.key, postings.query
    first = postings.blocks.groupBy("token").agg(F.max_by(F.struct(key, "parts"), "top").alias("b")).select("token", F.arrays_zip(F.col(f"b.{key}").alias(key), F.col("b.parts").alias("parts")).alias("p"))
    seen = postings.asked.join(first, "token").select(query, "weight", F.explode("p").alias("p")).select(query, F.col(f"p.{key}").alias(key), (F.col("weight") * F.col("p.parts")).alias("score"))
    some = _ranked(seen.groupBy(query, key).agg(F.sum("score").alias("score")), key, query, PROBED * k)
    full = _ranked(postings.scored(some.select(query, key)), key, query, k)
    return full.groupBy(query).agg(F.count("*").alias("n"), F.min("score").alias("floor")).select(query, F.when(F.col("n") >= k, F.col("floor") - SLACK).otherwise(0.0).alias("floor"))


def limits(postings: Postings, k: int) -> DataFrame:
    """The asked tokens with the ``floor`` of their question and whether they are ``read``; a written table.

    Tokens of a question are taken by rising bound, the commonest first, and stay unread while their bounds add up to
    less than the share UNREAD of the question's floor.
    """
    rising = Window.partitionBy(postings.query).orderBy("bound", "token")
    return materialise(postings.asked.join(thresholds(postings, k), postings.query).withColumn("read", F.sum("bound").over(rising) > UNREAD * F.col("floor")), "limits")


def candidates(postings: Postings, k: int, known: DataFrame | None = None) -> DataFrame:
    """(query, key): pairs that may be among the k best; a written table. ``known`` are the ``limits``, if they are there.

    A chunk that has only unread tokens is out. Of the others what was read and all that the unread tokens could add
    must reach the floor.
    """
    limits_ = limits(postings, k) if known is None else known
    key, query = postings.key, postings.query
    rest = limits_.groupBy(query).agg(F.max("floor").alias("floor"), F.sum(F.when(F.col("read"), 0.0).otherwise(F.col("bound"))).alias("rest"))
    pairs = postings.sums(limits_.where("read"))
    return materialise(pairs.join(rest, query).where(F.col("score") + F.col("rest") >= F.col("floor")).select(query, key), "candidates")


def pairs_lost(postings: Postings, k: int) -> DataFrame:
    """(query, sharing, lost): how many chunks share a token with a question, and of the k best of all how many ``candidates`` leaves out.

    All pairs are scored, but only those that reach the question's floor are kept; the others are counted where they
    arise. A floor that fewer than k pairs reach would hide a loss, so what is missing counts as lost.
    """
    key, query = postings.key, postings.query
    known = limits(postings, k)
    floors = known.groupBy(query).agg(F.max("floor").alias("floor"))
    high = F.col("score") >= F.col("floor")
    kept = postings.sums(postings.asked).join(floors, query, "left").select(query, F.col(key).isNotNull().cast("long").alias("n"), F.when(high, F.col(key)).alias(key), F.when(high, F.col("score")).alias("score"))
    counted = materialise(kept.groupBy(query, key, "score").agg(F.sum("n").alias("n")), "scored")
    sharing = counted.groupBy(query).agg(F.sum("n").alias("sharing"), F.least(F.lit(k), F.sum("n")).alias("due"))
    best = _ranked(counted.where(F.col(key).isNotNull()), key, query, k).join(candidates(postings, k, known), [query, key], "left_semi")
    return sharing.join(best.groupBy(query).agg(F.count("*").alias("held")), query, "left").select(query, "sharing", (F.col("due") - F.coalesce("held", F.lit(0))).alias("lost"))


def bm25(chunks: DataFrame, questions: DataFrame, key: str, query: str, k: int = 8) -> DataFrame:
    """The k best chunks of every question: (query, key, score, rank); ties by key.

    Exact, but not every chunk that shares a token is scored: see ``limits`` and ``candidates``. A term that a question repeats counts
    each time; terms are counted by an aggregate, so the size of the question table does not matter.
    """
    postings = Postings(chunks, questions, key, query)
    return _ranked(postings.scored(candidates(postings, k)), key, query, k)


#: Names, and letters in all, up to which every task holds an automaton of all names; more meet the texts by rare stretches.
NAMES, LETTERS = 200_000, 8_000_000
#: Letters of a stretch by which a name of a larger table is found.
GRAM = 6


def with_names(rows: DataFrame, column: str, files: DataFrame, name: str, most: int = NAMES) -> DataFrame:
    """The rows (without the text) with each name of ``files`` that their text contains, once each.

    A name is any text, found as it is; an empty or null one is in no text. Up to ``most`` names of LETTERS letters
    in all go to every task as an automaton, which reads each text once. Beyond that, see ``_by_stretches``.
    """
    names = files.select(name).where(F.length(name) > 0).distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(name)), F.lit(0)).alias("letters")).first()
    rest = [c for c in rows.columns if c != column]
    if size["n"] > most or size["letters"] > LETTERS:
        return _by_stretches(rows, column, names, name).select(*rest, name).distinct()
    shared = rows.sparkSession.sparkContext.broadcast([r[0] for r in names.collect()])
    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField(name, T.StringType())])
    return rows.select(*rest, column).mapInArrow(_find_task(shared), schema).distinct()


def _find_task(shared):
    """The columns before the last, once for each name that the last holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for x in shared.value:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist() if len(automaton) else []):
                held = sorted({x for _, x in automaton.iter(text)}) if text else []
                at += [i] * len(held)
                found += held
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], "name"])

    return run


def _stretch_task(lengths: list[int] | None):
    """(key, stretch) of each row (key, text): all stretches of those lengths, or without any of GRAM letters or else the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                held = list({text[at : at + n] for n in lengths or [min(GRAM, len(text))] for at in range(len(text) - n + 1)})
                for at in range(0, len(held), 10_000):
                    part = held[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part), pa.int64())), pa.array(part, pa.string())], names=["key", "stretch"])

    return run


def _by_stretches(rows: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """The rows with the names that they hold, for names too many for one task.

    A name's key is that stretch of GRAM letters (a shorter name's: all of it) which the fewest names have. Texts
    and names meet by keys alone; each candidate is then looked for in its text, which travels once more.
    """
    grams = names.select(F.col(name).alias("key"), F.col(name).alias("text")).mapInArrow(_stretch_task(None), "key string, stretch string")
    rare = grams.groupBy("stretch").agg(F.count("*").alias("n"))
    keys = materialise(grams.join(rare, "stretch").groupBy("key").agg(F.min(F.struct("n", "stretch")).alias("k")).select(F.col("key").alias(name), "k.stretch"), "name-keys")
    lengths = [r["n"] for r in keys.select(F.length("stretch").alias("n")).distinct().collect()]  # GRAM at most
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "named-texts")
    if not lengths:
        return numbered.withColumn(name, F.lit(None).cast("string")).limit(0)
    held = numbered.select("__row", column).mapInArrow(_stretch_task(lengths), "key long, stretch string")
    tried = held.join(keys, "stretch").select(F.col("key").alias("__row"), name).distinct()
    return numbered.join(tried, "__row").where(F.contains(F.col(column), F.col(name)))
