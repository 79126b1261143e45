"""Topics: keyword distributions, assignment to centroids, and online clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text, vectors
from tessella.session import materialise

ASSIGN, COSINE_WEIGHT, KEYWORD_WEIGHT = 0.60, 0.95, 0.05


def _counted(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, __total, c): the topic words of each row with their counts, without leaving the row.

    Words are sorted and cut where the word changes. Each step is a column of its own: written
    into one another, a step would be evaluated again for every word.
    """
    rows = docs.select(key, F.array_sort(text.keywords(F.col(column))).alias("__w"))
    w = F.col("__w")
    ends = F.filter(F.transform(w, lambda x, i: F.when(F.get(w, i + 1).isNull() | (F.get(w, i + 1) != x), F.struct(x.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    e = F.col("__e")
    rows = rows.select(key, F.size("__w").alias("__total"), ends.alias("__e"))
    return rows.select(key, "__total", F.explode_outer(F.transform(e, lambda x, k: F.struct(x["word"].alias("word"), (x["i"] - F.coalesce(F.get(e, k - 1)["i"], F.lit(-1))).cast("long").alias("n")))).alias("c")).where("c is not null")


def keyword_weights(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, word, weight): the share of each topic word among the topic words of the key's text; one row a key, no shuffle."""
    return _counted(docs, key, column).select(key, "c.word", (F.col("c.n") / F.col("__total")).alias("weight"))


def group_weights(docs: DataFrame, group: str, column: str = "text") -> DataFrame:
    """(group, word, weight) of groups of texts, such as languages.

    Counts are dealt by group and word, so a large group is many tasks' work; its total is a row of
    a small table that comes from the same counts.
    """
    counts = materialise(_counted(docs, group, column).groupBy(group, "c.word").agg(F.sum("c.n").alias("n")), "word-counts")
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).select(group, "word", (F.col("n") / F.col("total")).alias("weight"))


def centroids(rows: DataFrame, topic: str, vector: str) -> DataFrame:
    """(topic, centroid, n): the mean vector; values are averaged by place, so no topic is gathered."""
    size = rows.groupBy(topic).agg(F.count("*").alias("n"))
    means = rows.select(topic, F.posexplode(vectors.doubles(F.col(vector))).alias("place", "x")).groupBy(topic, "place").agg(F.avg("x").alias("x"))
    ordered = means.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("centroid"))
    return ordered.join(size, topic)


#: Topics that a document is held against at a time.
TOPIC_BLOCK = 1000


def offered(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """The documents with arrays ``offers`` of the topics, TOPIC_BLOCK at most to a row.

    Topics are gathered in blocks, as many as their checked number needs, and blocks meet documents by
    their number; a document is copied only for further blocks.
    """
    columns = F.struct(*topics.columns)
    blocks = max(1, -(-topics.count() // TOPIC_BLOCK))
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int")
    held = topics.groupBy(block.alias("__block")).agg(F.collect_list(columns).alias("offers"))
    if blocks == 1:
        return docs.join(F.broadcast(held.drop("__block")), F.lit(True))  # one row
    return docs.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "__block").drop("__block")


def assigned(docs: DataFrame, topics: DataFrame, key: str, threshold: float = ASSIGN) -> DataFrame:
    """(key, topic, confidence): the most similar topic if at least the threshold, else none with confidence 0.

    Topics are offered by size, largest first, then by name; the first of equal scores wins.
    """
    score = lambda o: F.struct(F.round(vectors.cosine(F.col("vector"), o["centroid"]), 9).alias("s"), o["n"].alias("n"), (-o["topic"]).alias("t"))
    best = offered(docs, topics).select(key, F.array_max(F.transform("offers", score)).alias("b")).groupBy(key).agg(F.max("b").alias("b"))
    return best.select(key, F.when(F.col("b.s") >= threshold, -F.col("b.t")).alias("topic"), F.when(F.col("b.s") >= threshold, F.col("b.s")).otherwise(0.0).alias("confidence"), F.col("b.s").alias("best"))


def blended(docs: DataFrame, topics: DataFrame, key: str, k: int) -> DataFrame:
    """(key, topic, blended, rank) of the k best topics by vectors and keywords (``vector`` and ``p`` against ``centroid`` and ``q``)."""
    score = lambda o: F.struct(
        F.round(-(COSINE_WEIGHT * vectors.cosine(F.col("vector"), o["centroid"]) + KEYWORD_WEIGHT * vectors.bhattacharyya(F.col("p"), o["q"])), 9).alias("s"), o["topic"].alias("topic")
    )
    few = offered(docs, topics).select(key, F.explode(F.slice(F.array_sort(F.transform("offers", score)), 1, k)).alias("b"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("b.s", "b.topic"))).where(F.col("rank") <= k)
    return ranked.select(key, "b.topic", (-F.col("b.s")).alias("blended"), "rank")


class Topics:
    """The topics of a project so far: sums and unit vectors in arrays that double when they are full."""

    def __init__(self, width: int):
        self.names: list = []
        self.counts = np.zeros(16, dtype=np.int64)
        self.sums, self.units = np.zeros((16, width)), np.zeros((16, width))

    def add(self, key, x: np.ndarray, threshold: float) -> tuple:
        """(topic, confidence) of a document, which joins the topic or makes one."""
        n, size = len(self.names), float(np.linalg.norm(x))
        if n and size:
            score = self.units[:n] @ (x / size)
        else:
            score = np.zeros(n)
        if n:
            best = score.max()
            first = max(np.flatnonzero(score == best).tolist(), key=lambda i: (self.counts[i], -i))
            if score[first] >= threshold:
                self._put(first, x)
                return self.names[first], float(score[first])
        self._grow()
        self.names.append(key)
        self._put(n, x)
        return key, 0.0

    def restore(self, name, n: int, sums: np.ndarray) -> None:
        """A topic of an earlier run, in the order of their making."""
        self._grow()
        i = len(self.names)
        self.names.append(name)
        self.counts[i], self.sums[i] = n, sums
        size = np.linalg.norm(sums)
        self.units[i] = sums / size if size else 0.0

    def _grow(self) -> None:
        if len(self.names) == len(self.counts):
            self.counts, self.sums, self.units = (np.concatenate([a, np.zeros_like(a)]) for a in (self.counts, self.sums, self.units))

    def _put(self, i: int, x: np.ndarray) -> None:
        self.sums[i] += x
        self.counts[i] += 1
        size = np.linalg.norm(self.sums[i])
        self.units[i] = self.sums[i] / size if size else 0.0


def online(docs: DataFrame, project: str, key: str, vector: str, threshold: float = ASSIGN) -> DataFrame:
    """(project, key, topic, confidence) of documents that arrive in the order of their key.

    The result depends on the order, so a project is one sequence; its documents stream through
    a task in sorted order, which holds the centroids so far and never the documents. A new
    topic is numbered by its first document and has confidence 0.
    """
    schema = docs.select(project, key, F.col(key).alias("topic"), F.lit(0.0).alias("confidence")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, topics = object(), None
        for f in frames:
            out = []
            for p, k, v in zip(f[project], f[key], f[vector], strict=True):
                x = np.asarray(v, dtype=np.float64)
                if p != now:
                    now, topics = p, Topics(len(x))
                out.append((p, k, *topics.add(k, x, threshold)))
            yield pd.DataFrame(out, columns=[project, key, "topic", "confidence"])

    return docs.select(project, key, vector).repartition(project).sortWithinPartitions(project, key).mapInPandas(run, schema)


def without_document(rows: DataFrame, words: Column) -> DataFrame:
    """Topics (topic, centroid, n, keywords) after their document ``v`` left; one that had no other goes.

    ``words`` are the document's keyword weights; where they are not known (null), what is left is
    only scaled to the smaller number of documents.
    """
    known = F.coalesce(words, F.create_map().cast("map<string,double>"))
    kept = rows.where("n > 1").select("topic", vectors.without_member(F.col("centroid"), F.col("n"), F.col("v")).alias("centroid"), vectors.unmerged(F.col("keywords"), known, F.col("n")).alias("keywords"), F.col("n") - 1)
    return kept.toDF("topic", "centroid", "keywords", "n")


def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Topics (topic, centroid, n) after documents (id, source, target, v) went from one to another.

    A document leaves its topic, a topic that has none left goes, and the new topic takes the vector in. All moves of a topic
    are one sum of vectors, by place, so no topic is gathered; a document without a vector changes sizes only.
    """
    out = moves.select(F.col("source").alias("topic"), F.lit(-1).alias("sign"), "v")
    come = moves.select(F.col("target").alias("topic"), F.lit(1).alias("sign"), "v")
    both = out.unionByName(come)
    sizes = both.groupBy("topic").agg(F.sum("sign").alias("more"), F.sum(F.when(F.col("v").isNotNull(), F.col("sign")).otherwise(0)).alias("weight"))
    places = both.select("topic", "sign", F.posexplode("v").alias("place", "x")).groupBy("topic", "place").agg(F.sum(F.col("sign") * F.col("x")).alias("x"))
    change = places.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("change"))
    joined = rows.select("topic", "centroid", "n").join(sizes, "topic", "left").join(change, "topic", "left")
    more, weight = F.coalesce("more", F.lit(0)), F.coalesce("weight", F.lit(0))
    mean = F.when(F.col("change").isNull() | (F.col("n") + weight <= 0), F.col("centroid")).otherwise(F.zip_with("centroid", "change", lambda c, x: (c * F.col("n") + x) / (F.col("n") + weight)))
    return joined.select("topic", mean.alias("centroid"), (F.col("n") + more).alias("n")).where("n > 0")
