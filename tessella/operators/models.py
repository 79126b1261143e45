"""Calls of a model for texts, each distinct text once, kept in a table of results.

The model is a function from a list of texts to a list of results (vectors, captions): the caller's own, called in tasks
with at most ``batch`` texts at a time. What it gave is kept by the digest of the text, so texts that come again, in one table or
in a later call, are not sent again.

Defined cases: a null or blank text is not sent and has no result; a call that fails is tried once more text by text,
and what fails again is a row with the error and without a result, sent anew at the next call; repeated texts share one result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

#: Fixed value: letters of a text that a model is sent.
SENT = 8000
BATCH = 64
#: Letters that are kept of an error.
ERROR = 2000


def _predict_task(predict: Callable[[list[str]], list[Any]], batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                sent = part["text"].tolist()
                try:
                    found = [(r, None) for r in predict(sent)]
                    if len(found) != len(sent):
                        raise ValueError(f"{len(found)} results for {len(sent)} texts")
                except Exception:  # one bad text must not lose the others
                    found = []
                    for one in sent:
                        try:
                            found.append((predict([one])[0], None))
                        except Exception as error:
                            found.append((None, f"{type(error).__name__}: {error}"[:ERROR]))
                yield pd.DataFrame({"digest": part["digest"], "result": [r for r, _ in found], "error": [e for _, e in found]})

    return run


def _known(table: DataFrame, path: str, kind: str) -> DataFrame:
    spark = table.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"digest binary, result {kind}, error string")


def with_results(rows: DataFrame, column: str, predict: Callable[[list[str]], list[Any]], path: str, kind: str = "array<double>", batch: int = BATCH) -> DataFrame:
    """``rows`` with ``result`` and ``error``; the table of results at ``path`` grows by what it lacked.

    Texts are sent cut to SENT letters. The distinct missing ones are dealt over all tasks, so a text of very many rows is one call.
    """
    sent = F.substring(F.col(column), 1, SENT)
    digest = F.when(F.length(F.trim(sent)) > 0, F.unhex(F.sha2(sent, 256)))
    marked = rows.withColumn("__digest", digest)
    asked = marked.where("__digest is not null").select(F.col("__digest").alias("digest"), sent.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    done = _known(rows, path, kind).where("error is null")
    missing = asked.join(done.select("digest"), "digest", "left_anti")
    new = materialise(missing.mapInPandas(_predict_task(predict, batch), f"digest binary, result {kind}, error string"), "model-results")
    new.where("error is null").write.mode("append").parquet(path)
    every = done.unionByName(new).groupBy(F.col("digest").alias("__digest")).agg(F.max_by("result", F.col("result").isNotNull()).alias("result"), F.max("error").alias("error"))
    return marked.join(every, "__digest", "left").drop("__digest")
