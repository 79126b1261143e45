"""Changes to tables as plans: upserts, ordered deletes, change feeds and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(now: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys; one full outer join."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys], F.lit(True).alias("__new"))
    return now.join(new, keys, "full").select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in now.columns if c not in keys])


def cascade(tables: dict[str, DataFrame], root: str, gone: DataFrame, edges: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """What is left of the tables when ``gone`` leaves the root; edges (parent, key, child, foreign key), parents first.

    A child that refers by several edges goes if any parent does.
    """
    lost, left = {root: gone}, dict(tables)
    for parent, key, child, foreign in edges:
        if parent in lost:
            keys = lost[parent].select(F.col(key).alias(foreign)).distinct()
            dropped = tables[child].join(keys, foreign, "left_semi")
            lost[child] = lost[child].unionByName(dropped).distinct() if child in lost else dropped
            left[child] = left[child].join(keys, foreign, "left_anti")
    key = edges[0][1] if edges else gone.columns[0]
    left[root] = tables[root].join(gone.select(key).distinct(), key, "left_anti")
    return left


def latest(changes: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """The last value sent of each column; a column that a change leaves null keeps its value."""
    at = F.struct(*order)
    return changes.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(name) for name, c in columns.items()])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def bad_transitions(events: DataFrame, entity: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Changes of state that the table of transitions doesn't allow."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    good = F.struct(F.col("__before").alias("a"), F.col(state).alias("b")).isin(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed])
    return events.withColumn("__before", before).where(F.col("__before").isNotNull() & ~good)


#: Fixed value: chunks of figures are numbered from here, past all chunks of text.
FIRST_FIGURE = 1_000_000


def figure_index(figure: Column) -> Column:
    return (F.lit(FIRST_FIGURE) + figure).cast("long")


def inserted(now: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """The rows with new ones at their end; columns that a new row leaves out take their defaults, or null."""
    filled = new.select("*", *[F.lit(v).alias(c) for c, v in defaults.items() if c not in new.columns])
    return now.unionByName(filled, allowMissingColumns=True)


def appended(now: DataFrame, new: DataFrame, key: str, column: str, more: str) -> DataFrame:
    """Lists with what is new at their end."""
    none = F.array().cast(now.schema[column].dataType)
    return now.join(new.select(key, more), key, "left").withColumn(column, F.concat(F.coalesce(column, none), F.coalesce(more, none))).drop(more)


def first_take(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Attempts to take what can be taken once, with ``taken``: only the first of a key gets it."""
    return attempts.withColumn("taken", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def transition_verdicts(events: DataFrame, entity: str, order: list[str], state: str, role: str, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Every change of state with its verdict: start, ok, role (not for this role) or state (for none)."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    pair = lambda *cs: F.concat_ws("\x01", *cs)
    good = pair("__before", state, role).isin(*{"\x01".join(a) for a in allowed})
    known = pair("__before", state).isin(*{"\x01".join(a[:2]) for a in allowed})
    verdict = F.when(F.col("__before").isNull(), "start").when(good, "ok").when(known, "role").otherwise("state")
    return events.withColumn("__before", before).withColumn("verdict", verdict).drop("__before")
