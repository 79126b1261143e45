"""Chart specifications: checked, aligned and pivoted with JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import finite

# Chart kinds and limits.
KINDS = ("bar", "line", "area", "pie", "scatter")
SERIES, CATEGORIES, TITLE, LABEL = 6, 50, 120, 60
SHAPE = "chart struct<type:string,title:string,xAxisLabel:string,yAxisLabel:string,categories:array<string>,series:array<struct<name:string,data:array<string>>>>"
POINT = "x string, y string"


def _short(text: Column, size: int) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", F.substring(trimmed, 1, size))


def _coordinate(point: Column, name: str) -> Column:
    """A coordinate as a number: an explicit null is 0, a missing one or what is no number is null."""
    named = F.array_contains(F.json_object_keys(point), name)
    return F.when(named, finite(F.coalesce(F.get_json_object(point, f"$.{name}"), F.lit("0"))))


def validated(rows: DataFrame, spec: str, question: str) -> DataFrame:
    """The rows with kind, title, x_label, y_label, categories and series (name, data, points); kind is null if the chart is void.

    Values are aligned with the categories, what is no number is null in its place, and a series
    without any number goes; points of a scatter chart with a bad coordinate go, null counting as 0.
    """
    c = F.from_json(F.col(spec), SHAPE)["chart"]
    named = lambda s: F.coalesce(_short(s["name"], TITLE), F.lit("Series"))
    out = rows.withColumn("__c", c).withColumn("categories", F.transform(F.slice(F.coalesce("__c.categories", F.array().cast("array<string>")), 1, CATEGORIES), lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("—"))))
    raw = F.slice(F.coalesce("__c.series", F.array().cast("array<struct<name:string,data:array<string>>>")), 1, SERIES)
    aligned = F.filter(F.transform(raw, lambda s: F.struct(named(s).alias("name"), F.transform(F.col("categories"), lambda _, i: finite(F.get(s["data"], i))).alias("data"))), lambda s: F.exists(s["data"], lambda v: v.isNotNull()))
    points = F.filter(
        F.transform(raw, lambda s: F.struct(named(s).alias("name"), F.filter(F.transform(s["data"], lambda p: F.struct(_coordinate(p, "x").alias("x"), _coordinate(p, "y").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("points"))),
        lambda s: F.size(s["points"]) > 0,
    )
    scatter = F.col("__c.type") == "scatter"
    out = out.withColumn("series", F.when(~scatter, aligned)).withColumn("scatter", F.when(scatter, points))
    good = F.col("__c.type").isin(*KINDS) & F.when(scatter, F.size("scatter") > 0).otherwise((F.size("categories") > 0) & (F.size("series") > 0))
    return out.withColumns({
        "kind": F.when(good, F.col("__c.type")),
        "title": F.when(good, F.coalesce(_short(F.col("__c.title"), TITLE), _short(F.col(question), TITLE), F.lit("Chart"))),
        "x_label": F.when(good & ~scatter, _short(F.col("__c.xAxisLabel"), LABEL)),
        "y_label": F.when(good & ~scatter, _short(F.col("__c.yAxisLabel"), LABEL)),
    }).drop("__c")


def pivoted(charts: DataFrame, key: str) -> DataFrame:
    """(key, place, category, series, value): one row per category and series."""
    one = charts.where("kind is not null and kind <> 'scatter'").select(key, "categories", F.explode("series").alias("s"))
    return one.select(key, F.posexplode(F.arrays_zip("categories", "s.data")).alias("place", "z"), F.col("s.name").alias("series")).select(key, "place", F.col("z.categories").alias("category"), "series", F.col("z.data").alias("value"))


def pie_rows(charts: DataFrame, key: str) -> DataFrame:
    """(key, place, name, value) of pie charts: the first series only, missing numbers as 0."""
    pies = charts.where("kind = 'pie'").select(key, F.posexplode("categories").alias("place", "name"), F.get("series", F.lit(0))["data"].alias("d"))
    return pies.select(key, "place", "name", F.coalesce(F.get("d", F.col("place")), F.lit(0.0)).alias("value"))
