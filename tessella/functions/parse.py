"""JSON values as Columns: bad input gives the fallback that the caller names, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: characters of precise data that go into a chart prompt.
PROMPT_DATA = 40_000


def embedding(value: Column, width: int) -> Column:
    """A vector from a JSON array, a JSON string that holds one, or an object whose values are one; null unless of ``width`` numbers."""
    listed = F.from_json(F.get_json_object(value, "$"), "array<double>")
    named = F.map_entries(F.from_json(value, "map<string,double>"))
    ordered = F.transform(F.array_sort(F.transform(named, lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))), lambda e: e["v"])
    found = F.coalesce(listed, F.when(F.startswith(F.ltrim(value), F.lit("{")), ordered))
    return F.when((F.size(found) == width) & ~F.exists(found, lambda x: x.isNull()), found)


def summary(raw: Column) -> Column:
    """(overview, key_points) of a summary; what is no JSON object is its own overview."""
    parsed = F.from_json(raw, "overview string, keyPoints array<string>")
    good = F.try_parse_json(raw).isNotNull() & F.startswith(F.ltrim(raw), F.lit("{"))
    none = F.array().cast("array<string>")
    return F.struct(F.when(good, parsed["overview"]).otherwise(F.trim(raw)).alias("overview"), F.when(good, F.coalesce(parsed["keyPoints"], none)).otherwise(none).alias("key_points"))


def job(message: Column) -> Column:
    """(type, docId) of a job message; null if it is no JSON or names no document."""
    parsed = F.from_json(message, "type string, docId string")
    return F.when(F.try_parse_json(message).isNotNull() & parsed["docId"].isNotNull(), parsed)


def tool_query(arguments: Column) -> Column:
    """The query of a tool call's arguments, empty if there is none or they are no JSON."""
    value = F.try_parse_json(F.coalesce(F.nullif(arguments, F.lit("")), F.lit("{}")))
    return F.coalesce(F.try_variant_get(value, "$.query", "string"), F.lit(""))


def sheet_metadata(value: Column) -> Column:
    """(sheet, first_row, last_row, headers) of a chunk's metadata."""
    m = F.from_json(value, "sheetName string, rowRange string, columnHeaders array<string>")
    rows = F.split(m["rowRange"], "-")
    return F.struct(m["sheetName"].alias("sheet"), F.try_element_at(rows, F.lit(1)).cast("long").alias("first_row"), F.try_element_at(rows, F.lit(2)).cast("long").alias("last_row"), m["columnHeaders"].alias("headers"))


def prompt_data(rows: DataFrame, key: str, order: str, columns: list[str], most: int = PROMPT_DATA) -> DataFrame:
    """(key, data): the rows of each key as a JSON array of objects in order, cut at ``most`` characters.

    What would be cut off is never gathered: a row takes three characters at least, so a running number drops most of a large key before
    it is dealt, and a running length the rest.
    """
    own = Window.partitionBy(key).orderBy(order)
    piece = rows.select(key, order, F.to_json(F.struct(*columns)).alias("__json"))
    few = piece.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= most // 3 + 1)
    placed = few.withColumn("__at", F.sum(F.length("__json") + 1).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("__json"))
    kept = placed.where(F.col("__at") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", "__json"))).alias("__r"))
    return kept.select(key, F.substring(F.concat(F.lit("["), F.array_join(F.transform("__r", lambda r: r["__json"]), ","), F.lit("]")), 1, most).alias("data"))
