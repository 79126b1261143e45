"""Queries on line and area charts, on the chunks of whole sheets, and on folding of compatibility characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import charts, chunking

from .base import Book
from .texts import FOLD

book = Book()
query = book.query


@query("chart_lines", """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS place FROM d QUALIFY place < 50),
 v AS (SELECT event_type, place, day, unnest(['Events', 'Series']) AS series, unnest([n::DOUBLE, CASE WHEN u % 3 <> 0 THEN u::DOUBLE END]) AS value FROM p)
 SELECT event_type || ':' || kind AS chart, kind, 'Day' AS x_label, repeat('y', 60) AS y_label, CAST(place AS BIGINT) AS place, day AS category, series, value
 FROM v, (VALUES ('line'), ('area')) k(kind) QUALIFY count(value) OVER (PARTITION BY event_type, kind, series) > 0""")
def _(t):
    """Lines and areas of several series: values that are no numbers are gaps, a series of none of them goes, labels are cut."""
    days = t.events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    rows = days.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "n", "u"))).alias("r")).withColumn("kind", F.explode(F.array(F.lit("line"), F.lit("area"))))
    series = lambda name, value: F.struct(F.lit(name).alias("name"), F.transform("r", value).alias("data"))
    users = lambda x: F.when(x["u"] % 3 == 0, F.lit("n/a")).otherwise(x["u"].cast("string"))
    given = F.array(series(" Events ", lambda x: x["n"].cast("string")), series("", users), series("Void", lambda x: F.concat(F.lit("on "), x["day"])))
    labels = (F.lit("  Day ").alias("xAxisLabel"), F.repeat(F.lit("y"), 70).alias("yAxisLabel"))
    chart = F.struct(F.col("kind").alias("type"), F.col("event_type").alias("title"), *labels, F.transform("r", lambda x: x["day"]).alias("categories"), given.alias("series"))
    specs = rows.select(F.concat_ws(":", "event_type", "kind").alias("chart"), F.to_json(F.struct(chart.alias("chart"))).alias("spec"), F.lit("").alias("question"))
    checked = charts.validated(specs, "spec", "question")
    placed = charts.pivoted(checked, "chart").withColumn("place", F.col("place").cast("long"))
    return placed.join(checked.select("chart", "kind", "x_label", "y_label"), "chart").select("chart", "kind", "x_label", "y_label", "place", "category", "series", "value")


@query("sheet_chunks", """WITH RECURSIVE r AS (SELECT *, length(line) AS n FROM (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k,
   'Order: ' || o_orderkey || ' | Col2: ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END || ' | Priority: ' || o_orderpriority AS line FROM orders)),
 s AS (SELECT c, k, line, 0::BIGINT AS chunk, n + 1 AS chars FROM r WHERE k = 1
 UNION ALL SELECT r.c, r.k, r.line, s.chunk + (s.chars + r.n > 200)::BIGINT, CASE WHEN s.chars + r.n > 200 THEN 0 ELSE s.chars END + r.n + 1 FROM s JOIN r ON r.c = s.c AND r.k = s.k + 1),
 h AS (SELECT c_custkey, 'Workbook: customer' || c_custkey || '.xlsx' || chr(10) || 'Sheet: ' || c_mktsegment || chr(10) || 'Columns: Order, , Priority' || chr(10) || chr(10) AS head FROM customer),
 e AS (SELECT c_custkey, 'Workbook: customer' || c_custkey || '.xlsx' || chr(10) || 'Sheet: Notes' || chr(10) || 'Columns: Note' || chr(10) || chr(10) || '(No data rows)' AS text FROM customer),
 p AS (SELECT c, chunk, (min(k) + 1) || '-' || (max(k) + 1) AS row_range, string_agg(line, chr(10) ORDER BY k) AS lines FROM s GROUP BY ALL)
 SELECT c_custkey, 0 AS place, coalesce(chunk, 0) AS chunk, CASE WHEN chunk IS NULL THEN head || '(No data rows)' ELSE head || 'Rows ' || row_range || chr(10) || chr(10) || lines END AS text, row_range FROM h LEFT JOIN p ON c = c_custkey
 UNION ALL SELECT c_custkey, 1, 0, text, NULL FROM e""")
def _(t):
    """Every customer is a workbook: a sheet of its orders, a header alone where there are none, and a sheet of a header alone."""
    path = F.col("c_custkey").cast("string").alias("path")
    name = F.concat(F.lit("customer"), "c_custkey", F.lit(".xlsx")).alias("filename")
    book = (path, F.lit(0).alias("place"), name, F.col("c_mktsegment").alias("sheet"))
    notes = t.customer.select(path, F.lit(1).alias("place"), name, F.lit("Notes").alias("sheet"), F.lit(1).cast("long").alias("row"), F.array(F.lit("Note")).alias("values"))
    heads = t.customer.select(*book, F.lit(1).cast("long").alias("row"), F.array(F.lit(" Order "), F.lit(""), F.lit("Priority")).alias("values"))
    values = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")), F.col("o_orderpriority"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(*book, (F.col("o_orderkey") + 2).alias("row"), values.alias("values"))
    out = chunking.sheet_chunks(heads.unionByName(notes).unionByName(rows), 200)
    return out.select(F.col("path").cast("long").alias("c_custkey"), "place", "chunk", "text", "row_range")


@query("search_fold", f"SELECT doc_id, md5({FOLD.format('text')}) AS digest FROM documents")
def _(t):
    """Texts in which ligatures and full-width digits and capitals stand for plain ones fold to the plain text's form."""
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    typeset = F.replace(F.replace(F.translate("text", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", wide), F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ"))
    return t.documents.select("doc_id", F.md5(text.search_folded(typeset)).alias("digest"))
