"""Queries of JSON, labels, sheets, images, topic changes, codes and other small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import parse, text, vectors
from tessella.operators import charts, lexical, models, mutations, rules, search, topics
from tessella.session import materialise, scratch_path
from tessella.sources import files

from .base import FILES, Book
from .retrieval import ANSWERS, COSINE, MEANS, NAMED, answers, named_files

book = Book()
query = book.query


def total(vector):
    return F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6)


def counted_letters(texts: list[str]) -> list[list[float]]:
    """A model that needs no network: how many letters, and how many of them e."""
    if any(len(x) < 60 for x in texts):
        raise ValueError("too short")
    return [[float(len(x)), float(x.count("e"))] for x in texts]


# Text and labels


@query("storage_texts", """SELECT o_orderkey, CASE WHEN b / 1048576 < 1024 THEN CAST(floor(b / 1048576 + 0.5) AS BIGINT) || ' MB' ELSE printf('%.1f', round(b / 1073741824, 1)) || ' GB' END AS size
 FROM (SELECT o_orderkey, ((o_orderkey * o_orderkey * 7919) % 5000000000)::DOUBLE AS b FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", text.storage_text(F.col("o_orderkey") * F.col("o_orderkey") * 7919 % 5000000000).alias("size"))


@query("file_icons", f"""WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'File' WHEN doc_id % 7 = 1 THEN 'Video' ELSE CASE split_part(filename, '.', 2) WHEN 'pdf' THEN 'FileText' WHEN 'txt' THEN 'FileText' WHEN 'docx' THEN 'FileText' WHEN 'png' THEN 'Image' ELSE 'Sheet' END END AS icon FROM files""")
def _(t):
    name = F.when(F.col("doc_id") % 7 == 0, F.concat("filename", F.lit(".zip"))).when(F.col("doc_id") % 7 == 1, F.concat("filename", F.lit(".MP4"))).otherwise(F.col("filename"))
    return t.files.select("doc_id", text.icon(name).alias("icon"))


@query("figure_keys", f"WITH {FILES} SELECT doc_id, 'uploads/' || owner || '/' || project || '/' || doc_id || '/figures/' || doc_id % 40 || '.png' AS key FROM files")
def _(t):
    return t.files.select("doc_id", text.figure_key(F.col("owner"), F.col("project"), F.col("doc_id"), F.col("doc_id") % 40).alias("key"))


@query("json_listing", r"""SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","createdAt":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}' AS body FROM orders""")
def _(t):
    """Rows as the JSON a caller gets, times in ISO form."""
    return t.orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), text.iso_time(F.col("o_orderdate")).alias("createdAt"))).alias("body"))


@query("pdf_page_shares", "SELECT doc_id, md5(left(text, CAST(ceil(length(text) * least(2, 1 + doc_id % 5) / (1 + doc_id % 5)) AS BIGINT))) AS shown FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.up_to_share(F.col("text"), F.lit(2), 1 + F.col("doc_id") % 5)).alias("shown"))


@query("preview_strip", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,4}\s+', '', 'g'), '(?m)^[-*]\s+', '', 'g'), '(?m)^\d+[.)]\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\n+', ' ', 'g'))) AS digest
 FROM (SELECT doc_id, '## T' || chr(10) || '- a **b** `c`' || chr(10) || '1. d' || chr(10) || text AS t FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.md5(text.preview(F.concat(F.lit("## T\n- a **b** `c`\n1. d\n"), "text"))).alias("digest"))


MARKED = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 kinds AS (SELECT doc_id, i, line, CASE i % 7 WHEN 1 THEN 'heading' WHEN 2 THEN 'bullet' WHEN 3 THEN 'bullet' WHEN 4 THEN 'number' WHEN 5 THEN 'blank' ELSE 'text' END AS kind FROM lines WHERE regexp_matches(line, '[\\w]'))"""


@query("markdown_blocks", f"""WITH {MARKED}, starts AS (SELECT *, CASE WHEN kind = 'heading' OR kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), '') THEN 1 ELSE 0 END AS fresh FROM kinds),
 blocks AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM starts), grouped AS (SELECT doc_id, b, any_value(kind) AS kind, count(*) AS n, sum(length(trim(line, ' ' || chr(9)))) AS letters FROM blocks GROUP BY doc_id, b)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) AS BIGINT) AS place, kind, CASE WHEN kind = 'text' THEN 1 ELSE n END AS n_items, CAST(letters + CASE WHEN kind = 'text' THEN n - 1 ELSE 0 END AS BIGINT) AS letters FROM grouped WHERE kind <> 'blank'""")
def _(t):
    """Every line of a text is marked by its place as heading, bullet, number, blank or plain, and read back as blocks."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    kept = F.filter(lines, lambda s: F.rlike(s["x"], F.lit(r"\w")))
    mark = lambda s: F.when(s["i"] % 7 == 1, F.concat(F.lit("## "), s["x"])).when((s["i"] % 7).isin(2, 3), F.concat(F.lit("- "), s["x"])).when(s["i"] % 7 == 4, F.concat(F.lit("7. "), s["x"])).when(s["i"] % 7 == 5, F.lit("  ")).otherwise(s["x"])
    body = F.array_join(F.transform(kept, mark), "\n")
    blocks = t.documents.select("doc_id", F.posexplode(text.markdown_blocks(body)).alias("place", "b"))
    letters = F.aggregate("b.items", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return blocks.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "b.kind", F.size("b.items").cast("long").alias("n_items"), letters.alias("letters"))


@query("citation_parts", r"""SELECT conv_id, turn, k AS place, part, k % 2 = 0 AS cited FROM (SELECT conv_id, turn, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM
 (SELECT conv_id, turn, [text || ' see ', 'Q3 report (final).pdf', ' and ', 'a+b.txt', '.'] AS p FROM conversations WHERE role = 'assistant'))""")
def _(t):
    """Answers cut at the names they cite, taken literally."""
    answer = F.concat("text", F.lit(" see Q3 report (final).pdf and a+b.txt."))
    parts = text.cited_parts(answer, F.array(F.lit("a+b.txt"), F.lit("Q3 report (final).pdf"), F.lit("nowhere.pdf")))
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(parts).alias("place", "p"))
    return rows.select("conv_id", "turn", (F.col("place") + 1).cast("long").alias("place"), "p.part", "p.cited")


@query("image_texts", """SELECT item_id, '[Image Analysis]' || chr(10) || text || chr(10) || chr(10) || '[OCR Text]' || chr(10) || CASE WHEN item_id % 3 = 0 THEN '(no text detected)' ELSE 'read' END AS content FROM benchmark""")
def _(t):
    return t.benchmark.select("item_id", text.image_text(F.col("text"), F.when(F.col("item_id") % 3 == 0, "  ").otherwise(" read ")).alias("content"))


@query("ocr_pages", """WITH p AS (SELECT l_orderkey, l_linenumber % 3 AS page, arg_min(l_returnflag || l_partkey, (-l_quantity * l_suppkey, l_linenumber, l_partkey)) FILTER (l_suppkey % 10 > 0) AS t FROM lineitem GROUP BY ALL)
 SELECT l_orderkey AS path, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page), '') AS content FROM p GROUP BY ALL""")
def _(t):
    """Order lines as the images of scanned pages; some hold no text."""
    words = F.when(F.col("l_suppkey") % 10 > 0, F.concat(F.lit(" "), "l_returnflag", "l_partkey", F.lit(" \n"))).otherwise(F.lit(" "))
    images = t.lineitem.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 3).alias("page"), F.struct("l_linenumber", "l_partkey").alias("place"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_quantity")).otherwise(0.0).alias("width"), F.col("l_suppkey").alias("height"), words.alias("text"))
    return files.ocr_text(images)


# JSON


@query("embedding_json", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 4 <> 3")
def _(t):
    values = vectors.doubles(F.col("embedding"))
    listed = F.to_json(values)
    named = F.to_json(F.map_from_entries(F.transform(values, lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))))
    raw = F.when(F.col("vec_id") % 4 == 0, listed).when(F.col("vec_id") % 4 == 1, F.concat(F.lit('"'), listed, F.lit('"'))).when(F.col("vec_id") % 4 == 2, named).otherwise(F.lit("[1, 2"))
    found = t.embeddings.select("vec_id", parse.embedding(raw, 64).alias("v")).where("v is not null")
    return found.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("summary_json", """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Overview ' || item_id WHEN 1 THEN 'plain ' || item_id WHEN 2 THEN '[' || item_id || ', "no object"]' ELSE '{"overview": "cut ' || item_id END AS overview, CASE WHEN item_id % 4 = 0 THEN 2 ELSE 0 END AS n_points FROM benchmark""")
def _(t):
    raw = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('{"overview": "Overview '), "item_id", F.lit('", "keyPoints": ["a", "b"]}'))).when(F.col("item_id") % 4 == 1, F.concat(F.lit(" plain "), "item_id")).when(F.col("item_id") % 4 == 2, F.concat(F.lit(" ["), "item_id", F.lit(', "no object"]'))).otherwise(F.concat(F.lit('{"overview": "cut '), "item_id"))
    return t.benchmark.select("item_id", parse.summary(raw).alias("s")).select("item_id", "s.overview", F.size("s.key_points").alias("n_points"))


@query("job_messages", "SELECT event_id, event_type AS type, user_id::VARCHAR AS doc FROM events WHERE event_id % 5 > 1")
def _(t):
    body = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "docId": "'), "user_id", F.lit('", "more": [1]}'))
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).when(F.col("event_id") % 5 == 1, F.lit('{"type": "chunk"}')).otherwise(body)
    return t.events.select("event_id", parse.job(raw).alias("j")).where("j is not null").select("event_id", "j.type", F.col("j.docId").alias("doc"))


@query("tool_queries", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'find ' || item_id ELSE '' END AS query FROM benchmark")
def _(t):
    k = F.col("item_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"query": "find '), "item_id", F.lit('"}'))).when(k == 1, "").when(k == 2, "{bad").otherwise('{"other": 1}')
    return t.benchmark.select("item_id", parse.tool_query(raw).alias("query"))


@query("sheet_metadata", "SELECT o_orderkey, 'Sheet ' || o_orderstatus AS sheet, o_custkey AS first_row, o_custkey + 9 AS last_row, 2 AS n_headers FROM orders")
def _(t):
    meta = F.concat(F.lit('{"sheetName": "Sheet '), "o_orderstatus", F.lit('", "rowRange": "'), "o_custkey", F.lit("-"), F.col("o_custkey") + 9, F.lit('", "columnHeaders": ["A", "B"], "tableName": null}'))
    return t.orders.select("o_orderkey", parse.sheet_metadata(meta).alias("m")).select("o_orderkey", "m.sheet", "m.first_row", "m.last_row", F.size("m.headers").alias("n_headers"))


@query("prompt_data", "SELECT o_orderstatus, left('[' || string_agg('{\"id\":' || o_orderkey || ',\"p\":\"' || o_orderpriority || '\"}', ',' ORDER BY o_orderkey) || ']', 40000) AS data FROM orders GROUP BY o_orderstatus")
def _(t):
    """The orders of a status as JSON, which is longer than what is kept of it."""
    rows = t.orders.select("o_orderstatus", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))
    return parse.prompt_data(rows, "o_orderstatus", "id", ["id", "p"])


@query("later_header_wins", "SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, 2 AS n FROM orders")
def _(t):
    record = files.record(F.array(F.lit("A"), F.lit("B"), F.lit("A")), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", record.alias("r")).select("o_orderkey", F.col("r")["A"].alias("a"), F.col("r")["B"].alias("b"), F.size("r").alias("n"))


@query("pie_rows", """SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS BIGINT) AS place, day AS name, CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS value
 FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL) QUALIFY place < 50""")
def _(t):
    """Events of a type by day as the slices of a pie; odd counts are given as words, which are no numbers."""
    days = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    rows = days.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), "n"))).alias("r"))
    numbers = F.transform("r", lambda x: F.when(x["n"] % 2 == 0, x["n"].cast("string")).otherwise("many"))
    series = F.array(F.struct(F.lit("n").alias("name"), numbers.alias("data")), F.struct(F.lit("other").alias("name"), F.transform("r", lambda x: F.lit("1")).alias("data")))
    spec = F.to_json(F.struct(F.struct(F.lit("pie").alias("type"), F.transform("r", lambda x: x["day"]).alias("categories"), series.alias("series")).alias("chart")))
    return charts.pie_rows(charts.validated(rows.select("event_type", spec.alias("spec")), "spec", "event_type"), "event_type").withColumn("place", F.col("place").cast("long"))


@query("scatter_points", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n_points, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 5.0 WHEN 1 THEN o_custkey::DOUBLE WHEN 2 THEN 0.0 END AS x_total FROM orders""")
def _(t):
    """A point without a coordinate, or with one that is no number, goes; an explicit null counts as 0."""
    k = F.col("o_orderkey") % 4
    points = F.when(k == 0, F.concat(F.lit('{"x": '), "o_custkey", F.lit(', "y": 1}, {"x": "5", "y": 2}'))).when(k == 1, F.concat(F.lit('{"y": 3}, {"x": '), "o_custkey", F.lit(', "y": 1}'))).when(k == 2, F.lit('{"x": null, "y": 4}, {"x": "a", "y": 3}')).otherwise('{"x": 1}')
    spec = F.concat(F.lit('{"chart": {"type": "scatter", "series": [{"name": "s", "data": ['), points, F.lit("]}]}}"))
    out = charts.validated(t.orders.select("o_orderkey", spec.alias("spec"), F.lit("q").alias("q")), "spec", "q")
    p = F.col("scatter")[0]["points"]
    return out.select("o_orderkey", F.when(F.col("kind").isNotNull(), F.size(p)).otherwise(0).alias("n_points"), F.when(F.col("kind").isNotNull(), F.aggregate(p, F.lit(0.0), lambda a, x: a + x["x"])).alias("x_total"))


# Sheets


@query("preview_totals", """SELECT l_suppkey, count(*) AS total_rows, least(count(*), 500) AS shown, max(l_orderkey) FILTER (k <= 500) AS last_shown FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY ALL""")
def _(t):
    rows = files.preview(t.lineitem.select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row")), "l_suppkey", "row", 500)
    return rows.groupBy("l_suppkey").agg(F.max("total_rows").alias("total_rows"), F.count("*").alias("shown"), F.max("row.l_orderkey").alias("last_shown"))


# Retrieval


@query("fallback_context", """WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_totalprice > 400000 THEN o_totalprice END AS score FROM orders),
 b AS (SELECT *, count(score) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC NULLS LAST, o_orderkey) AS r FROM c)
 SELECT o_custkey AS query, o_orderkey AS id, coalesce(score, 0.0) AS score FROM b WHERE CASE WHEN n > 0 THEN score IS NOT NULL AND r <= 8 ELSE k <= 8 END""")
def _(t):
    """Customers as questions: their large orders scored, else their first eight with score 0."""
    every = t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"))
    return search.or_first(every, t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), 8)


@query("merged_retrievals", """WITH a AS (SELECT o_custkey AS query, o_orderkey % 50 AS id, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS query, o_orderkey % 50 AS id, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL),
 m AS (SELECT query, id, max(score) AS score FROM (FROM a UNION ALL FROM b) GROUP BY ALL) SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 5""")
def _(t):
    """Two sources ranked together; what both find counts once, with its better score."""
    found = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 50).alias("id")).agg(F.max("o_totalprice").alias("score"))
    return search.merged([found("F"), found("O")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("citation_departments", f"WITH {FILES}, {NAMED}, {ANSWERS} SELECT a.conv_id, a.turn, f.filename, n.n_name AS department FROM answers a JOIN named f ON contains(a.answer, f.filename) LEFT JOIN nation n ON n.n_nationkey = f.doc_id % 30")
def _(t):
    """Each file that an answer cites, with the department it belongs to."""
    files = named_files(t).select("doc_id", "filename").join(t.nation, F.col("doc_id") % 30 == F.col("n_nationkey"), "left")
    cited = lexical.with_names(answers(t), "answer", files, "filename")
    return cited.join(files, "filename").select("conv_id", "turn", "filename", F.col("n_name").alias("department"))


@query("key_resolution", "SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN 'org ' || n_name WHEN c_custkey % 2 = 0 THEN 'user ' || c_name END AS key FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    """The organisation's key counts before the user's own."""
    orgs = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("org "), "n_name")).alias("org"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user "), "c_name"))
    return t.customer.join(orgs, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("org", own).alias("key"))


@query("access_levels", """WITH d AS (SELECT c_custkey AS id, c_nationkey AS owner, c_custkey % 4 AS level, c_custkey % 5 AS department FROM customer), u AS (SELECT n_nationkey AS reader, n_regionkey AS department FROM nation)
 SELECT reader, count(*) AS visible FROM u JOIN d ON CASE level WHEN 0 THEN d.owner = reader WHEN 1 THEN d.owner % 3 = reader % 3 WHEN 2 THEN true ELSE d.department = u.department END GROUP BY reader""")
def _(t):
    """Private to the owner, shared by a project, open to all, or to a department: one equality join for each level."""
    docs = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 4).alias("level"), (F.col("c_custkey") % 5).alias("department"))
    readers = t.nation.select(F.col("n_nationkey").alias("reader"), F.col("n_regionkey").alias("its"))
    return rules.visible(docs, readers.withColumn("team", F.col("reader") % 3), docs.select("id", (F.col("owner") % 3).alias("team")))


# Sorting and lists


@query("missing_size_last", "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice ELSE 0 END DESC, o_orderkey) AS place FROM orders) WHERE place <= 100 UNION ALL SELECT o_orderkey, -place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice ELSE 0 END, o_orderkey) AS place FROM orders) WHERE place <= 20")
def _(t):
    """Largest first and smallest first; a missing size counts as 0."""
    size = F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")), F.lit(0.0))
    ends = lambda order, n, sign: t.orders.select("o_orderkey", size.alias("s")).orderBy(order, "o_orderkey").limit(n).select("o_orderkey", (F.row_number().over(Window.orderBy(order, "o_orderkey")) * sign).cast("long").alias("place"))
    return ends(F.desc("s"), 100, 1).unionByName(ends(F.col("s"), 20, -1))


@query("appended_insights", "SELECT l.doc_id, quality || '|' || toxic || CASE WHEN b.item_id IS NULL THEN '' ELSE '|new ' || b.item_id END AS insights FROM labels l LEFT JOIN benchmark b ON l.doc_id = b.item_id")
def _(t):
    now = t.labels.select("doc_id", F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("insights"))
    new = t.benchmark.select(F.col("item_id").alias("doc_id"), F.array(F.concat(F.lit("new "), "item_id")).alias("more"))
    return mutations.appended(now, new, "doc_id", "insights", "more").select("doc_id", F.array_join("insights", "|").alias("insights"))


@query("popular_plan", "SELECT p_type AS billing, count(*) AS plans, arg_max(p_partkey, (p_retailprice, p_partkey)) FILTER (p_size > 10) AS popular FROM part GROUP BY ALL")
def _(t):
    """Of the plans of an interval, in order of price, the last that costs something is the popular one."""
    paid = F.when(F.col("p_size") > 10, F.struct("p_retailprice", "p_partkey"))
    return t.part.groupBy(F.col("p_type").alias("billing")).agg(F.count("*").alias("plans"), F.max_by("p_partkey", paid).alias("popular"))


@query("plan_storage", "SELECT c_custkey, r_name AS plan, coalesce(b, 0) AS bytes FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS b FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    used = t.orders.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("b"))
    plans = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(plans, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(used, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("r_name").alias("plan"), F.coalesce("b", F.lit(0)).alias("bytes"))


# Changes


@query("insert_rows", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, 'new' FROM supplier")
def _(t):
    now = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return mutations.inserted(now, t.supplier.select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name")), {"kind": "new"})


@query("figure_chunks", "SELECT l_orderkey AS doc, 1000000 + l_linenumber::BIGINT AS chunk_index, CASE WHEN any_value(l_orderkey) % 2 = 0 THEN 'caption ' || max(l_partkey) ELSE 'old' END AS content FROM lineitem GROUP BY l_orderkey, l_linenumber")
def _(t):
    """Captions go to chunks of their own numbers; a caption that comes again replaces the one before."""
    place = ["doc", "chunk_index"]
    keys = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), mutations.figure_index(F.col("l_linenumber")).alias("chunk_index")).agg(F.max("l_partkey").alias("p"))
    return mutations.upsert(keys.select(*place, F.lit("old").alias("content")), keys.where("doc % 2 = 0").select(*place, F.concat(F.lit("caption "), "p").alias("content")), place)


@query("taken_once", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS taken FROM events WHERE event_type = 'purchase'")
def _(t):
    return mutations.first_take(t.events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("event_id", "taken")


@query("code_checks", """WITH e AS (SELECT *, event_type = 'signup' AS issued FROM events), c AS (SELECT *, last_value(CASE WHEN issued THEN epoch(ts)::BIGINT + 600 END IGNORE NULLS) OVER w AS ends, last_value(CASE WHEN issued THEN event_id % 3 END IGNORE NULLS) OVER w AS code FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT event_id, CASE WHEN ends IS NULL THEN 'none' WHEN epoch(ts) > ends THEN 'expired' WHEN code <> event_id % 3 THEN 'wrong' ELSE 'ok' END AS result FROM c WHERE NOT issued""")
def _(t):
    """Signups send a code for ten minutes, everything else enters one; the last code sent counts."""
    rows = t.events.select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("issued"), (F.col("event_id") % 3).alias("code"))
    return rules.checked_codes(rows, "user_id", "ts", "event_id").select("event_id", "result")


@query("checkout_refusals", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'manage' WHEN o_totalprice < 1000 THEN 'free' WHEN o_totalprice > 400000 THEN 'unknown' END AS refusal FROM orders")
def _(t):
    active = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)
    plan = F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", rules.checkout_refusal(active, plan, F.when(plan >= 1000, plan)).alias("refusal"))


@query("lifecycle_roles", """SELECT event_id, CASE WHEN prev IS NULL THEN 'start' WHEN (prev, event_type) = ('view', 'click') THEN 'ok' WHEN (prev, event_type) = ('click', 'purchase') THEN CASE WHEN user_id % 3 = 0 THEN 'ok' ELSE 'role' END ELSE 'state' END AS verdict
 FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def _(t):
    roles = F.when(F.col("user_id") % 3 == 0, "admin").otherwise("member")
    allowed = [("view", "click", "member"), ("view", "click", "admin"), ("click", "purchase", "admin")]
    return mutations.transition_verdicts(t.events.withColumn("role", roles), "user_id", ["ts", "event_id"], "event_type", "role", allowed).select("event_id", "verdict")


FIRSTS = f"WITH {MEANS}, f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), r AS (SELECT c.label, c.n, c.centroid, e.embedding::DOUBLE[] AS v FROM c JOIN f USING (label) JOIN embeddings e ON e.vec_id = f.vec_id)"
WITHOUT = "list_transform(list_zip(centroid, v), lambda z: (z[1] * n - z[2]) / (n - 1))"


def _with_firsts(t):
    """Topics with the vector of their first member, and keywords as the shares of its even and odd values."""
    first = t.embeddings.groupBy(F.col("label").alias("topic")).agg(F.min_by(vectors.doubles(F.col("embedding")), "vec_id").alias("v"))
    words = F.create_map(F.lit("a"), F.lit(0.75), F.lit("b"), F.lit(0.25))
    return topics.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "topic").join(first, "topic").withColumn("keywords", words)


@query("document_delete", FIRSTS + f" SELECT label AS topic, n - 1 AS n, round(list_sum({WITHOUT}), 6) AS total, round(0.75 * n / (n - 1), 6) AS a, round(0.25 * n / (n - 1), 6) AS b FROM r WHERE n > 1")
def _(t):
    """The first document of every topic is deleted; its keywords are not known any more, so weights are only rescaled."""
    left = topics.without_document(_with_firsts(t), F.lit(None).cast("map<string,double>"))
    return left.select("topic", "n", total(F.col("centroid")).alias("total"), *[F.round(F.col("keywords")[k], 6).alias(k) for k in ("a", "b")])


@query("topic_move", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 1000 + vec_id ELSE label END AS topic, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, topic AS source, CASE WHEN topic >= 1000 THEN vec_id % 10 ELSE (topic + 1) % 10 END AS target FROM e WHERE topic >= 1000 OR vec_id % 9 = 0),
 after AS (SELECT coalesce(target, topic) AS topic, v FROM e LEFT JOIN m USING (vec_id)), p AS (SELECT topic, place, avg(x) AS x, count(*) AS n FROM (SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM after) GROUP BY ALL)
 SELECT topic, any_value(n) AS n, round(sum(x), 6) AS total FROM p GROUP BY topic""")
def _(t):
    """Every ninth document goes to the next topic, and those that are topics of their own to a larger one, which ends theirs."""
    every = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 50 == 7, F.col("vec_id") + 1000).otherwise(F.col("label").cast("long")).alias("topic"), vectors.doubles(F.col("embedding")).alias("v"))
    alone = F.col("topic") >= 1000
    moves = every.where(alone | (F.col("id") % 9 == 0)).select("id", F.col("topic").alias("source"), F.when(alone, F.col("id") % 10).otherwise((F.col("topic") + 1) % 10).alias("target"), "v")
    return topics.moved(topics.centroids(every, "topic", "v"), moves).select("topic", F.col("n").cast("long").alias("n"), total(F.col("centroid")).alias("total"))


@query("put_figures", "SELECT doc_id, CASE WHEN length(text) % 4 = 0 THEN 'skipped' ELSE 'put' END AS result, CASE WHEN length(text) % 4 <> 0 THEN octet_length(encode(text)) + 4 END AS n_bytes FROM documents")
def _(t):
    """Figures are put into the shared folder one by one and read back; one that can't be is skipped and said to be, without losing the others."""
    folder = scratch_path(t.spark, "figures")
    image = F.when(F.length("text") % 4 != 0, F.concat(F.lit(b"\x89PNG"), F.encode("text", "UTF-8")))
    done = materialise(files.put_all(t.documents.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".png")).alias("key"), image.alias("image")), "doc_id", "key", "image", files.into_folder(folder)), "puts")
    there = t.spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"doc-(-?\d+)\.png$", 1).cast("long").alias("doc_id"), F.col("length").alias("n_bytes"))
    return done.join(there, "doc_id", "left")


@query("model_results", "SELECT doc_id, CASE WHEN length(text) >= 60 THEN length(left(text, 8000)) END AS letters, CASE WHEN length(text) >= 60 THEN length(left(text, 8000)) - length(replace(left(text, 8000), 'e', '')) END AS es, CASE WHEN length(text) < 60 AND trim(text) <> '' THEN 'ValueError: too short' END AS error FROM documents")
def _(t):
    """A stand-in model counts letters and refuses short texts; each text is sent once, and the second pass sends what failed only."""
    path = scratch_path(t.spark, "model-table")
    models.with_results(t.documents, "text", counted_letters, path).write.format("noop").mode("overwrite").save()
    out = models.with_results(t.documents, "text", counted_letters, path)
    return out.select("doc_id", F.col("result")[0].cast("long").alias("letters"), F.col("result")[1].cast("long").alias("es"), "error")
