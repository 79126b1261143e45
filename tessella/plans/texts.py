"""Queries of text functions, chunks and keywords."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import chunking, topics

from .base import FILES, Book

book = Book()
query = book.query
quoted = ", ".join(f"'{w}'" for w in text.STOPWORDS)
FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9\\s.-]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEYWORDS = f"list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: length(w) > 3 AND w NOT IN ({quoted}))"


def clean_sql(t: str) -> str:
    """Sanitised text in SQL."""
    return rf"nfc_normalize(regexp_replace(regexp_replace(replace({t}, chr(65533), ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\\([^\\ntbrfux]|$)', '\1', 'g'))"


def units_sql(size: int) -> str:
    """Tables ``plain`` (doc_id, t) and ``parts`` (doc_id, i, part): the units of every text, in order."""
    return rf"""plain AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents),
paragraphs AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '
\s*
'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM plain),
units AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) <= {size} THEN [p] ELSE flatten(list_transform(string_split(regexp_replace(p, '([.?!])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)),
 lambda s: CASE WHEN length(s) <= {size} THEN [s] ELSE list_transform(range(1, length(s) + 1, {size}), lambda i: substring(s, i, {size})) END)) END)) AS u FROM paragraphs),
parts AS (SELECT doc_id, unnest(u) AS part, generate_subscripts(u, 1) AS i FROM units)"""


def chunks_sql(size: int) -> str:
    """Tables up to ``chunks`` (doc_id, chunk_index, c): the fold of units, one a step, over all documents at once."""
    overlap = int(size * chunking.SHARE + 0.5)
    return rf"""RECURSIVE {units_sql(size)},
fold AS (SELECT doc_id, 1::BIGINT AS i, [part] AS open, length(part) AS n, NULL::VARCHAR AS done FROM parts WHERE i = 1
 UNION ALL SELECT doc_id, i, list_append(CASE WHEN is_full THEN open[len(open) - carry + 1:] ELSE open END, part), CASE WHEN is_full THEN sums[carry] ELSE n END + room, CASE WHEN is_full THEN list_aggregate(open, 'string_agg', chr(10) || chr(10)) END
 FROM (SELECT *, least(len(open), 1 + len(list_filter(sums, lambda x: x < {overlap}))) AS carry FROM (SELECT f.doc_id, p.i, f.open, f.n, p.part, length(p.part) + 2 AS room, f.n > 0 AND f.n + length(p.part) + 2 > {size} AS is_full,
  list_transform(range(1, len(f.open) + 1), lambda k: list_sum(list_transform(f.open[len(f.open) - k + 1:], lambda x: length(x) + 2))::BIGINT) AS sums FROM fold f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i + 1))),
ends AS (SELECT doc_id, i, done AS c FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(i) + 1, arg_max(list_aggregate(open, 'string_agg', chr(10) || chr(10)), i) FROM fold GROUP BY doc_id),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, c FROM (SELECT doc_id, i, {clean_sql('c')} AS c FROM ends) WHERE trim(c) <> '')"""


@query("sanitize_text", f"SELECT doc_id, md5({clean_sql('t')}) AS digest FROM (SELECT doc_id, text || chr(1) || chr(65533) || 'a\\qbe' || chr(769) || 'A' || chr(778) AS t FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.md5(text.sanitised(F.concat("text", F.lit("\x01\ufffda\\qbe\u0301A\u030a")))).alias("digest"))


@query("normalize_text", f"SELECT doc_id, md5({FOLD.format('text')}) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.folded(F.col("text"))).alias("digest"))


@query("token_stats", f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, list_filter(string_split({FOLD.format('text')}, ' '), lambda x: length(x) > 2) AS w FROM documents)")
def _(t):
    w = text.tokens(F.col("text"))
    return t.documents.select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("sentence_counts", r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.?!])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS n_sentences,
 len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS n_paragraphs FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.size(text.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


@query("word_page_counts", r"""SELECT doc_id, len(string_split(text, ' ')) AS n_words, CAST(ceil(len(string_split(text, ' ')) / 200.0) AS BIGINT) AS minutes,
 greatest(1, CAST(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / 400.0) AS BIGINT)) AS pages FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n_words"), text.read_minutes(F.col("text")).alias("minutes"), text.page_count(F.col("text")).alias("pages"))


@query("read_time", "SELECT lang, CAST(sum(CAST(ceil(len(string_split(text, ' ')) / 200.0) AS BIGINT)) AS BIGINT) AS minutes FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.sum(text.read_minutes(F.col("text"))).alias("minutes"))


@query("page_slices", r"SELECT doc_id, md5(list_aggregate(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:400], 'string_agg', ' ')) AS first_page FROM documents WHERE regexp_matches(text, '\S') UNION ALL SELECT doc_id, md5('') FROM documents WHERE NOT regexp_matches(text, '\S')")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.md5(text.up_to_page(F.col("text"), 1)).alias("first_page"))


@query("context_lines", r"SELECT doc_id, regexp_replace(substring(text, 1, 600), '\n+', ' ', 'g') AS line, length(substring(text, 1, 8000)) AS embed_chars, length(substring(text, 1, 1500)) AS topic_chars, length(substring(text, 1, 12000)) AS insight_chars FROM documents")
def _(t):
    return t.documents.select("doc_id", text.context_line(F.col("text")).alias("line"), *[F.length(F.substring("text", 1, n)).cast("long").alias(c) for c, n in (("embed_chars", 8000), ("topic_chars", 1500), ("insight_chars", 12000))])


@query("ocr_cleanup", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\f', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest
 FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(10)) || chr(12) || chr(10) || chr(10) || 'end ' AS t FROM documents)""")
def _(t):
    raw = F.concat(F.replace(F.col("text"), F.lit(". "), F.lit(".  \n")), F.lit("\f\n\nend "))
    return t.documents.select("doc_id", F.md5(text.ocr_cleaned(raw)).alias("digest"))


@query("markdown_strip", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```[\s\S]*?```', '', 'g'), '`([^`]*)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '#+\s?', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '>\s?|^\s+|\s+$', '', 'g')) AS digest
 FROM (SELECT doc_id, '# T **b** `c` [l](u) ' || text AS t FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.md5(text.without_markdown(F.concat(F.lit("# T **b** `c` [l](u) "), "text"))).alias("digest"))


@query("markdown_lines", r"""SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(l, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(l, '^\s*[-*]\s') THEN 'bullet' WHEN regexp_matches(l, '^\s*\d+\.\s') THEN 'number' WHEN trim(l) = '' THEN 'blank' ELSE 'text' END AS kind
 FROM (SELECT doc_id, unnest(string_split('# Title' || chr(10) || '- a' || chr(10) || chr(10) || '1. b' || chr(10) || text, chr(10))) AS l FROM documents)) GROUP BY ALL""")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split(F.concat(F.lit("# Title\n- a\n\n1. b\n"), "text"), "\n")).alias("l"))
    return lines.select("doc_id", text.line_kind(F.col("l")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("slugs", r"SELECT DISTINCT p_type, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'chart') AS slug FROM part")
def _(t):
    return t.part.select("p_type", text.slug(F.col("p_type")).alias("slug")).distinct()


@query("human_size", r"""SELECT o_orderkey, CASE WHEN b = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(b / power(1024, s), 2)), '0+$', ''), '\.$', '') || ' ' || (['Bytes','KB','MB','GB'])[s + 1] END AS size
 FROM (SELECT o_orderkey, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS s FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 7) % 5000000000 AS b FROM orders))""")
def _(t):
    size = (F.col("o_orderkey") * F.col("o_orderkey") * 7) % 5000000000
    return t.orders.select("o_orderkey", text.human_size(size).alias("size"))


@query("relative_day_label", """SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS label
 FROM (SELECT o_orderkey, o_orderdate, CAST(floor(epoch(TIMESTAMP '1998-08-02 12:00:00' - o_orderdate) / 86400) AS BIGINT) AS d FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", text.relative_day(F.col("o_orderdate"), F.lit("1998-08-02 12:00:00")).alias("label"))


@query("file_routes", f"""WITH {FILES} SELECT doc_id, filename, CASE split_part(filename, '.', 2) WHEN 'xlsx' THEN 'spreadsheet' WHEN 'csv' THEN 'spreadsheet' WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'docx' THEN 'docx' ELSE 'image' END AS route,
 CASE split_part(filename, '.', 2) WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END AS mime, length(text) < 50 AS needs_ocr FROM files""")
def _(t):
    return t.files.select("doc_id", "filename", text.file_route(F.upper("filename")).alias("route"), text.mime_type(F.col("filename")).alias("mime"), (F.length("text") < 50).alias("needs_ocr"))


@query("question_intents", """SELECT conv_id, turn, regexp_matches(lower(text), 'chart|graph|plot|visuali[zs]|trend|breakdown|distribution|compare|over time') AS chart, regexp_matches(lower(text), 'topic|cluster|categor|group') AS topics, replace(text, '*', '') AS plain FROM conversations WHERE role = 'user'""")
def _(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", text.wants_chart(F.col("text")).alias("chart"), text.asks_for_topics(F.col("text")).alias("topics"), F.translate("text", "*", "").alias("plain"))


@query("figure_texts", """SELECT item_id, '[Figure Analysis]' || chr(10) || text || chr(10) || chr(10) || '[OCR Text]' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '(no text detected)' ELSE 'x' END AS content FROM benchmark""")
def _(t):
    return t.benchmark.select("item_id", text.figure_text(F.col("text"), F.when(F.col("item_id") % 2 == 0, "").otherwise("x")).alias("content"))


@query("keyword_distribution", f"WITH w AS (SELECT doc_id, unnest({KEYWORDS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, word, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS weight FROM c")
def _(t):
    return topics.keyword_weights(t.documents, "doc_id").withColumn("weight", F.round("weight", 6))


@query("keyword_top2_name", f"""WITH w AS (SELECT doc_id, unnest({KEYWORDS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM c)
 SELECT d.doc_id, coalesce(string_agg(upper(word[1]) || word[2:], ' ' ORDER BY k), 'General Documents') AS name FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND k <= 2 GROUP BY d.doc_id""")
def _(t):
    words = t.documents.select("doc_id", F.explode(text.keywords(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    top = words.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("k <= 2")
    names = top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda s: F.concat(F.upper(F.substr(s["word"], F.lit(1), F.lit(1))), F.substr(s["word"], F.lit(2)))), " ").alias("name"))
    return t.documents.select("doc_id").join(names, "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("General Documents")))


@query("chunk_lengths", f"WITH {chunks_sql(chunking.PUBLIC_SIZE)} SELECT doc_id, chunk_index, length(c) AS n_chars, md5(c) AS digest FROM chunks")
def _(t):
    return chunking.chunked(t.documents, "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("chunk_counts", f"WITH {chunks_sql(chunking.PRIVATE_SIZE)} SELECT doc_id, count(*) AS n_chunks, max(chunk_index) AS last_index FROM chunks GROUP BY doc_id")
def _(t):
    return chunking.chunked(t.documents, "doc_id", size=chunking.PRIVATE_SIZE).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").cast("long").alias("last_index"))


@query("chunk_units", f"WITH {units_sql(300)} SELECT doc_id, count(part) AS n_units, coalesce(max(length(part)), 0) AS longest, md5(coalesce(string_agg(part, '|' ORDER BY i), '')) AS digest FROM plain LEFT JOIN parts USING (doc_id) GROUP BY doc_id")
def _(t):
    """Small units, so that sentences are sliced too."""
    rows = t.documents.select("doc_id", chunking.units(text.sanitised(F.col("text")), 300).alias("u"))
    return rows.select("doc_id", F.size("u").cast("long").alias("n_units"), F.coalesce(F.array_max(F.transform("u", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join("u", "|")).alias("digest"))


@query("text_gate", f"SELECT doc_id, length({clean_sql('t')}) >= 50 AS passes FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 49) || repeat(chr(1), 20) ELSE text END AS t FROM documents)")
def _(t):
    """Control characters do not help a text over the gate."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 49), F.repeat(F.lit("\x01"), 20))).otherwise(F.col("text"))
    return t.documents.select("doc_id", (F.length(text.sanitised(raw)) >= 50).alias("passes"))


@query("dedup_by_sha", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY sha256(text)")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("dedup_cap", """WITH k AS (SELECT source, min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE length(text) >= 100 GROUP BY source, sha256(text))
 SELECT source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM k) WHERE place <= 40""")
def _(t):
    kept = t.documents.where(F.length("text") >= 100).groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("place <= 40").select("source", "doc_id", F.col("place").cast("long").alias("place"))


@query("row_buckets", """WITH RECURSIVE r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, n) AS k, n FROM (SELECT *, length('Order: ' || l_orderkey || ' | Line: ' || l_linenumber || ' | Col3: ' || l_returnflag || ' | Part: ' || l_partkey) AS n FROM lineitem)),
 s AS (SELECT l_suppkey, k, 0::BIGINT AS bucket, n + 1 AS chars FROM r WHERE k = 1
 UNION ALL SELECT r.l_suppkey, r.k, s.bucket + (s.chars + r.n > 2200)::BIGINT, CASE WHEN s.chars + r.n > 2200 THEN 0 ELSE s.chars END + r.n + 1 FROM s JOIN r ON r.l_suppkey = s.l_suppkey AND r.k = s.k + 1)
 SELECT l_suppkey, bucket, min(k) + 1 AS first, max(k) + 1 AS last, max(chars) AS chars FROM s GROUP BY ALL""")
def _(t):
    row = chunking.row_text(["Order", "Line", "", "Part"], F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")]))
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.length(row).alias("n"))
    placed = chunking.row_buckets(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "n"], "n", 2200)
    return placed.groupBy("l_suppkey", "bucket").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.max("chars").alias("chars"))


@query("row_texts", "SELECT l_orderkey, l_linenumber, 'Order: ' || l_orderkey || ' | Line: ' || l_linenumber || ' | Col3: ' || l_returnflag AS line FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", chunking.row_text(["Order", "Line", ""], F.array(*[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_returnflag")])).alias("line"))
