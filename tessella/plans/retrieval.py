"""Queries of lexical and vector retrieval, topics and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text, vectors
from tessella.operators import charts, lexical, search, topics
from tessella.operators.vector_index import VectorIndex, recall

from .base import FILES, Book
from .texts import FOLD, KEYWORDS

book = Book()
query = book.query
TOKENS = "list_filter(string_split({}, ' '), lambda x: length(x) > 2)".format(FOLD.format("text"))


def bm25_sql(questions: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), q AS ({questions}), stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
 tf AS (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM d), c AS (SELECT doc_id, dl, token, count(*) AS tf FROM tf WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM c GROUP BY token),
 qq AS (SELECT query, token, count(*) AS qtf FROM q GROUP BY ALL),
 s AS (SELECT query, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM c JOIN df USING (token) JOIN qq USING (token), stats GROUP BY ALL)
 SELECT query, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 8"""


def shown(df):
    return df.select("query", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_topk", bm25_sql("SELECT 0 AS query, unnest(['the', 'than', 'heoron']) AS token"))
def _(t):
    asked = t.spark.createDataFrame([(0, "The than heoron?")], "query int, question string")
    return shown(lexical.bm25(t.documents, asked, "doc_id", "query"))


@query("bm25_benchmark_top8", bm25_sql(f"SELECT item_id AS query, unnest({TOKENS}) AS token FROM benchmark"))
def _(t):
    return shown(lexical.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("question")), "doc_id", "query"))


@query("bm25_pairs_scored", f"""WITH d AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents), q AS (SELECT DISTINCT item_id AS query, unnest({TOKENS}) AS token FROM benchmark)
 SELECT query, count(DISTINCT doc_id) AS n_sharing, true AS none_lost FROM q JOIN d USING (token) GROUP BY query""")
def _(t):
    """For each question the documents that share a token with it, and whether the best of all of them are among the few that are scored in full."""
    ask = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    checked = lexical.pairs_lost(lexical.Postings(t.documents, ask, "doc_id", "query"), 8)
    return checked.select("query", F.col("sharing").alias("n_sharing"), (F.col("lost") == 0).alias("none_lost"))


@query("context_by_document", bm25_sql(f"SELECT item_id AS query, unnest({TOKENS}) AS token FROM benchmark").replace("SELECT query, doc_id, round(score, 6) AS score, rank FROM (", "SELECT b.query, d.lang, string_agg('(' || b.rank || ') ' || regexp_replace(substring(d.text, 1, 600), '\\n+', ' ', 'g'), chr(10) ORDER BY b.rank) AS context FROM (SELECT query, doc_id, rank FROM (") + ") b JOIN documents d ON b.doc_id = d.doc_id GROUP BY b.query, d.lang")
def _(t):
    best = lexical.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("question")), "doc_id", "query")
    lines = best.join(t.documents.select("doc_id", "lang", text.context_line(F.col("text")).alias("line")), "doc_id")
    part = F.struct("rank", F.concat(F.lit("("), F.col("rank").cast("string"), F.lit(") "), "line").alias("l"))
    return lines.groupBy("query", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda s: s["l"]), "\n").alias("context"))


COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query("cosine_topk", f"""WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, {COSINE.format(a='q.embedding', b='c.embedding')} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
 SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 8""")
def _(t):
    e = t.embeddings
    out = search.cosine_topk(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding")
    return out.select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("usable_embeddings", "SELECT label, count(*) AS n, count(*) FILTER (list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 1e-8 AND len(embedding) = 64) AS usable FROM embeddings GROUP BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.count_if(vectors.usable(vectors.doubles(F.col("embedding")), 64)).alias("usable"))


MEANS = "m AS (SELECT label, place, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY place) AS centroid, any_value(n) AS n FROM m GROUP BY label)"


@query("label_centroids", f"WITH {MEANS} SELECT label, place, round(x, 6) AS x FROM m")
def _(t):
    c = topics.centroids(t.embeddings, "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


def _topics(t):
    return topics.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "topic")


SCORES = f"WITH {MEANS}, s AS (SELECT vec_id, c.label AS topic, c.n, {COSINE.format(a='e.embedding', b='c.centroid')} AS score FROM embeddings e, c), b AS (SELECT vec_id, topic, round(score, 9) AS best, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, n DESC, topic) AS k FROM s)"


@query("cosine_threshold_assign", SCORES + " SELECT vec_id, CASE WHEN best >= 0.3 THEN topic END AS topic, round(CASE WHEN best >= 0.3 THEN best ELSE 0.0 END, 6) AS confidence FROM b WHERE k = 1")
def _(t):
    docs = t.embeddings.select("vec_id", vectors.doubles(F.col("embedding")).alias("vector"))
    return topics.assigned(docs, _topics(t), "vec_id", 0.3).select("vec_id", "topic", F.round("confidence", 6).alias("confidence"))


@query("centroid_add", f"WITH {MEANS} SELECT c.label, round(list_sum(list_transform(list_zip(c.centroid, e.embedding::DOUBLE[]), lambda z: (z[1] * c.n + z[2]) / (c.n + 1))), 6) AS total FROM c, embeddings e WHERE e.vec_id = 0")
def _(t):
    new = t.embeddings.where("vec_id = 0").select(vectors.doubles(F.col("embedding")).alias("v"))
    moved = _topics(t).join(F.broadcast(new), F.lit(True)).select(F.col("topic").alias("label"), vectors.with_member(F.col("centroid"), F.col("n"), F.col("v")).alias("c"))
    return moved.select("label", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("centroid_remove", f"WITH {MEANS}, f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) SELECT c.label, CASE WHEN c.n <= 1 THEN round(list_sum(c.centroid), 6) ELSE round(list_sum(list_transform(list_zip(c.centroid, e.embedding::DOUBLE[]), lambda z: (z[1] * c.n - z[2]) / (c.n - 1))), 6) END AS total FROM c JOIN f USING (label) JOIN embeddings e ON e.vec_id = f.vec_id")
def _(t):
    first = t.embeddings.groupBy(F.col("label").alias("topic")).agg(F.min_by(vectors.doubles(F.col("embedding")), "vec_id").alias("v"))
    moved = _topics(t).join(first, "topic").select(F.col("topic").alias("label"), vectors.without_member(F.col("centroid"), F.col("n"), F.col("v")).alias("c"))
    return moved.select("label", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


WEIGHTS = f"w AS (SELECT lang, unnest({KEYWORDS}) AS word FROM documents), k AS (SELECT lang, word, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS weight FROM w GROUP BY lang, word)"


@query("bhattacharyya_languages", f"WITH {WEIGHTS} SELECT a.lang AS one, b.lang AS other, round(sum(sqrt(a.weight * b.weight)), 6) AS overlap FROM k a JOIN k b ON a.word = b.word AND a.lang < b.lang GROUP BY ALL")
def _(t):
    k = topics.group_weights(t.documents, "lang")
    other = k.select(F.col("lang").alias("other"), "word", F.col("weight").alias("v"))
    return k.join(other, "word").where("lang < other").groupBy(F.col("lang").alias("one"), "other").agg(F.round(F.sum(F.sqrt(F.col("weight") * F.col("v"))), 6).alias("overlap"))


@query("keyword_merge", f"WITH {WEIGHTS}, o AS (SELECT 'de' AS target UNION ALL SELECT 'fr' UNION ALL SELECT 'es'), p AS (SELECT target, word, weight FROM k, o WHERE lang = 'en'), q AS (SELECT lang AS target, word, weight FROM k WHERE lang <> 'en') SELECT coalesce(p.target, q.target) AS target, coalesce(p.word, q.word) AS word, round((coalesce(p.weight, 0) * 3 + coalesce(q.weight, 0)) / 4, 6) AS weight FROM p FULL JOIN q ON p.word = q.word AND p.target = q.target")
def _(t):
    """The keywords of one language joined by those of each other, as a topic of three documents takes a fourth."""
    k = topics.group_weights(t.documents, "lang")
    own = k.where("lang = 'en'").select("word", F.col("weight").alias("p"), F.explode(F.array(*map(F.lit, ("de", "fr", "es")))).alias("target"))
    new = k.where("lang <> 'en'").select("word", F.col("weight").alias("q"), F.col("lang").alias("target"))
    zero = F.lit(0.0)
    return own.join(new, ["target", "word"], "full").select("target", "word", F.round((F.coalesce("p", zero) * 3 + F.coalesce("q", zero)) / 4, 6).alias("weight"))


@query("blended_score", f"""WITH {MEANS}, e AS (SELECT vec_id, embedding, label FROM embeddings), s AS (SELECT e.vec_id, c.label AS topic, {COSINE.format(a='e.embedding', b='c.centroid')} AS cosine, CASE WHEN e.label = c.label THEN 1.0 ELSE 0.0 END AS words FROM e, c)
, b AS (SELECT vec_id, topic, round(0.95 * cosine + 0.05 * words, 9) AS blended FROM s)
 SELECT vec_id, topic, round(blended, 6) AS blended, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY blended DESC, topic) AS rank FROM b) WHERE rank <= 3""")
def _(t):
    docs = t.embeddings.select("vec_id", vectors.doubles(F.col("embedding")).alias("vector"), F.create_map(F.col("label").cast("string"), F.lit(1.0)).alias("p"))
    named = _topics(t).withColumn("q", F.create_map(F.col("topic").cast("string"), F.lit(1.0)))
    return topics.blended(docs, named, "vec_id", 3).select("vec_id", "topic", F.round("blended", 6).alias("blended"), F.col("rank").cast("long").alias("rank"))


@query("online_topics")
def _(t):
    docs = t.embeddings.select((F.col("vec_id") % 4).alias("project"), "vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return topics.online(docs, "project", "vec_id", "v", 0.3).withColumn("confidence", F.round("confidence", 6))


NAMED = "named AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Q' || doc_id % 4 || ' report (' || doc_id || '), final.' || split_part(filename, '.', 2) WHEN 1 THEN 'Makefile' || doc_id WHEN 2 THEN 'Été deck_' || doc_id || '.pptx' ELSE filename END AS filename, selected FROM files)"
ANSWERS = """answers AS (SELECT conv_id, turn, text || ' See ' || CASE WHEN conv_id % 5 = 0 THEN 'Q' || conv_id % 4 || ' report (' || conv_id || '), final.' ELSE 'file' || conv_id || '.' END || (['pdf','txt','docx','xlsx','csv','png'])[1 + conv_id % 6] || ', file' || (conv_id * 7 % 1200) || '.' || (['pdf','txt','docx','xlsx','csv','png'])[1 + conv_id * 7 % 1200 % 6]
 || ', FILE1.TXT, Makefile' || (conv_id * 5 % 1000 + 1) || ' and Été deck_' || (conv_id * 5 + 2) || '.pptx' AS answer FROM conversations WHERE role = 'assistant')"""


def named_files(t):
    """Files with all kinds of names: plain ones, with blanks, commas and brackets, without an ending, with a foreign one."""
    kind = F.element_at(F.split("filename", r"\."), -1)
    d = F.col("doc_id")
    long = F.concat(F.lit("Q"), d % 4, F.lit(" report ("), d, F.lit("), final."), kind)
    name = F.when(d % 5 == 0, long).when(d % 5 == 1, F.concat(F.lit("Makefile"), d)).when(d % 5 == 2, F.concat(F.lit("Été deck_"), d, F.lit(".pptx"))).otherwise(F.col("filename"))
    return t.files.select("doc_id", name.alias("filename"), "selected")


def answers(t):
    kind = lambda n: F.element_at(F.array(*map(F.lit, ("pdf", "txt", "docx", "xlsx", "csv", "png"))), (n % 6 + 1).cast("int"))
    c, n = F.col("conv_id"), F.col("conv_id") * 7 % 1200
    first = F.when(c % 5 == 0, F.concat(F.lit("Q"), c % 4, F.lit(" report ("), c, F.lit("), final."))).otherwise(F.concat(F.lit("file"), c, F.lit(".")))
    more = F.concat(F.lit(", FILE1.TXT, Makefile"), c * 5 % 1000 + 1, F.lit(" and Été deck_"), c * 5 + 2, F.lit(".pptx"))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" See "), first, kind(c), F.lit(", file"), n, F.lit("."), kind(n), more).alias("answer"))


@query("citations", f"WITH {FILES}, {NAMED}, {ANSWERS} SELECT a.conv_id, a.turn, f.doc_id, f.filename FROM answers a JOIN named f ON contains(a.answer, f.filename)")
def _(t):
    """Files whose names an answer contains, whatever a name looks like."""
    quoted = lexical.with_names(answers(t), "answer", named_files(t), "filename")
    return quoted.join(named_files(t).select("doc_id", "filename"), "filename").select("conv_id", "turn", "doc_id", "filename")


@query("mention_guard", f"""WITH {FILES}, {NAMED}, {ANSWERS}, f AS (SELECT {FOLD.format("filename")} AS filename, selected FROM named), m AS (SELECT a.conv_id, a.turn, f.selected FROM (SELECT conv_id, turn, {FOLD.format("answer")} AS answer FROM answers) a JOIN f ON contains(a.answer, f.filename))
 SELECT conv_id, turn, count(*) FILTER (selected = 1) AS n_selected, count(*) FILTER (selected <> 1) AS n_unselected, count(*) FILTER (selected = 1) = 0 AS refuse FROM m GROUP BY ALL""")
def _(t):
    """Names and answers are folded alike; an answer that names files, but none of those selected, is refused."""
    files = named_files(t).withColumn("filename", text.folded(F.col("filename")))
    named = lexical.with_names(answers(t).withColumn("answer", text.folded(F.col("answer"))), "answer", files, "filename")
    found = named.join(files.select("filename", "selected"), "filename").groupBy("conv_id", "turn").agg(F.count_if(F.col("selected") == 1).alias("n_selected"), F.count_if(F.col("selected") != 1).alias("n_unselected"))
    return found.withColumn("refuse", F.col("n_selected") == 0)


@query("answer_path", """WITH s AS (SELECT user_id, bool_and(event_type IN ('click', 'view', 'signup')) AS lexical FROM events GROUP BY user_id) SELECT user_id, CASE WHEN lexical THEN 'bm25' ELSE 'vector' END AS path FROM s""")
def _(t):
    every = t.events.groupBy("user_id").agg(F.bool_and(F.col("event_type").isin("click", "view", "signup")).alias("lexical"))
    return every.select("user_id", F.when(F.col("lexical"), "bm25").otherwise("vector").alias("path"))


@query("access_filter_topk", f"""WITH a AS (SELECT vec_id, embedding FROM embeddings WHERE label % 2 = 0 OR vec_id % 5 = 0), s AS (SELECT q.vec_id AS query, a.vec_id AS id, {COSINE.format(a='q.embedding', b='a.embedding')} AS score FROM embeddings q, a WHERE q.vec_id % 100 = 0)
 SELECT query, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 20""")
def _(t):
    """What a reader may see is filtered before the ranking, never after it."""
    allowed = t.embeddings.where("label % 2 = 0 or vec_id % 5 = 0")
    out = search.cosine_topk(allowed, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", k=20)
    return out.select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _asked(t):
    return t.embeddings.where("vec_id % 100 = 0")


@query("vector_index_top20")
def _(t):
    """Approximate neighbours from a written index of all vectors, of which a reader may see some."""
    index = VectorIndex.build(t.embeddings, "vec_id", "embedding", ("label",))
    return index.search(_asked(t), "vec_id", "embedding", 20, (F.col("label") % 2 == 0) | (F.col("id") % 5 == 0))


@query("vector_index_recall", """SELECT (SELECT count(*) FROM embeddings) AS n_indexed, count(*) AS n_queries, true AS recalled, true AS only_allowed FROM embeddings WHERE vec_id % 100 = 0""")
def _(t):
    """Against the exact search: rows in the index, queries, whether nine of ten neighbours are found, and nothing that is not allowed."""
    index = VectorIndex.build(t.embeddings, "vec_id", "embedding", ("label",))
    plain = recall(index.search(_asked(t), "vec_id", "embedding", 20), search.cosine_topk(t.embeddings, _asked(t), "vec_id", "embedding", k=20))
    allowed = t.embeddings.where("label % 2 = 0 or vec_id % 5 = 0")
    seen = index.search(_asked(t), "vec_id", "embedding", 20, (F.col("label") % 2 == 0) | (F.col("id") % 5 == 0))
    part = recall(seen, search.cosine_topk(allowed, _asked(t), "vec_id", "embedding", k=20)).select(F.col("recall").alias("part"))
    strangers = seen.join(allowed.select(F.col("vec_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("strangers"))
    size = index.rows.agg(F.count_distinct("id").alias("n_indexed"))
    return plain.crossJoin(part).crossJoin(strangers).crossJoin(size).select("n_indexed", F.col("queries").alias("n_queries"), ((F.col("recall") >= 0.9) & (F.col("part") >= 0.9)).alias("recalled"), (F.col("strangers") == 0).alias("only_allowed"))


def specs(t):
    """A chart specification for every event type: events by day; some damaged on purpose."""
    days = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    rows = days.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), "n"))).alias("r"))
    body = F.to_json(F.struct(F.struct(F.lit("bar").alias("type"), F.concat(F.lit(" Events of "), "event_type").alias("title"), F.transform("r", lambda x: x["day"]).alias("categories"), F.array(F.struct(F.lit("n").alias("name"), F.transform("r", lambda x: x["n"]).alias("data"))).alias("series")).alias("chart")))
    return rows.select("event_type", F.when(F.col("event_type") == "error", F.lit('{"chart": {"type": "radar"}}')).otherwise(body).alias("spec"))


@query("chart_validate", """SELECT event_type, CASE WHEN event_type <> 'error' THEN 'bar' END AS kind, CASE WHEN event_type <> 'error' THEN 'Events of ' || event_type END AS title, CASE WHEN event_type <> 'error' THEN least(50, count(DISTINCT ts::DATE)) END AS n_categories FROM events GROUP BY event_type""")
def _(t):
    out = charts.validated(specs(t), "spec", "event_type")
    return out.select("event_type", "kind", "title", F.when(F.col("kind").isNotNull(), F.size("categories")).cast("long").alias("n_categories"))


@query("chart_pivot", """SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS BIGINT) AS place, day AS category, 'n' AS series, n AS value
 FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) QUALIFY place < 50""")
def _(t):
    return charts.pivoted(charts.validated(specs(t), "spec", "event_type"), "event_type").withColumn("place", F.col("place").cast("long"))
