"""Queries of joins, aggregates, windows, sorts and mutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import mutations, rules

from .base import FILES, Book

book = Book()
query = book.query
NOW = "1998-06-01"


@query("documents_with_topic", f"WITH {FILES} SELECT f.doc_id, f.filename, e.label AS topic, t.n AS topic_size FROM files f LEFT JOIN embeddings e ON f.doc_id = e.vec_id LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) t ON e.label = t.label")
def _(t):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("topic_size"))
    linked = t.files.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").join(sizes, "label", "left")
    return linked.select("doc_id", "filename", F.col("label").alias("topic"), "topic_size")


@query("owned_rows", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def _(t):
    owners = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("document_chunks", "SELECT c_custkey, count(o_orderkey) AS n_chunks, min(o_orderkey) AS first_chunk FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_chunks"), F.min("o_orderkey").alias("first_chunk"))


@query("user_plan", "SELECT c_custkey, n_name AS subscription, r_name AS plan FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    plans = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(plans, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("subscription"), F.col("r_name").alias("plan"))


@query("unassigned_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("conversations_with_messages", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def _(t):
    return t.customer.join(t.conversations.where("role = 'user'"), F.col("c_custkey") == F.col("conv_id"), "left_semi").select("c_custkey")


@query("chunks_of_selected", f"WITH {FILES} SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM files WHERE selected = 1)")
def _(t):
    return t.embeddings.join(t.files.where("selected = 1"), F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id", "label")


@query("chunk_document_names", f"WITH {FILES} SELECT vec_id, coalesce(filename, 'untitled') AS name FROM embeddings LEFT JOIN (SELECT * FROM files WHERE doc_id % 3 <> 0) f ON vec_id = doc_id")
def _(t):
    return t.embeddings.join(t.files.where("doc_id % 3 <> 0"), F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", F.coalesce("filename", F.lit("untitled")).alias("name"))


@query("duplicate_names", "SELECT p.p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size = p.p_size AND q.p_partkey <> p.p_partkey)")
def _(t):
    """A name is taken if its key counts more than one row; no row is compared with another."""
    taken = t.part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).where("n > 1")
    return t.part.join(taken, ["p_brand", "p_type", "p_size"], "left_semi").select("p_partkey")


@query("setting_lookup", "SELECT o_orderkey, min(l_shipmode) AS value FROM (SELECT o_orderkey, l_returnflag AS l_shipmode FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'O') GROUP BY o_orderkey")
def _(t):
    found = t.orders.join(t.lineitem.where("l_linestatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return found.groupBy("o_orderkey").agg(F.min("l_returnflag").alias("value"))


@query("plan_counts", "SELECT c_mktsegment AS plan, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("plan")).agg(F.count("*").alias("n"))


@query("active_counts", "SELECT count(*) AS users, count(*) FILTER (c_acctbal > 0) AS active, count(DISTINCT c_nationkey) AS nations FROM customer")
def _(t):
    return t.customer.agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_distinct("c_nationkey").alias("nations"))


@query("recent_users_top20", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(t):
    recent = t.orders.where(F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{NOW}' - interval 7 days"))
    return recent.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("topic_groups", "SELECT coalesce(CAST(label AS VARCHAR), 'unassigned') AS topic, count(*) AS n, min(doc_id) AS first_doc FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY ALL")
def _(t):
    linked = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    return linked.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("unassigned")).alias("topic")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("status_any_every", "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))


@query("sheet_profile", "SELECT l_suppkey AS sheet, count(*) AS n_ranges, min(l_linenumber) + 1 AS first_row, max(l_linenumber) + 7 AS last_row, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS header FROM lineitem GROUP BY l_suppkey")
def _(t):
    ranges = t.lineitem.withColumn("range", F.concat_ws("-", F.col("l_linenumber") + 1, F.col("l_linenumber") + 7)).withColumn("rows", F.transform(F.split("range", "-"), lambda x: x.cast("int")))
    return ranges.groupBy(F.col("l_suppkey").alias("sheet")).agg(F.count("*").alias("n_ranges"), F.min(F.array_min("rows")).alias("first_row"), F.max(F.array_max("rows")).alias("last_row"), F.min_by("l_returnflag", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("header"))


@query("distinct_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("argmax_first_wins", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def _(t):
    best = F.max_by(F.col("l_linenumber"), F.struct("l_quantity", -F.col("l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("l_linenumber"))


@query("share_within_group", "SELECT source, lang, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def _(t):
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.select("source", "lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("share"))


@query("conversation_last6", "SELECT conv_id, turn, coalesce(string_agg(role, ',' ORDER BY p), '') AS memory FROM (SELECT a.conv_id, a.turn, b.turn AS p, b.role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 6) GROUP BY ALL")
def _(t):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("role").over(before), ",").alias("memory"))


@query("latest_turn_per_conversation", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("status_transitions", "SELECT user_id, event_id, prev || '>' || event_type AS step FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev <> event_type")
def _(t):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("prev", before).where("prev <> event_type").select("user_id", "event_id", F.concat_ws(">", "prev", "event_type").alias("step"))


@query("newly_ready", "SELECT DISTINCT a.user_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND a.ts < TIMESTAMP '2024-01-15' AND b.event_type = 'purchase' AND b.ts >= TIMESTAMP '2024-01-15'")
def _(t):
    cut = F.expr("timestamp_ntz'2024-01-15'")
    was = t.events.where((F.col("event_type") == "view") & (F.col("ts") < cut)).select("user_id").distinct()
    return was.join(t.events.where((F.col("event_type") == "purchase") & (F.col("ts") >= cut)), "user_id", "left_semi")


@query("sorted_two_keys", "SELECT o_custkey, n, first_at FROM (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_at FROM orders GROUP BY o_custkey) ORDER BY n DESC, first_at, o_custkey LIMIT 50")
def _(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"))
    return n.orderBy(F.desc("n"), "first_at", "o_custkey").limit(50)


@query("sorted_by_locale")
def _(t):
    return t.part.select("p_partkey", "p_name").orderBy(F.collate("p_name", "en"), "p_partkey").limit(100)


@query("first_rows_per_sheet", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 200")
def _(t):
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return t.lineitem.withColumn("k", k).where("k <= 200").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("key_union", "SELECT word, sum(n) AS n FROM (SELECT lang AS word, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT source, count(*) FROM documents GROUP BY source) GROUP BY word")
def _(t):
    parts = [t.documents.groupBy(F.col(c).alias("word")).agg(F.count("*").alias("n")) for c in ("lang", "source")]
    return reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("n").alias("n"))


@query("search_documents", f"WITH {FILES} SELECT doc_id, filename FROM files WHERE (contains(lower(filename), 'the') OR contains(lower(text), 'the')) AND filename LIKE '%.pdf' AND selected = 1")
def _(t):
    hit = F.contains(F.lower("filename"), F.lit("the")) | F.contains(F.lower("text"), F.lit("the"))
    return t.files.where(hit & F.endswith("filename", F.lit(".pdf")) & (F.col("selected") == 1)).select("doc_id", "filename")


@query("topic_view_filter", f"WITH {FILES} SELECT doc_id FROM files WHERE contains(lower(filename), '1') AND starred = 1")
def _(t):
    return t.files.where(F.contains(F.lower("filename"), F.lit("1")) & (F.col("starred") == 1)).select("doc_id")


@query("toggle_flags", f"WITH {FILES} SELECT doc_id, CASE WHEN starred = 1 THEN 0 ELSE 1 END AS starred, CASE WHEN selected <> 0 THEN 0 ELSE 1 END AS selected FROM files")
def _(t):
    return t.files.select("doc_id", F.when(F.col("starred") == 1, 0).otherwise(1).alias("starred"), F.when(F.col("selected") != 0, 0).otherwise(1).alias("selected"))


@query("upload_validation", f"WITH {FILES} SELECT doc_id, CASE WHEN split_part(filename, '.', 2) = 'png' THEN 'type' ELSE '' END || CASE WHEN length(text) > 2000 THEN 'size' ELSE '' END AS problems FROM files")
def _(t):
    problems = rules.upload_problems(F.col("filename"), F.length("text"), ("pdf", "txt", "docx", "xlsx", "csv"), 2000)
    return t.files.select("doc_id", F.array_join(problems, "").alias("problems"))


@query("quota_check", "SELECT c_custkey, used, used + 500 > 1000000 AS refused FROM (SELECT c_custkey, coalesce(CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT), 0) AS used FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def _(t):
    used = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.coalesce(F.sum(F.floor("o_totalprice").cast("long")), F.lit(0)).alias("used"))
    return used.withColumn("refused", rules.over_quota(F.col("used"), F.lit(500), F.lit(1_000_000)))


@query("quota_running", "SELECT o_orderkey, running, running > 500000 AS refused FROM (SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.sum(F.floor("o_totalprice").cast("long")).over(w).alias("running")).withColumn("refused", F.col("running") > 500000)


@query("usage_band", "SELECT c_custkey, least(CAST(floor(a * 100 / 5000 + 0.5) AS BIGINT), 100) AS percent, CASE WHEN least(floor(a * 100 / 5000 + 0.5), 100) < 80 THEN 'green' WHEN least(floor(a * 100 / 5000 + 0.5), 100) < 95 THEN 'yellow' ELSE 'red' END AS band FROM (SELECT c_custkey, greatest(c_acctbal, 0) AS a FROM customer)")
def _(t):
    percent = rules.usage_percent(F.greatest("c_acctbal", F.lit(0.0)), F.lit(5000.0))
    return t.customer.select("c_custkey", percent.alias("percent"), rules.usage_band(percent).alias("band"))


@query("subscription_active", f"""SELECT o_orderkey, CASE WHEN s NOT IN ('active', 'trialing') THEN FALSE WHEN cancelling AND ends IS NOT NULL THEN ends > TIMESTAMP '{NOW}' ELSE TRUE END AS active
 FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'trialing' ELSE 'past_due' END AS s, o_orderkey % 2 = 0 AS cancelling, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS ends FROM orders)""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "trialing").otherwise("past_due")
    ends = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return t.orders.select("o_orderkey", rules.subscription_active(status, F.col("o_orderkey") % 2 == 0, ends, F.expr(f"timestamp_ntz'{NOW}'")).alias("active"))


@query("plans_by_interval", "SELECT p_brand AS plan, p_size AS gb, p_retailprice, p_size <= 20 AS disabled FROM part WHERE p_size BETWEEN 1 AND 40 ORDER BY p_size, p_partkey LIMIT 30")
def _(t):
    return t.part.where(F.col("p_size").between(1, 40)).orderBy("p_size", "p_partkey").limit(30).select(F.col("p_brand").alias("plan"), F.col("p_size").alias("gb"), "p_retailprice", (F.col("p_size") <= 20).alias("disabled"))


@query("retry_stage_map", "SELECT event_id, event_type IN ('error', 'purchase') AS may_retry, CASE event_type WHEN 'error' THEN 'chunk' WHEN 'view' THEN 'embed' WHEN 'click' THEN 'summarize' ELSE 'chunk' END AS stage, CASE event_type WHEN 'view' THEN 'chunked' WHEN 'click' THEN 'embedded' ELSE 'queued' END AS status FROM events")
def _(t):
    stage = F.when(F.col("event_type") == "error", "chunk").when(F.col("event_type") == "view", "embed").when(F.col("event_type") == "click", "summarize")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ocr_failed").otherwise("ready")
    resumed = rules.retry(stage)
    return t.events.select("event_id", rules.may_retry(status).alias("may_retry"), resumed["stage"].alias("stage"), resumed["status"].alias("status"))


@query("event_props_json", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_valid FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.try_parse_json("props")).alias("n_valid"))


@query("merge_upsert", "SELECT coalesce(u.k, c.c_custkey) AS k, CASE WHEN u.k IS NULL THEN c.c_acctbal ELSE u.v END AS v FROM customer c FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey) u ON c.c_custkey = u.k")
def _(t):
    changes = t.orders.where("o_orderkey % 7 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return mutations.upsert(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), changes, ["k"])


@query("cascade_delete", "SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def _(t):
    left = mutations.cascade({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, "customer", t.customer.where("c_nationkey = 3"), [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in left.items()])


@query("topic_delete", "SELECT vec_id, CASE WHEN label <> 2 THEN label END AS topic FROM embeddings")
def _(t):
    kept = t.embeddings.select("label").distinct().where("label <> 2")
    return t.embeddings.join(kept.withColumn("topic", F.col("label")), "label", "left").select("vec_id", "topic")


@query("latest_change_by_key", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id")
def _(t):
    return mutations.latest(t.events, ["user_id"], ["ts", "event_id"], {"status": "event_type", "value": "value"})


@query("key_checks", "SELECT 'orders' AS tab, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans")
def _(t):
    twice, lost = mutations.duplicate_keys(t.orders, ["o_orderkey"]), mutations.orphans(t.orders, "o_custkey", t.customer, "c_custkey")
    return twice.agg(F.count("*").alias("duplicates")).join(lost.agg(F.count("*").alias("orphans")), F.lit(True)).select(F.lit("orders").alias("tab"), "duplicates", "orphans")


@query("storage_by_owner", "SELECT source AS owner, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy(F.col("source").alias("owner")).agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("department_members", "SELECT r_name AS department, count(n_nationkey) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    return t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy(F.col("r_name").alias("department")).agg(F.count("n_nationkey").alias("members"))


@query("lifecycle_violations", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND (prev, event_type) NOT IN (('signup','view'), ('view','click'), ('click','purchase'), ('view','view'), ('click','click'))")
def _(t):
    allowed = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click")]
    return mutations.bad_transitions(t.events, "user_id", ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id")


@query("repository_page", f"WITH {FILES} SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS place FROM files WHERE project = 'en' AND filename LIKE '%.pdf') WHERE place BETWEEN 21 AND 40")
def _(t):
    """The second page: the first two are taken by a top-k, so nothing but forty rows is numbered."""
    top = t.files.where((F.col("project") == "en") & F.endswith("filename", F.lit(".pdf"))).orderBy(F.desc("doc_id")).limit(40).select("doc_id")
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("doc_id"))).cast("long")).where("place > 20")
