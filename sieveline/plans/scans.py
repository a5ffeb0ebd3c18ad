"""Scans, lookups, sorts, limits, sinks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import relational as rel
from .registry import query


@query("scan_documents", "SELECT doc_id AS id, source AS outlet, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50 OFFSET 10")
def scan_documents(spark, d):
    return b.documents(spark, d).where("lang = 'en'").select("id", "outlet", "lang").orderBy("id").offset(10).limit(50)


@query("get_many", "SELECT doc_id AS id, p.pos::INTEGER AS pos, source AS outlet FROM documents JOIN (SELECT unnest([7, 3, 11, 3000000, 2]) AS doc_id, unnest(range(5)) AS pos) p USING (doc_id)")
def get_many(spark, d):
    return rel.get_many(b.documents(spark, d).select("id", "outlet"), [7, 3, 11, 3_000_000, 2], "id").orderBy("pos")


@query("point_get", "SELECT doc_id AS id, lang FROM documents WHERE doc_id = 42")
def point_get(spark, d):
    return b.documents(spark, d).where("id = 42").select("id", "lang")


@query("count_documents", "SELECT count(*) AS documents, count(*) FILTER (lang = 'en') AS english, count(DISTINCT source) AS outlets FROM documents")
def count_documents(spark, d):
    return b.documents(spark, d).agg(F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct("outlet").alias("outlets"))


@query("list_tasks", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY turn, conv_id LIMIT 40")
def list_tasks(spark, d):
    return b.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "role").orderBy("turn", "conv_id").limit(40)


@query("task_children", "SELECT c.conv_id, c.turn, p.turn AS parent_turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def task_children(spark, d):
    c = b.table(spark, d, "conversations").select("conv_id", "turn")
    p = b.table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent_turn"), F.col("role").alias("parent_role"))
    return c.join(p, ["conv_id", "turn"], "left")


@query("list_queries", "SELECT event_id AS call_id, event_type AS kind FROM events WHERE event_type IN ('view', 'click') ORDER BY ts DESC, event_id DESC LIMIT 30")
def list_queries(spark, d):
    return b.calls(spark, d).where("kind in ('view', 'click')").orderBy(F.desc("ts"), F.desc("call_id")).limit(30).select("call_id", "kind")


@query("list_fetches", "SELECT event_id AS call_id, user_id AS provider, event_type <> 'error' AS ok FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def list_fetches(spark, d):
    return b.calls(spark, d).orderBy(F.desc("ts"), F.desc("call_id")).limit(25).select("call_id", "provider", "ok")


@query("list_claims", "SELECT o_orderkey AS claim_id, o_orderpriority AS priority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 60")
def list_claims(spark, d):
    return b.claims(spark, d).orderBy("created_at", "claim_id").limit(60).select("claim_id", "priority")


@query("list_entities", "SELECT s_suppkey AS entity_id, s_name AS name FROM supplier ORDER BY s_name, s_suppkey LIMIT 100")
def list_entities(spark, d):
    return b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")).orderBy("name", "entity_id").limit(100)


@query("list_relationships", "SELECT DISTINCT l_partkey AS subject_id, l_suppkey AS object_id FROM lineitem")
def list_relationships(spark, d):
    return b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("object_id")).distinct()


@query("claim_pending", "SELECT o_orderkey AS claim_id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def claim_pending(spark, d):
    return b.claims(spark, d).where("state = 'O'").orderBy("priority", "created_at", "claim_id").limit(20).select("claim_id", "priority")


@query("sort_nulls_last", "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS date_start FROM events ORDER BY date_start ASC NULLS LAST, event_id LIMIT 200")
def sort_nulls_last(spark, d):
    e = b.table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("date_start"))
    return e.orderBy(F.asc_nulls_last("date_start"), "event_id").limit(200)


@query("sort_numeric_suffix", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY CAST(split_part(c_name, '#', 2) AS BIGINT) DESC LIMIT 50")
def sort_numeric_suffix(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.orderBy(F.desc(F.substring_index("name", "#", -1).cast("bigint"))).limit(50)


@query("topk_desc_tiebreak", "SELECT * FROM (SELECT c_mktsegment AS segment, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal) DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 5")
def topk_desc_tiebreak(spark, d):
    c = b.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.round("c_acctbal").alias("score"))
    return rel.top_per_group(c, ["segment"], [F.desc("score"), F.col("id")], 5).select("segment", "id", "rank")


@query("offset_paging", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_paging(spark, d):
    return b.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select(F.col("o_orderkey").alias("id"))


@query("insert_or_ignore", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_or_ignore(spark, d):
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rel.insert_or_ignore(s, c, ["id"])


@query("upsert", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def upsert(spark, d):
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rel.upsert(c, s, ["id"])


@query("join_anti_missing", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 256")
def join_anti_missing(spark, d):
    return rel.missing(b.documents(spark, d).select("id"), b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", 256)


@query("static_search", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
f AS (SELECT doc_id, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM t)
SELECT doc_id AS id, count(*) AS score FROM f WHERE w IN ('license', 'email', 'than') GROUP BY 1 ORDER BY score DESC, id LIMIT 30""")
def static_search(spark, d):
    from ..functions import text as tx

    words = b.documents(spark, d).select("id", F.explode(tx.tokens(F.col("text"))).alias("w")).select("id", tx.singular(F.col("w")).alias("w"))
    hit = words.where(F.col("w").isin("license", "email", "than")).groupBy("id").agg(F.count("*").alias("score"))
    return hit.orderBy(F.desc("score"), "id").limit(30)


#: Providers by family, whether they need a key, follow citations, resolve DOIs.
SOURCES = (
    ("openalex", "academic", False, True, True), ("crossref", "academic", False, True, True), ("arxiv", "academic", False, False, False),
    ("semantic_scholar", "academic", False, True, True), ("gdelt", "news", False, False, False), ("brave", "web", True, False, False),
    ("tavily", "web", True, False, False), ("serper", "web", True, False, False), ("bluesky", "social", False, False, False),
    ("mastodon", "social", False, False, False), ("youtube", "social", True, False, False),
)


@query("source_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', {str(k).lower()}, {str(c).lower()}, {str(r).lower()})" for n, f, k, c, r in SOURCES) + ") t(name, family, needs_key, citations, resolves) WHERE family = 'academic' AND (citations OR NOT needs_key)")
def source_registry(spark, d):
    s = spark.createDataFrame(SOURCES, "name string, family string, needs_key boolean, citations boolean, resolves boolean")
    return s.where("family = 'academic' and (citations or not needs_key)").orderBy("needs_key", "name")


@query("overview_counts", """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM orders) AS claims,
(SELECT count(DISTINCT conv_id) FROM conversations) AS tasks, (SELECT count(*) FROM events) AS calls, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed""")
def overview_counts(spark, d):
    one = lambda name, df, e: df.agg(e.alias("n")).select(F.lit(name).alias("k"), "n")
    parts = [
        one("documents", b.documents(spark, d), F.count("*")), one("sources", b.documents(spark, d), F.count_distinct("outlet")), one("claims", b.claims(spark, d), F.count("*")),
        one("tasks", b.table(spark, d, "conversations"), F.count_distinct("conv_id")), one("calls", b.calls(spark, d), F.count("*")), one("failed", b.calls(spark, d), F.count_if(~F.col("ok"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    names = ["documents", "sources", "claims", "tasks", "calls", "failed"]
    return out.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])


@query("distinct_values", "SELECT DISTINCT lang, source AS outlet FROM documents")
def distinct_values(spark, d):
    return b.documents(spark, d).select("lang", "outlet").distinct()


@query("except_dropped", "SELECT o_orderkey AS claim_id FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N'")
def except_dropped(spark, d):
    o = b.claims(spark, d)
    last = o.agg(F.max("created_at").alias("m"))
    old = o.join(F.broadcast(last)).where(F.col("created_at") < F.col("m") - F.expr("interval 365 days")).select("claim_id")
    return old.subtract(b.evidence(spark, d).where("stance = 'supports'").select("claim_id"))


@query("intersect_support", "SELECT l_orderkey AS claim_id FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect_support(spark, d):
    e = b.evidence(spark, d)
    return e.where("stance = 'supports'").select("claim_id").intersect(e.where("stance = 'contradicts'").select("claim_id"))


@query("enrich_gaps", """SELECT user_id AS record, arg_min(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN event_id END) AS amount,
arg_min(CASE WHEN event_type = 'click' THEN event_type END, CASE WHEN event_type = 'click' THEN event_id END) AS click, min(event_id) AS first_seen, count(*) AS records FROM events GROUP BY 1""")
def enrich_gaps(spark, d):
    e = b.table(spark, d, "events").select(F.col("user_id").alias("record"), "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("event_type") == "click", F.col("event_type")).alias("click"))
    return rel.fill_gaps(e, "record", "event_id", ["amount", "click"])


@query("json_columns", "SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events WHERE (props::JSON ->> '$.k')::INTEGER > 50")
def json_columns(spark, d):
    e = b.table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))
    return e.where("k > 50")


@query("latest_status", "SELECT user_id AS task_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, count(*) AS changes FROM events GROUP BY 1")
def latest_status(spark, d):
    e = b.table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("task_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


@query("news_recency", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) AND event_type = 'view'")
def news_recency(spark, d):
    e = b.table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return e.where("event_type = 'view'").join(F.broadcast(last)).where("ts >= since").select("event_id")
