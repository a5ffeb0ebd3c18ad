"""Claims, evidence, snapshots, timelines, entities and views over the star of orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import text as tx
from ..operators import claims as cl
from .registry import query

_Q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_AGG = f"""count(*) AS documents, count(DISTINCT source_key) AS independent, count(*) FILTER (source_type IN ({_Q(cl.PRIMARY)})) AS "primary", count(*) FILTER (source_type = 'academic_preprint') AS preprints,
count(*) FILTER (source_type = 'academic_peer_reviewed') AS peer_reviewed, count(*) FILTER (source_type IN ({_Q(cl.SELF_REPORTED)})) AS self_reported, count(*) FILTER (source_type IN ({_Q(cl.SECONDARY)})) AS secondary,
count(*) FILTER (retracted) AS retracted, count(*) FILTER (has_excerpt) AS excerpts, min(wire_service) AS wire, min(published_at) AS earliest, max(published_at) AS latest"""
_COLS = ("documents", "independent", "primary", "preprints", "peer_reviewed", "self_reported", "secondary", "retracted", "excerpts", "wire", "earliest", "latest")
_WIDE = ", ".join(
    (f"coalesce(max(CASE WHEN stance = '{st}' THEN \"{c}\" END), 0) AS {st[0]}_{c}" if c not in ("wire", "earliest", "latest") else f"max(CASE WHEN stance = '{st}' THEN {c} END) AS {st[0]}_{c}")
    for st in cl.STANCES for c in _COLS
)
_THIN = "s_independent <= 1 AND s_primary = 0 AND (s_secondary = s_documents OR s_self_reported = s_documents)"
_STATUS = f"""CASE WHEN s_documents = 0 AND c_documents = 0 THEN 'unverified' WHEN s_documents > s_retracted AND c_documents > c_retracted THEN 'mixed' WHEN c_documents > c_retracted THEN 'contradicted'
WHEN s_documents = s_retracted THEN 'insufficient_evidence' WHEN {_THIN} THEN 'insufficient_evidence' ELSE 'supported' END"""
_GAPS = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in cl.GAPS) + "], lambda g: g IS NOT NULL)"


def _describe(p: str) -> str:
    return f"""({p}_independent || ' independent ' || CASE WHEN {p}_primary > 0 THEN 'primary ' WHEN {p}_self_reported = {p}_documents THEN 'self-reported ' WHEN {p}_secondary = {p}_documents THEN 'secondary '
WHEN {p}_peer_reviewed = {p}_documents THEN 'peer-reviewed ' WHEN {p}_preprints > 0 THEN 'preprint ' ELSE '' END || CASE WHEN {p}_independent = 1 THEN 'source' ELSE 'sources' END ||
CASE WHEN {p}_documents > {p}_independent THEN ' (' || {p}_documents || ' documents, ' || ({p}_documents - {p}_independent) || ' copies)' ELSE '' END || ', ' ||
CASE WHEN year({p}_earliest) = year({p}_latest) THEN year({p}_latest)::VARCHAR ELSE year({p}_earliest) || '-' || year({p}_latest) END)"""


_NOTES = "concat_ws('; ', " + ", ".join(f"CASE WHEN {rule} THEN {text} END" for _, rule, text in cl.NOTES) + ")"
_SAID = "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {p}_documents > 0 THEN '{verb}' || {_describe(p)} END" for p, verb in (("s", "supported by "), ("c", "contradicted by "), ("q", "qualified by "))) + "), '')"
_EXPLAIN = f"CASE WHEN {_SAID} IS NULL THEN 'no evidence linked' WHEN {_NOTES} = '' THEN {_SAID} ELSE {_SAID} || ' (' || {_NOTES} || ')' END"


def _assessed_sql(name: str, where: str = "true") -> str:
    return f"""{name}_sum AS (SELECT claim_id, stance, {_AGG} FROM ev WHERE {where} GROUP BY 1, 2),
{name}_wide AS (SELECT o.o_orderkey AS claim_id, {_WIDE} FROM orders o LEFT JOIN {name}_sum s ON s.claim_id = o.o_orderkey GROUP BY 1),
{name}_sup AS (SELECT *, coalesce(c_latest > s_latest, false) AS superseded FROM {name}_wide),
{name} AS (SELECT *, {_STATUS} AS status, {_GAPS} AS gaps, {_EXPLAIN} AS explanation FROM {name}_sup)"""


_A = f"WITH {b.EVIDENCE_SQL}, {_assessed_sql('a')}"


def _assessed(spark, d, links=None):
    return cl.assessment(b.claims(spark, d), b.evidence(spark, d) if links is None else links)


@query("evidence_summary", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, stance, {_AGG} FROM ev GROUP BY 1, 2")
def evidence_summary(spark, d):
    return cl.evidence_summary(b.evidence(spark, d))


@query("claim_assessment", f"{_A} SELECT claim_id, s_documents, s_independent, c_documents, c_independent, q_documents, status, superseded FROM a")
def claim_assessment(spark, d):
    return _assessed(spark, d).select("claim_id", "s_documents", "s_independent", "c_documents", "c_independent", "q_documents", "status", "superseded")


@query("derive_status", f"{_A} SELECT status, count(*) AS claims FROM a GROUP BY 1")
def derive_status(spark, d):
    return _assessed(spark, d).groupBy("status").agg(F.count("*").alias("claims"))


@query("identify_gaps", f"{_A} SELECT claim_id, array_to_string(gaps, ',') AS gaps FROM a")
def identify_gaps(spark, d):
    return _assessed(spark, d).select("claim_id", F.array_join("gaps", ",").alias("gaps"))


@query("explain_claim", f"{_A} SELECT claim_id, explanation FROM a")
def explain_claim(spark, d):
    return _assessed(spark, d).select("claim_id", "explanation")


@query("possibly_superseded", f"{_A} SELECT claim_id FROM a WHERE superseded")
def possibly_superseded(spark, d):
    return _assessed(spark, d).where("superseded").select("claim_id")


@query("open_questions", f"{_A} SELECT g AS gap, count(*) AS claims FROM (SELECT unnest(gaps) AS g FROM a) GROUP BY 1")
def open_questions(spark, d):
    return _assessed(spark, d).select(F.explode("gaps").alias("gap")).groupBy("gap").agg(F.count("*").alias("claims"))


@query("findings_order", f"{_A} SELECT claim_id, status, s_independent FROM a ORDER BY CASE status WHEN 'supported' THEN 0 WHEN 'mixed' THEN 1 WHEN 'contradicted' THEN 2 WHEN 'insufficient_evidence' THEN 3 ELSE 4 END, s_independent DESC, claim_id LIMIT 50")
def findings_order(spark, d):
    rank = F.when(F.col("status") == "supported", 0).when(F.col("status") == "mixed", 1).when(F.col("status") == "contradicted", 2).when(F.col("status") == "insufficient_evidence", 3).otherwise(4)
    return _assessed(spark, d).orderBy(rank, F.desc("s_independent"), "claim_id").limit(50).select("claim_id", "status", "s_independent")


@query("type_histogram", f"WITH {b.EVIDENCE_SQL} SELECT source_type, count(*) AS n FROM ev GROUP BY 1")
def type_histogram(spark, d):
    return b.evidence(spark, d).groupBy("source_type").agg(F.count("*").alias("n"))


@query("primary_source_distance", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, min(CASE source_type WHEN 'regulatory_document' THEN 0 WHEN 'academic_preprint' THEN 1 WHEN 'academic_peer_reviewed' THEN 1 WHEN 'press_release' THEN 1 WHEN 'secondary_news_reporting' THEN 3 WHEN 'web_page' THEN 3 ELSE 4 END) AS distance FROM ev GROUP BY 1")
def primary_source_distance(spark, d):
    return b.evidence(spark, d).groupBy("claim_id").agg(F.min(cl.primary_source_distance(F.col("source_type"))).alias("distance"))


@query("run_report", f"{_A} SELECT count(*) AS claims, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'mixed') AS mixed, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (s_independent <= 1 AND s_documents > 0) AS single_source, count(*) FILTER (len(gaps) = 0) AS complete, count(*) FILTER (list_contains(gaps, 'no_excerpt')) AS unverifiable_excerpts, count(*) FILTER (superseded) AS superseded FROM a")
def run_report(spark, d):
    a, s = _assessed(spark, d), F.col("status")
    return a.agg(
        F.count("*").alias("claims"), F.count_if(s == "supported").alias("supported"), F.count_if(s == "mixed").alias("mixed"), F.count_if(s == "unverified").alias("unverified"),
        F.count_if((F.col("s_independent") <= 1) & (F.col("s_documents") > 0)).alias("single_source"), F.count_if(F.size("gaps") == 0).alias("complete"),
        F.count_if(F.array_contains("gaps", "no_excerpt")).alias("unverifiable_excerpts"), F.count_if("superseded").alias("superseded"),
    )


# A first snapshot that saw nine tenths of the evidence, without its retractions.
_BEFORE = "document_id % 10 <> 3"
_SNAP = "claim_id, status, superseded, s_independent AS support, c_independent AS contradiction, s_retracted AS retracted, s_primary > 0 AS has_primary, len(gaps) AS gaps"
_DIFF = f"""WITH {b.EVIDENCE_SQL}, {_assessed_sql('a')}, {_assessed_sql('z', _BEFORE)},
sb AS (SELECT {_SNAP} FROM z WHERE claim_id % 17 <> 0), sa AS (SELECT {_SNAP} FROM a WHERE claim_id % 19 <> 0),
j AS (SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, a.claim_id IS NULL AS gone, b.claim_id IS NULL AS fresh, a.support AS as_, b.support AS bs, a.contradiction AS ac, b.contradiction AS bc,
  a.retracted > b.retracted AS r1, a.status <> b.status AS r2, a.superseded AND NOT b.superseded AS r3, a.has_primary AND NOT b.has_primary AS r7, a.gaps AS ag, b.gaps AS bg FROM sb b FULL JOIN sa a ON a.claim_id = b.claim_id),
k AS (SELECT claim_id, CASE WHEN fresh THEN 'new' WHEN gone THEN 'dropped' ELSE 'changed' END AS kind,
  CASE WHEN fresh OR gone THEN '' ELSE array_to_string(list_filter([CASE WHEN r1 THEN 'retracted' END, CASE WHEN r2 THEN 'status' END, CASE WHEN r3 THEN 'superseded' END, CASE WHEN as_ > bs THEN 'gained' END, CASE WHEN as_ < bs THEN 'lost' END,
    CASE WHEN ac > bc THEN 'counterevidence' END, CASE WHEN r7 THEN 'primary' END, CASE WHEN ag < bg THEN 'gaps_closed' END, CASE WHEN ag > bg THEN 'gaps_opened' END], lambda x: x IS NOT NULL), ',') END AS changes,
  CASE WHEN fresh THEN as_ > 0 OR ac > 0 WHEN gone THEN false ELSE r1 OR r2 OR r3 OR (as_ > bs AND bs < 2 AND as_ >= 2) OR as_ < bs OR ac > bc END AS material FROM j)"""


def _diff(spark, d):
    ev = b.evidence(spark, d)
    before = cl.snapshot(_assessed(spark, d, ev.where("document_id % 10 <> 3"))).where("claim_id % 17 <> 0")
    return cl.snapshot_diff(before, cl.snapshot(_assessed(spark, d, ev)).where("claim_id % 19 <> 0"))


@query("snapshot_take", f"{_A} SELECT {_SNAP} FROM a")
def snapshot_take(spark, d):
    return cl.snapshot(_assessed(spark, d))


@query("snapshot_diff", f"{_DIFF} SELECT * FROM k WHERE kind <> 'changed' OR changes <> ''")
def snapshot_diff(spark, d):
    return _diff(spark, d)


@query("snapshot_describe", f"{_DIFF} SELECT kind, material, count(*) AS claims FROM k WHERE kind <> 'changed' OR changes <> '' GROUP BY 1, 2")
def snapshot_describe(spark, d):
    return _diff(spark, d).groupBy("kind", "material").agg(F.count("*").alias("claims"))


@query("link_evidence", f"WITH {b.EVIDENCE_SQL} SELECT DISTINCT claim_id, document_id, stance FROM ev WHERE has_excerpt")
def link_evidence(spark, d):
    return b.evidence(spark, d).where("has_excerpt").select("claim_id", "document_id", "stance").distinct()


@query("integrity_violations", """SELECT 'ship_before_order' AS rule, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'claim_without_evidence', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'evidence_without_claim', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def integrity_violations(spark, d):
    li, o = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate"), b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    return count("ship_before_order", li.join(o, "k").where("l_shipdate < o_orderdate")).union(count("claim_without_evidence", o.join(li, "k", "left_anti"))).union(count("evidence_without_claim", li.join(o, "k", "left_anti")))


# --- timelines --------------------------------------------------------------
@query("timeline_events", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, date_trunc('month', published_at) AS month, count(DISTINCT source_key) AS groups, bool_or(source_type = 'regulatory_document') AS has_primary FROM ev GROUP BY 1, 2")
def timeline_events(spark, d):
    return b.evidence(spark, d).groupBy("claim_id", F.date_trunc("month", "published_at").cast("timestamp_ntz").alias("month")).agg(F.count_distinct("source_key").alias("groups"), F.bool_or(F.col("source_type").isin(*cl.PRIMARY)).alias("has_primary"))


@query("timeline_publications", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, source_key, min(published_at) AS at, arg_min(document_id, struct_pack(a := published_at, i := document_id)) AS document_id, count(*) - 1 AS further_copies FROM ev GROUP BY 1, 2")
def timeline_publications(spark, d):
    first = F.min_by("document_id", F.struct("published_at", "document_id")).alias("document_id")
    return b.evidence(spark, d).groupBy("claim_id", "source_key").agg(F.min("published_at").alias("at"), first, (F.count("*") - 1).alias("further_copies"))


@query("first_appearance", f"WITH {b.EVIDENCE_SQL} SELECT source_key, min(published_at) AS first_at FROM ev GROUP BY 1")
def first_appearance(spark, d):
    return b.evidence(spark, d).groupBy("source_key").agg(F.min("published_at").alias("first_at"))


@query("union_timelines", "SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS moment FROM events WHERE event_type = 'signup' UNION ALL SELECT 'publication', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') ORDER BY moment NULLS LAST, kind, id LIMIT 200")
def union_timelines(spark, d):
    e = b.table(spark, d, "events").where("event_type = 'signup'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    o = b.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit("publication").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    return e.unionByName(o).orderBy(F.asc_nulls_last("moment"), "kind", "id").limit(200)


# --- entities ---------------------------------------------------------------
_NAMES = r"names AS (SELECT 's' || s_suppkey AS entity, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS key FROM supplier UNION ALL SELECT 'c' || c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') FROM customer)"


def _entities(spark, d):
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ").alias("key")
    s = b.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), key("s_name"))
    return s.unionByName(b.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), key("c_name")))


@query("entity_resolve", rf"""WITH {_NAMES}, m AS (SELECT n_nationkey AS mention, CASE WHEN n_nationkey % 3 = 0 THEN 'supplier ' || lpad(n_nationkey::VARCHAR, 9, '0') WHEN n_nationkey % 3 = 1 THEN 'customer ' || lpad((n_nationkey + 1)::VARCHAR, 9, '0') ELSE lower(n_name) END AS key FROM nation)
SELECT m.mention, count(n.entity) AS candidates, CASE count(n.entity) WHEN 0 THEN 'create' WHEN 1 THEN 'heuristic' ELSE 'ambiguous' END AS decision, min(n.entity) AS entity FROM m LEFT JOIN names n ON n.key = m.key GROUP BY 1""")
def entity_resolve(spark, d):
    k = F.col("n_nationkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("supplier "), F.lpad(k.cast("string"), 9, "0"))).when(k % 3 == 1, F.concat(F.lit("customer "), F.lpad((k + 1).cast("string"), 9, "0"))).otherwise(F.lower("n_name"))
    m = b.table(spark, d, "nation").select(k.alias("mention"), key.alias("key"))
    g = m.join(_entities(spark, d), "key", "left").groupBy("mention").agg(F.count("entity").alias("candidates"), F.min("entity").alias("entity"))
    return g.withColumn("decision", F.when(F.col("candidates") == 0, "create").when(F.col("candidates") == 1, "heuristic").otherwise("ambiguous"))


@query("join_left_alias", "SELECT s_suppkey AS entity_id, 'name' AS via FROM supplier UNION SELECT s_suppkey, 'alias' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def join_left_alias(spark, d):
    s, n = b.table(spark, d, "supplier"), b.table(spark, d, "nation").where("n_regionkey = 1")
    by_name = s.select(F.col("s_suppkey").alias("entity_id"), F.lit("name").alias("via"))
    by_alias = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), F.lit("alias").alias("via"))
    return by_name.union(by_alias).distinct()


@query("join_inner_identifier", "SELECT n_nationkey AS value, min(s_suppkey) AS entity_id FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_inner_identifier(spark, d):
    j = b.table(spark, d, "supplier").join(F.broadcast(b.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_nationkey").alias("value")).agg(F.min("s_suppkey").alias("entity_id"))


@query("needs_review", r"SELECT c_custkey AS id FROM customer WHERE len(regexp_split_to_array(c_name, '[\s.#]+')) < 2 OR c_acctbal < 0")
def needs_review(spark, d):
    return b.table(spark, d, "customer").where((F.size(F.split("c_name", r"[\s.#]+")) < 2) | (F.col("c_acctbal") < 0)).select(F.col("c_custkey").alias("id"))


@query("register_document_entities", "SELECT doc_id AS document_id, 'PUBLISHED_BY' AS predicate, source AS object FROM documents UNION ALL SELECT doc_id, 'AUTHORED_BY', w FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(split_part(text, chr(10), 1), '[A-Z][a-z]+'))[1:25]) AS w FROM documents)")
def register_document_entities(spark, d):
    docs = b.documents(spark, d)
    a = docs.select(F.col("id").alias("document_id"), F.lit("AUTHORED_BY").alias("predicate"), F.explode(F.slice(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z][a-z]+"), F.lit(0))), 1, 25)).alias("object"))
    return docs.select(F.col("id").alias("document_id"), F.lit("PUBLISHED_BY").alias("predicate"), F.col("outlet").alias("object")).unionByName(a)


@query("join_self_same_claim", f"WITH {b.EVIDENCE_SQL} SELECT o.document_id, count(*) AS edges FROM ev s JOIN ev o USING (claim_id) WHERE s.document_id % 20 = 0 AND o.document_id <> s.document_id GROUP BY 1")
def join_self_same_claim(spark, d):
    ev = b.evidence(spark, d).select("claim_id", "document_id")
    s = ev.where("document_id % 20 = 0").toDF("claim_id", "seed")
    return s.join(ev, "claim_id").where("document_id <> seed").groupBy("document_id").agg(F.count("*").alias("edges"))


@query("join_semi_copy", f"WITH {b.EVIDENCE_SQL} SELECT DISTINCT document_id FROM ev WHERE source_key IN (SELECT source_key FROM ev WHERE claim_id % 20 = 0)")
def join_semi_copy(spark, d):
    ev = b.evidence(spark, d)
    return ev.join(ev.where("claim_id % 20 = 0").select("source_key").distinct(), "source_key", "left_semi").select("document_id").distinct()


@query("join_lookup_hydrate", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS countries, count(*) AS links FROM ev JOIN supplier ON s_suppkey = source_key JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def join_lookup_hydrate(spark, d):
    s = b.table(spark, d, "supplier").join(F.broadcast(b.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_key"), "n_name")
    return b.evidence(spark, d).join(s, "source_key").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("countries"), F.count("*").alias("links"))


@query("report_counts", f"WITH {b.EVIDENCE_SQL} SELECT count(DISTINCT document_id) AS documents, count(DISTINCT source_key) AS sources, count(DISTINCT claim_id) AS claims, count(*) FILTER (retracted) AS retracted FROM ev")
def report_counts(spark, d):
    return b.evidence(spark, d).agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("source_key").alias("sources"), F.count_distinct("claim_id").alias("claims"), F.count_if("retracted").alias("retracted"))


@query("report_collect", f"{_A} SELECT status, count(*) AS claims, sum(s_independent)::BIGINT AS support, sum(c_independent)::BIGINT AS contradiction, count(*) FILTER (len(gaps) > 0) AS with_gaps FROM a GROUP BY 1")
def report_collect(spark, d):
    return _assessed(spark, d).groupBy("status").agg(F.count("*").alias("claims"), F.sum("s_independent").alias("support"), F.sum("c_independent").alias("contradiction"), F.count_if(F.size("gaps") > 0).alias("with_gaps"))


@query("citation_label", "SELECT o_orderkey AS id, split_part(c_name, '#', 1) || ' (' || year(o_orderdate) || '), ' || n_name AS label FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def citation_label(spark, d):
    c = b.table(spark, d, "customer").join(F.broadcast(b.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = b.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("id"), F.concat(F.substring_index("c_name", "#", 1), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit("), "), F.col("n_name")).alias("label"))


@query("retractions_found", f"WITH {b.EVIDENCE_SQL} SELECT DISTINCT claim_id, document_id FROM ev WHERE retracted AND stance = 'supports'")
def retractions_found(spark, d):
    return b.evidence(spark, d).where("retracted and stance = 'supports'").select("claim_id", "document_id").distinct()


@query("counterevidence_queries", "SELECT item_id, a.family, replace(a.t, '{}', array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ')) AS q FROM benchmark, (VALUES ('academic', '{} null result'), ('academic', '{} replication failure'), ('news', '{} denied'), ('news', '{} disputed')) a(family, t)")
def counterevidence_queries(spark, d):
    angles = spark.createDataFrame([("academic", "{} null result"), ("academic", "{} replication failure"), ("news", "{} denied"), ("news", "{} disputed")], "family string, t string")
    topic = b.table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(tx.tokens(F.col("text")), 1, 4), " ").alias("topic"))
    return topic.join(F.broadcast(angles)).select("item_id", "family", F.replace("t", F.lit("{}"), F.col("topic")).alias("q"))


@query("consecutive_id_validation", "SELECT conv_id, turn, x::BIGINT AS cited FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS x FROM conversations) WHERE length(x) < 15 AND x::BIGINT NOT IN (SELECT doc_id FROM documents)")
def consecutive_id_validation(spark, d):
    c = b.table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("x")).where(F.length("x") < 15)
    ids = b.documents(spark, d).select(F.col("id").alias("cited"))
    return c.select("conv_id", "turn", F.col("x").cast("bigint").alias("cited")).join(ids, "cited", "left_anti")


@query("cross_tenant_isolation", "SELECT l_orderkey AS claim_id, l_suppkey AS source_key FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey")
def cross_tenant_isolation(spark, d):
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(b.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(o, "l_orderkey").join(s, "l_suppkey").where("c_nationkey <> s_nationkey").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_key"))
