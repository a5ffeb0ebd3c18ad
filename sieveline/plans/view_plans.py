"""Views, envelopes, notes and summaries made of the record."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import markdown as md
from ..functions import text as tx
from ..operators import relational as rel
from ..operators import views as vw
from . import claim_plans as cp
from . import dedup_plans as dp
from . import log_plans as lp
from .registry import query

_TRUNC = "CASE WHEN length({0}) <= {1} THEN {0} ELSE regexp_replace(substr({0}, 1, {1} - 1), '\\s+$', '') || '…' END"
_SAFE = r"regexp_replace(regexp_replace({0}, '(?im)^(\s*)(system|assistant|user|developer)(\s*):', '\1[\2]\3;', 'g'), '(?i)<(/?\s*(?:document|evidence|system|instructions?)\b)', '(\1', 'g')"
_TITLE0 = "split_part(text, chr(10), 1)"
_EXACT = "ex AS (SELECT doc_id AS id, nullif(min(doc_id) OVER (PARTITION BY md5(text)), doc_id) AS original FROM documents)"


def _originals(spark, d):
    """``id, original``: the earliest document of the same text, for the later ones."""
    h = b.documents(spark, d).select("id", F.md5("text").alias("h"))
    return h.join(h.groupBy("h").agg(F.min("id").alias("first")), "h").where("first < id").select("id", F.col("first").alias("original"))


# --- envelopes --------------------------------------------------------------
@query("evidence_envelope", f"""WITH {_EXACT}, e AS (SELECT doc_id, source, original, {_TRUNC.format(_SAFE.format(_TITLE0), 300)} AS t, {_TRUNC.format(_SAFE.format('text'), 8000)} AS b FROM documents JOIN ex ON ex.id = doc_id)
SELECT doc_id AS id, md5('<external_evidence id="' || doc_id || '" source_type="web_page" publisher="' || source || '"' || coalesce(' duplicate_of="' || original || '"', '') || '>' || chr(10) || '{vw.WARNING}' || chr(10) || 'TITLE: ' || t || chr(10) || 'CONTENT:' || chr(10) || b || chr(10) || '</external_evidence>') AS h FROM e""")
def evidence_envelope(spark, d):
    docs = b.documents(spark, d).join(_originals(spark, d), "id", "left")
    e = vw.envelope(F.col("id"), F.lit("web_page"), F.col("title"), F.col("text"), 8000, {"publisher": F.col("outlet"), "duplicate_of": F.col("original")})
    return docs.select("id", F.md5(e).alias("h"))


@query("passage_envelope", f"""WITH p AS (SELECT doc_id AS id, i, t, 1 + coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT id, count(*) AS n, sum(length(t)) AS shown FROM p WHERE i <= 2 GROUP BY 1)
SELECT id, n::INTEGER AS passages, shown::BIGINT AS shown, (SELECT length(text) FROM documents WHERE doc_id = id)::BIGINT AS total FROM s""")
def passage_envelope(spark, d):
    """The first two lines of each document as selected passages: what the envelope says of itself."""
    docs = b.documents(spark, d)
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("i < 2").select(F.lit(0).alias("query_id"), "id", F.col("i").alias("start"), "text")
    e = vw.passage_envelopes(lines, docs.select("id", F.length("text").alias("total")))
    said = lambda name: F.regexp_extract("envelope", f'{name}="([0-9]+)"', 1)
    return e.select("id", said("passages").cast("int").alias("passages"), said("shown").cast("bigint").alias("shown"), said("total").cast("bigint").alias("total"))


@query("observation_cap", "SELECT conv_id, array_to_string(list(turn || ':' || role ORDER BY turn) FILTER (r <= 3), ',') AS items, count(*) - count(*) FILTER (r <= 3) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1")
def observation_cap(spark, d):
    c = vw.capped(b.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", ["turn", "role"], 3)
    return c.select("conv_id", F.array_join(F.transform("items", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("items"), F.col("omitted"))


@query("document_brief", f"""WITH {_EXACT} SELECT doc_id AS id, {_TRUNC.format(f"coalesce(nullif({_TITLE0}, ''), '(untitled)')", 120)} AS title, source, original AS not_independent_of, CASE WHEN original IS NOT NULL THEN 'exact' END AS relation FROM documents JOIN ex ON ex.id = doc_id""")
def document_brief(spark, d):
    docs = b.documents(spark, d).join(_originals(spark, d), "id", "left")
    title = tx.truncate(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")), 120)
    return docs.select("id", title.alias("title"), F.col("outlet").alias("source"), F.col("original").alias("not_independent_of"), F.when(F.col("original").isNotNull(), "exact").alias("relation"))


# --- notes ------------------------------------------------------------------
_ESC = "replace(replace(replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[[', '\\[\\['), ']]', '\\]\\]'), '`', '\\`'), '|', '\\|')"
_FILE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '[\\/:*?"<>|#^\[\]\n\r\t]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"""
_CLAIM_NAME = "'claim-' || claim_id || ' ' || status"


@query("vault_notes", f"""{cp._A}, n AS (SELECT claim_id, status, explanation, substr({_FILE.format(_CLAIM_NAME)}, 1, 80) AS name, s_independent FROM a),
ev2 AS (SELECT claim_id, array_to_string(list_sort(list(DISTINCT '- [[evidence-' || document_id || ']] ' || stance)), chr(10)) AS lines FROM ev GROUP BY 1)
SELECT 'Claims/' || name || '.md' AS path, md5('---' || chr(10) || 'generated_by: "{vw.MARKER}"' || chr(10) || 'id: "claim:' || n.claim_id || '"' || chr(10) || 'independent: "' || s_independent || '"' || chr(10) || 'status: "' || status || '"' || chr(10) || 'type: "claim"' || chr(10) || '---' || chr(10)
|| chr(10) || '# ' || {_ESC.format("'claim ' || n.claim_id || ': ' || status")} || chr(10) || chr(10) || explanation || chr(10) || chr(10) || coalesce(lines, '') || chr(10)) AS h FROM n LEFT JOIN ev2 ON ev2.claim_id = n.claim_id""")
def vault_notes(spark, d):
    """A note for each claim: properties, what its evidence amounts to, and a link to each piece of it."""
    a = cp._assessed(spark, d)
    link = F.concat(F.lit("- "), md.wikilink(F.concat(F.lit("evidence-"), F.col("document_id").cast("string"))), F.lit(" "), F.col("stance"))
    lines = b.evidence(spark, d).select("claim_id", link.alias("line")).distinct().groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    named = vw.note_names(a.select("claim_id", "explanation", "s_independent", F.col("claim_id").alias("id"), F.col("status").alias("label"), "status", F.lit("claim").alias("kind"), F.lit("Claims").alias("folder")))
    title = F.concat(F.lit("claim "), F.col("claim_id").cast("string"), F.lit(": "), F.col("status"))
    body = F.concat("explanation", F.lit("\n\n"), F.coalesce("lines", F.lit("")))
    text = vw.note("claim", F.col("claim_id"), {"status": F.col("status"), "independent": F.col("s_independent")}, title, body)
    return named.join(lines, "claim_id", "left").select("path", F.md5(text).alias("h"))


@query("vault_writes", """SELECT 'Evidence/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 4 IN (0, 1)""")
def vault_writes(spark, d):
    """Which notes are written: new ones and changed ones of our own; a person's note at the same path stays."""
    docs = b.documents(spark, d)
    path = F.concat(F.lit("Evidence/"), F.col("id").cast("string"), F.lit(".md"))
    text = vw.note("evidence", F.col("id"), {"outlet": F.col("outlet")}, F.lit("t"), F.lit("body"))
    old = vw.note("evidence", F.col("id"), {"outlet": F.lit("before")}, F.lit("t"), F.lit("body"))
    k = F.col("id") % 4
    present = docs.where("id % 4 <> 0").select(path.alias("path"), F.when(k == 1, old).when(k == 2, text).otherwise(F.lit("my own note")).alias("body"))
    return vw.writable(docs.select(path.alias("path"), text.alias("body")), present).select("path")


@query("markdown_primitives", r"""SELECT item_id, md5('> [!note] T | x' || chr(10) || regexp_replace(regexp_replace(text, '(?m)^', '> ', 'g'), '(?m)^> $', '>', 'g')) AS callout, '[[a (b) ' || item_id || '|see  it]]' AS link FROM benchmark""")
def markdown_primitives(spark, d):
    i = b.table(spark, d, "benchmark")
    link = md.wikilink(F.concat(F.lit("a [b] "), F.col("item_id").cast("string")), F.lit("see |it"))
    return i.select("item_id", F.md5(md.callout("note", F.lit("T | x"), F.col("text"))).alias("callout"), link.alias("link"))


@query("report_prose", f"""{cp._A}, s AS (SELECT status, count(*) AS n FROM a GROUP BY 1), t AS (SELECT count(*) AS claims, count(*) FILTER (len(gaps) > 0) AS open FROM a), e AS (SELECT count(DISTINCT document_id) AS documents, count(DISTINCT source_key) AS sources FROM ev)
SELECT t.claims || ' claims across ' || e.sources || ' independent sources (' || e.documents || ' documents with copies). By status: ' || (SELECT string_agg(n || ' ' || status, ', ' ORDER BY status) FROM s) || '.' || CASE WHEN open > 0 THEN ' ' || open || ' claims still have gaps.' ELSE '' END AS summary FROM t, e""")
def report_prose(spark, d):
    """The summary that a report has when nobody wrote one: counts, no conclusion."""
    a, ev = cp._assessed(spark, d), b.evidence(spark, d)
    by = a.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.size("gaps") > 0).alias("open"))
    s = by.agg(F.sum("n").alias("claims"), F.sum("open").alias("open"), F.array_sort(F.collect_list(F.struct("status", "n"))).alias("l"))  # a row for each status
    e = ev.agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("source_key").alias("sources"))
    t = lambda c: F.col(c).cast("string")
    parts = F.array_join(F.transform("l", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["status"])), ", ")
    said = F.concat(t("claims"), F.lit(" claims across "), t("sources"), F.lit(" independent sources ("), t("documents"), F.lit(" documents with copies). By status: "), parts, F.lit("."), F.when(F.col("open") > 0, F.concat(F.lit(" "), t("open"), F.lit(" claims still have gaps."))).otherwise(""))
    return s.join(F.broadcast(e)).select(said.alias("summary"))


#: What each stopping rule sees, by its name.
STOPS = {
    "budget": "the allowance is used up", "runtime": "the time is used up", "no_open_tasks": "no task is open", "sources_unavailable": "most recent calls failed",
    "diminishing_returns": "recent calls found little that is new", "sufficient": "the claims have no gaps left",
}


@query("stop_describe", lp._STATE.replace("SELECT provider, CASE WHEN exhausted", "SELECT provider, CASE coalesce(stop, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STOPS.items()) + " ELSE 'none holds' END AS described FROM (SELECT provider, CASE WHEN exhausted") + ")")
def stop_describe(spark, d):
    texts = F.create_map(*[F.lit(x) for kv in STOPS.items() for x in kv])
    return lp.stop_rules(spark, d).select("provider", F.coalesce(texts[F.col("stop")], F.lit("none holds")).alias("described"))


# --- JSON views -------------------------------------------------------------
@query("api_tasks", "SELECT c.conv_id AS id, c.turn, p.turn AS parent, c.role, CASE WHEN n.turn IS NULL THEN 'open' ELSE 'done' END AS status FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1")
def api_tasks(spark, d):
    """Turns as tasks: the one before is the parent, one that is followed is done."""
    c = b.table(spark, d, "conversations").select("conv_id", "turn", "role")
    near = lambda by, name: c.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("turn").alias(name))
    j = c.join(near(1, "parent"), ["conv_id", "turn"], "left").join(near(-1, "next"), ["conv_id", "turn"], "left")
    return j.select(F.col("conv_id").alias("id"), "turn", "parent", "role", F.when(F.col("next").isNull(), "open").otherwise("done").alias("status"))


@query("api_claims", f"""{cp._A}, l AS (SELECT claim_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT stance || ':' || document_id)), ',') AS links FROM ev GROUP BY 1) SELECT a.claim_id, status, explanation, coalesce(n, 0) AS n_links, coalesce(links, '') AS links FROM a LEFT JOIN l USING (claim_id)""")
def api_claims(spark, d):
    """Assessed claims with their links; a claim's links are what the record holds of it."""
    l = b.evidence(spark, d).groupBy("claim_id").agg(F.count("*").alias("n_links"), F.array_join(F.array_sort(F.collect_set(F.concat("stance", F.lit(":"), F.col("document_id").cast("string")))), ",").alias("links"))
    a = cp._assessed(spark, d).select("claim_id", "status", "explanation").join(l, "claim_id", "left")
    return a.select("claim_id", "status", "explanation", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("links", F.lit("")).alias("links"))


@query("api_sources", f"WITH {_EXACT} SELECT d.doc_id AS id, d.source AS outlet, {_TRUNC.format(_TITLE0, 120)} AS title, (SELECT count(*) FROM ex WHERE ex.original = d.doc_id) AS copies FROM documents d JOIN ex ON ex.id = d.doc_id WHERE ex.original IS NULL")
def api_sources(spark, d):
    """Originals with the number of their copies."""
    o = _originals(spark, d)
    docs = b.documents(spark, d).join(o.select("id"), "id", "left_anti")
    n = o.groupBy(F.col("original").alias("id")).agg(F.count("*").alias("copies"))
    return docs.join(n, "id", "left").select("id", "outlet", tx.truncate(F.col("title"), 120).alias("title"), F.coalesce("copies", F.lit(0)).alias("copies"))


@query("api_activity", "SELECT * FROM (SELECT 'searches' AS list, event_id AS id FROM events WHERE event_type IN ('view', 'click') ORDER BY ts DESC, event_id DESC LIMIT 200) UNION ALL SELECT * FROM (SELECT 'fetches', event_id FROM events WHERE event_type NOT IN ('view', 'click') ORDER BY ts DESC, event_id DESC LIMIT 200)")
def api_activity(spark, d):
    c = b.calls(spark, d)
    last = lambda name, df: df.orderBy(F.desc("ts"), F.desc("call_id")).limit(200).select(F.lit(name).alias("list"), F.col("call_id").alias("id"))
    search = F.col("kind").isin("view", "click")
    return last("searches", c.where(search)).unionByName(last("fetches", c.where(~search)))


@query("api_documents", f"""WITH {_EXACT}, {b.EVIDENCE_SQL}, l AS (SELECT document_id, count(*) AS n FROM ev GROUP BY 1)
SELECT doc_id AS id, source AS outlet, lang AS language, {dp._HASH} AS content_hash, original AS duplicate_of, coalesce(original, doc_id) AS independence_key, coalesce(n, 0) AS claims, least(length(text), 20000)::INTEGER AS shown FROM documents JOIN ex ON ex.id = doc_id LEFT JOIN l ON l.document_id = doc_id""")
def api_documents(spark, d):
    """What the view of one document shows, for every document."""
    from ..functions import fingerprint as fp

    n = b.evidence(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    j = b.documents(spark, d).join(_originals(spark, d), "id", "left").join(n, "id", "left")
    return j.select("id", "outlet", F.col("lang").alias("language"), fp.content_hash(F.col("text")).alias("content_hash"), F.col("original").alias("duplicate_of"), F.coalesce("original", "id").alias("independence_key"), F.coalesce("n", F.lit(0)).alias("claims"), F.least(F.length("text"), F.lit(20_000)).alias("shown"))


@query("api_entities", "SELECT s_suppkey AS id, s_name AS name, count(DISTINCT l_partkey) AS documents, count(DISTINCT l_orderkey) AS claims FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2")
def api_entities(spark, d):
    """Entities with how many documents mention them and how many claims rest on those."""
    m = b.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("documents"), F.count_distinct("l_orderkey").alias("claims"))
    s = b.table(spark, d, "supplier").join(m, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("claims", F.lit(0)).alias("claims"))


# --- records that change ----------------------------------------------------
@query("task_lifecycle", """WITH s AS (SELECT user_id AS task_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last, min(ts) AS created FROM events GROUP BY 1),
t AS (SELECT task_id, created, CASE last WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, task_id % 10 AS priority FROM s)
SELECT task_id, status, CASE WHEN status IN ('pending', 'running') THEN 'skipped' ELSE status END AS at_end, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status, priority ORDER BY created, task_id) = 1 ELSE false END AS next_of_priority FROM t""")
def task_lifecycle(spark, d):
    """Each task's status, what it is when the run ends, and whether it is the next pending one of its priority."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    s = b.table(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(last.alias("last"), F.min("ts").alias("created"))
    status = F.when(F.col("last") == "view", "running").when(F.col("last") == "purchase", "done").when(F.col("last") == "error", "failed").otherwise("pending")
    t = s.select("task_id", "created", status.alias("status"), (F.col("task_id") % 10).alias("priority"))
    first = t.where("status = 'pending'").groupBy("priority").agg(F.min(F.struct("created", "task_id")).alias("m")).select(F.col("m.task_id").alias("task_id"), F.lit(True).alias("next_of_priority"))
    j = t.join(first, "task_id", "left")
    return j.select("task_id", "status", F.when(F.col("status").isin("pending", "running"), "skipped").otherwise(F.col("status")).alias("at_end"), F.coalesce("next_of_priority", F.lit(False)).alias("next_of_priority"))


@query("entity_enrich", """SELECT n_nationkey AS entity, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS aliases, count(DISTINCT c_custkey) AS name_only, count(DISTINCT c_custkey) > 0 AS review_needed FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY 1""")
def entity_enrich(spark, d):
    """Aliases gathered by entity, and matches by name alone, which ask for review."""
    a = b.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("entity")).agg(F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("aliases"))
    w = b.table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("entity")).agg(F.count("*").alias("name_only"))
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("entity")).join(a, "entity", "left").join(w, "entity", "left")
    return n.select("entity", "aliases", F.coalesce("name_only", F.lit(0)).alias("name_only"), (F.coalesce("name_only", F.lit(0)) > 0).alias("review_needed"))


@query("entity_mentions", "SELECT DISTINCT l_partkey AS subject_id, 'MENTIONS' AS predicate, l_suppkey AS object_id, l_partkey AS evidence_id FROM lineitem")
def entity_mentions(spark, d):
    """Mention edges, each with its document as proof; recorded once however often a document repeats one."""
    m = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.lit("MENTIONS").alias("predicate"), F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("evidence_id"))
    return rel.insert_or_ignore(m.limit(0), m, ["subject_id", "predicate", "object_id"])
