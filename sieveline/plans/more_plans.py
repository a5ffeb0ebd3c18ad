"""The rest of the inventory: document assembly, small lookups, rules and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import fingerprint as fp
from ..functions import ids
from ..functions import text as tx
from ..operators import dedup, logs
from ..operators import relational as rel
from . import dedup_plans as dp
from . import log_plans as lp
from .registry import query
from .texts import _TITLE

_HASH1 = r"CASE WHEN trim(regexp_replace(lower(text), '\s+', ' ', 'g')) <> '' THEN 'sha256:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) END"


@query("build_document", f"""SELECT id, h AS content_hash, CASE WHEN len(string_split(t, ' ')) >= 3 AND length(replace(t, ' ', '')) >= 12 THEN replace(t, ' ', '-') END AS title_key, least(n, 400000)::INTEGER AS n_chars, lang AS language, outlet
FROM (SELECT doc_id AS id, {_HASH1} AS h, {_TITLE} AS t, length(text) AS n, lang, source AS outlet FROM documents)""")
def build_document(spark, d):
    x = b.documents(spark, d)
    return x.select("id", fp.content_hash(F.col("text")).alias("content_hash"), tx.title_key(F.col("title")).alias("title_key"), F.length(tx.truncate(F.col("text"), 400_000)).alias("n_chars"), F.col("lang").alias("language"), "outlet")


@query("persist", f"""WITH {dp._ALL}, f AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {_HASH1}) AS first_id FROM documents)
SELECT f.id, CASE WHEN first_id < f.id THEN first_id WHEN relation IN ('syndicated_copy', 'near_duplicate', 'derived_article') THEN matched_id END AS parent,
CASE WHEN first_id < f.id THEN 'exact' WHEN relation IN ('syndicated_copy', 'near_duplicate') THEN 'duplicate' WHEN relation = 'derived_article' THEN 'derived' ELSE 'new' END AS outcome FROM f LEFT JOIN ver ON ver.id = f.id""")
def persist(spark, d):
    """What becomes of each arrival: exact copy first, else by similarity to earlier documents."""
    docs = b.documents(spark, d)
    exact = dedup.identity_verdicts(docs).select("id", F.col("matched_id").alias("first_id"))
    near = dp._verdicts(spark, d).select("id", F.col("matched_id").alias("near_id"), "relation")
    j = docs.select("id").join(exact, "id", "left").join(near, "id", "left")
    copy, derived, held = F.col("relation").isin("syndicated_copy", "near_duplicate"), F.col("relation") == "derived_article", F.col("first_id").isNotNull()
    return j.select("id", F.when(held, F.col("first_id")).when(copy | derived, F.col("near_id")).alias("parent"), F.when(held, "exact").when(copy, "duplicate").when(derived, "derived").otherwise("new").alias("outcome"))


@query("count_independent", f"{dp._FOREST} SELECT count(*) AS documents, count(DISTINCT independence_key) AS independent FROM keys")
def count_independent(spark, d):
    return dp._keys(spark, d).agg(F.count("*").alias("documents"), F.count_distinct("independence_key").alias("independent"))


_VENUE = "['arXiv (Cornell University)', 'Journal of Things', 'SSRN Electronic Journal', 'bioRxiv', 'Research Square notes', 'Proceedings'][(p_partkey % 6) + 1]"


@query("classify_work", f"""SELECT p_partkey AS id, CASE WHEN regexp_matches(concat_ws(' ', p_type, {_VENUE}, CASE WHEN p_partkey % 7 = 0 THEN '10.48550/x' END, p_name), '{ids.PREPRINTS}') THEN 'academic_preprint' ELSE 'academic_peer_reviewed' END AS kind FROM part""")
def classify_work(spark, d):
    venues = F.array(*map(F.lit, ("arXiv (Cornell University)", "Journal of Things", "SSRN Electronic Journal", "bioRxiv", "Research Square notes", "Proceedings")))
    p = b.table(spark, d, "part").withColumn("venue", F.get(venues, (F.col("p_partkey") % 6).cast("int")))
    return p.select(F.col("p_partkey").alias("id"), ids.classify_work(F.col("p_type"), F.col("venue"), F.when(F.col("p_partkey") % 7 == 0, "10.48550/x"), F.col("p_name")).alias("kind"))


@query("family_for", f"WITH {b.EVIDENCE_SQL} SELECT CASE WHEN source_type LIKE 'academic%' THEN 'academic' WHEN source_type LIKE '%news%' THEN 'news' WHEN source_type = 'press_release' THEN 'corporate' WHEN source_type = 'regulatory_document' THEN 'government' ELSE 'web' END AS family, count(*) AS n FROM ev GROUP BY 1")
def family_for(spark, d):
    return b.evidence(spark, d).groupBy(ids.family_for(F.col("source_type")).alias("family")).agg(F.count("*").alias("n"))


@query("join_self_same_entity", "SELECT o.l_partkey AS document_id, count(*) AS edges FROM lineitem s JOIN lineitem o ON s.l_suppkey = o.l_suppkey WHERE s.l_partkey % 20 = 0 AND o.l_partkey <> s.l_partkey GROUP BY 1")
def join_self_same_entity(spark, d):
    """Documents that mention what a seed mentions; counts per entity are joined, not mentions."""
    m = b.table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    s = m.where("l_partkey % 20 = 0").toDF("l_suppkey", "seed", "k")
    return s.join(m, "l_suppkey").where("l_partkey <> seed").groupBy(F.col("l_partkey").alias("document_id")).agg(F.sum(F.col("n") * F.col("k")).alias("edges"))


@query("snippet", r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT id, w, list_position(list_transform(w, lambda x: lower(x)), 'license,') AS p FROM w)
SELECT id, substr(array_to_string(w[greatest(1, p - 7) : greatest(1, p - 7) + 13], ' '), 1, 300) AS snippet FROM p WHERE p > 0""")
def snippet(spark, d):
    w = b.documents(spark, d).select("id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    p = w.withColumn("p", F.array_position(F.transform("w", lambda x: F.lower(x)), "license,")).where("p > 0")
    return p.select("id", F.substring(F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("p") - 7).cast("int"), F.lit(14)), " "), 1, 300).alias("snippet"))


@query("sanitize_external_text", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?im)^(\s*)(system|assistant|user|developer)(\s*):', '\1[\2]\3;', 'g'), '(?i)<(/?\s*(?:document|evidence|system|instructions?)\b)', '(\1', 'g') AS safe FROM conversations")
def sanitize_external_text(spark, d):
    return b.table(spark, d, "conversations").select("conv_id", "turn", tx.sanitize(F.col("text")).alias("safe"))


@query("author_names", r"""SELECT s_suppkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(s_name || ';  ' || n_name || ' and ' || c_name || ', ' || r_name, '\s*(?:;|\||,|\band\b)\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_custkey = s_suppkey""")
def author_names(spark, d):
    n = b.table(spark, d, "nation").join(F.broadcast(b.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    j = b.table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(b.table(spark, d, "customer"), F.col("c_custkey") == F.col("s_suppkey"))
    raw = F.concat("s_name", F.lit(";  "), "n_name", F.lit(" and "), "c_name", F.lit(", "), "r_name")
    return j.select(F.col("s_suppkey").alias("id"), F.array_join(ids.split_authors(raw), "|").alias("names"))


#: Texts that name DOIs: a document's first line, with references of its own id and others'.
_REFS = "substring_index(text, chr(10), 1) || ' see 10.1000/A' || (doc_id % 30) || ', also doi:10.1000/b(' || (doc_id % 7) || ')). and 10.1000/a' || (doc_id % 30) || '; [10.12345/' || doc_id || ']'"
_FOUND = r"""nm AS (SELECT doc_id, unnest(regexp_extract_all(split_part(text, chr(10), 1) || ' see 10.1000/A' || (doc_id % 30) || ', also doi:10.1000/b(' || (doc_id % 7) || ')). and 10.1000/a' || (doc_id % 30) || '; [10.12345/' || doc_id || ']', '\b10\.\d{4,9}/[^\s"''<>]+')) AS raw FROM documents),
tr AS (SELECT doc_id, raw, regexp_replace(raw, '[.,;:)\]}>"'']+$', '') AS t FROM nm),
dois AS (SELECT DISTINCT doc_id, lower(t || repeat(')', least(greatest(0, length(replace(t, ')', '')) - length(replace(t, '(', ''))), length(regexp_extract(substr(raw, length(t) + 1), '^\)*')))::INTEGER)) AS doi FROM tr)"""


def _named_dois(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.explode(ids.extract_dois(F.expr(_REFS))).alias("doi"))


@query("extract_doi", f"WITH {_FOUND} SELECT doc_id AS id, doi FROM dois")
def extract_doi(spark, d):
    return _named_dois(spark, d).select(F.col("doc_id").alias("id"), "doi")


@query("doi_chase", f"WITH {_FOUND} SELECT doi, count(*) AS mentions FROM dois WHERE doi NOT IN (SELECT '10.1000/a' || (doc_id % 10) FROM documents) GROUP BY 1")
def doi_chase(spark, d):
    """DOIs named in texts that no held document has."""
    held = b.documents(spark, d).select(F.concat(F.lit("10.1000/a"), (F.col("id") % 10).cast("string")).alias("doi")).distinct()
    return _named_dois(spark, d).groupBy("doi").agg(F.count("*").alias("mentions")).join(held, "doi", "left_anti")


@query("doi_to_url", f"WITH {_FOUND} SELECT doc_id AS id, 'https://doi.org/' || doi AS url FROM dois")
def doi_to_url(spark, d):
    return _named_dois(spark, d).select(F.col("doc_id").alias("id"), ids.doi_to_url(F.col("doi")).alias("url"))


@query("extract_json", """SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k FROM events""")
def extract_json(spark, d):
    """The object in a fenced block, or embedded in prose."""
    e = b.table(spark, d, "events")
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("I think "), F.col("props"), F.lit(" is it")))
    return e.select("event_id", F.get_json_object(tx.json_in(prose), "$.k").cast("int").alias("k"))


@query("metadata_merge", "SELECT user_id AS id, arg_min(event_type, event_id) AS kind, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def metadata_merge(spark, d):
    """Maps merged in order of arrival: the first value of a key stays."""
    e = b.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("l"))
    first = F.aggregate("l", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(F.create_map(F.lit("kind"), x["event_type"], F.concat(F.lit("k:"), x["event_type"]), x["event_type"]), lambda k, v: ~F.map_contains_key(m, k)), m))
    m = e.select("id", first.alias("m"))
    return m.select("id", F.col("m")["kind"].alias("kind"), (F.size("m") - 1).cast("bigint").alias("kinds"))


@query("exhausted", f"{lp._L}, {lp._USE}, {lp._LIM} SELECT provider, u.kind FROM used u JOIN lim ON lim.kind = u.kind WHERE used >= lim")
def exhausted(spark, d):
    limits = spark.createDataFrame(lp.LIMITS, "kind string, `limit` double")
    return logs.budget_snapshot(logs.budget_usage(b.calls(spark, d)), limits).where("state = 'exhausted'").select("provider", "kind")


@query("forward_citation_check", f"WITH {b.EVIDENCE_SQL}, r AS (SELECT claim_id, document_id, row_number() OVER (PARTITION BY claim_id ORDER BY published_at, document_id)::INTEGER AS rank FROM ev WHERE stance = 'supports' AND source_type LIKE 'academic%') SELECT claim_id, document_id, rank FROM r WHERE rank <= 3")
def forward_citation_check(spark, d):
    """The first three supporting academic documents of each claim, whose citing works are looked up next."""
    ev = b.evidence(spark, d).where("stance = 'supports' and source_type like 'academic%'")
    return rel.top_per_group(ev, ["claim_id"], [F.col("published_at"), F.col("document_id")], 3).select("claim_id", "document_id", "rank")


@query("passage_index", r"SELECT id, idx::INTEGER AS idx, length(p)::INTEGER AS n_chars FROM (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS idx FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> '')")
def passage_index(spark, d):
    p = b.documents(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("i", "p")).where("trim(p) <> ''")
    return p.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("i")) - 1).alias("idx"), F.length("p").alias("n_chars"))


@query("year_range", f"WITH {b.EVIDENCE_SQL} SELECT claim_id, CASE WHEN min(year(published_at)) = max(year(published_at)) THEN min(year(published_at))::VARCHAR ELSE min(year(published_at)) || '-' || max(year(published_at)) END AS years FROM ev GROUP BY 1")
def year_range(spark, d):
    y = b.evidence(spark, d).groupBy("claim_id").agg(F.min(F.year("published_at")).alias("a"), F.max(F.year("published_at")).alias("z"))
    return y.select("claim_id", F.when(F.col("a") == F.col("z"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("z").cast("string"))).alias("years"))


@query("encode_dt", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def encode_dt(spark, d):
    return b.table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


@query("ui_investigations", "SELECT conv_id, count(*) AS tasks, count(*) FILTER (role = 'assistant') AS answered, max(turn) AS last_turn FROM conversations GROUP BY 1")
def ui_investigations(spark, d):
    return b.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("role") == "assistant").alias("answered"), F.max("turn").alias("last_turn"))


@query("snapshot_store", "SELECT event_type AS investigation, max(event_id) AS latest, count(*) AS versions FROM events GROUP BY 1")
def snapshot_store(spark, d):
    e = b.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("investigation")).agg(F.max("event_id").alias("latest"), F.count("*").alias("versions"))


@query("budget_limits", "SELECT user_id % 4 AS depth, count(*) FILTER (user_id % 4 <= 2) AS admitted, count(*) AS asked FROM events GROUP BY 1")
def budget_limits(spark, d):
    e = b.table(spark, d, "events").withColumn("depth", F.col("user_id") % 4)
    return e.groupBy("depth").agg(F.count_if(F.col("depth") <= 2).alias("admitted"), F.count("*").alias("asked"))
