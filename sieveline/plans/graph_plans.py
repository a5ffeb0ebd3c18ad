"""Citation graph and views over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import graph
from ..operators import relational as rel
from .registry import query

_C = f"WITH {b.CITATIONS_SQL}"


@query("resolved_citations", f"{_C} SELECT citing, cited, depth FROM cit WHERE cited IS NOT NULL")
def resolved_citations(spark, d):
    return b.citations(spark, d).where("cited is not null").select("citing", "cited", "depth")


@query("unresolved_frontier", f"{_C} SELECT cited_doi, count(*) AS wanted FROM cit WHERE cited IS NULL AND cited_doi <> '' GROUP BY 1 ORDER BY wanted DESC, cited_doi LIMIT 20")
def unresolved_frontier(spark, d):
    c = b.citations(spark, d).where("cited is null and cited_doi <> ''")
    return c.groupBy("cited_doi").agg(F.count("*").alias("wanted")).orderBy(F.desc("wanted"), "cited_doi").limit(20)


@query("in_degree", f"{_C} SELECT cited AS id, count(*) AS n FROM cit WHERE cited IS NOT NULL GROUP BY 1 ORDER BY n DESC, id LIMIT 40")
def in_degree(spark, d):
    return b.citations(spark, d).where("cited is not null").groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(40)


@query("citation_stats", f"{_C} SELECT count(*) AS total, count(cited) AS resolved, count(*) - count(cited) AS unresolved, coalesce(max(depth), 0) AS depth FROM cit")
def citation_stats(spark, d):
    return b.citations(spark, d).agg(F.count("*").alias("total"), F.count("cited").alias("resolved"), (F.count("*") - F.count("cited")).alias("unresolved"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


@query("references_of", f"{_C} SELECT citing, cited FROM cit WHERE citing % 20 = 0")
def references_of(spark, d):
    return b.citations(spark, d).where("citing % 20 = 0").select("citing", "cited")


@query("citing_of", f"{_C} SELECT cited, count(*) AS citing FROM cit WHERE cited % 20 = 0 GROUP BY 1")
def citing_of(spark, d):
    return b.citations(spark, d).where("cited % 20 = 0").groupBy("cited").agg(F.count("*").alias("citing"))


@query("join_edge_both_ends", f"{_C} SELECT DISTINCT citing, cited FROM cit WHERE cited IS NOT NULL AND (citing % 20 = 0 OR (cited % 20 = 0 AND cited IN (SELECT doc_id FROM documents)))")
def join_edge_both_ends(spark, d):
    seeds = b.documents(spark, d).where("id % 20 = 0").select(F.col("id").alias("seed"))
    return rel.edges_touching(b.citations(spark, d).where("cited is not null").select("citing", "cited"), seeds, "citing", "cited", "seed")


@query("citation_add", f"{_C} SELECT DISTINCT citing, coalesce(cited, -1) AS cited, coalesce(cited_doi, '') AS cited_doi FROM cit")
def citation_add(spark, d):
    c = b.citations(spark, d).select("citing", F.coalesce("cited", F.lit(-1)).alias("cited"), F.coalesce("cited_doi", F.lit("")).alias("cited_doi"))
    return c.union(c).dropDuplicates(["citing", "cited", "cited_doi"])


@query("resolve_citations", f"{_C}, doi AS (SELECT doc_id AS id, '10.1000/x' || doc_id AS doi FROM documents) SELECT citing, coalesce(cit.cited, doi.id) AS cited FROM cit LEFT JOIN doi ON doi.doi = cit.cited_doi")
def resolve_citations(spark, d):
    doi = b.documents(spark, d).select(F.col("id").alias("held"), F.concat(F.lit("10.1000/x"), F.col("id").cast("string")).alias("cited_doi"))
    return graph.resolve(b.citations(spark, d), doi).select("citing", "cited")


_CHASE = f"""WITH RECURSIVE {b.CITATIONS_SQL}, walk(seed, id, hop) AS (SELECT doc_id, doc_id, 0 FROM documents WHERE doc_id % 20 = 0
  UNION SELECT w.seed, c.cited, w.hop + 1 FROM walk w JOIN cit c ON c.citing = w.id WHERE c.cited IS NOT NULL AND w.hop < 3 AND c.cited IN (SELECT doc_id FROM documents))
SELECT seed, id, min(hop)::INTEGER AS hop FROM walk GROUP BY 1, 2"""


@query("citation_chase", _CHASE)
def citation_chase(spark, d):
    docs = b.documents(spark, d).select("id")
    edges = b.citations(spark, d).where("cited is not null").select(F.col("citing").alias("src"), F.col("cited").alias("dst"))
    edges = edges.join(docs.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return graph.chase(docs.where("id % 20 = 0").select(F.col("id").alias("seed")), edges, 3)


@query("citation_edges_reverse", f"{_C} SELECT cited AS id, array_to_string(list_sort(list(citing)), ',') AS cited_by FROM cit WHERE cited IS NOT NULL GROUP BY 1")
def citation_edges_reverse(spark, d):
    c = b.citations(spark, d).where("cited is not null").groupBy(F.col("cited").alias("id")).agg(F.sort_array(F.collect_list("citing")).alias("l"))
    return c.select("id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("cited_by"))


_HEADS = "heads AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS head FROM documents)"


@query("join_represented", f"{_C}, {_HEADS} SELECT DISTINCT a.head AS source, z.head AS target FROM cit JOIN heads a ON a.id = citing JOIN heads z ON z.id = cited WHERE a.head <> z.head")
def join_represented(spark, d):
    return graph.represented(b.citations(spark, d).where("cited is not null").select("citing", "cited"), _heads(spark, d))


def _heads(spark, d):
    h = b.documents(spark, d).select("id", F.md5("text").alias("h"))
    return h.join(h.groupBy("h").agg(F.min("id").alias("head")), "h").select("id", "head")


@query("graph_view", f"""{_C}, {_HEADS}, e AS (SELECT DISTINCT a.head AS source, z.head AS target FROM cit JOIN heads a ON a.id = citing JOIN heads z ON z.id = cited WHERE a.head <> z.head),
n AS (SELECT head AS id, count(*) AS folded FROM heads GROUP BY 1) SELECT n.id, folded, (SELECT count(*) FROM e WHERE source = n.id) AS out_edges, (SELECT count(*) FROM e WHERE target = n.id) AS in_edges FROM n""")
def graph_view(spark, d):
    e = graph.represented(b.citations(spark, d).where("cited is not null").select("citing", "cited"), _heads(spark, d))
    n = _heads(spark, d).groupBy(F.col("head").alias("id")).agg(F.count("*").alias("folded"))
    out = e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_edges"))
    inn = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_edges"))
    return n.join(out, "id", "left").join(inn, "id", "left").select("id", "folded", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("in_edges", F.lit(0)).alias("in_edges"))


@query("union_graph", "SELECT 'claim' AS kind, o_orderkey AS id FROM orders UNION SELECT 'evidence', l_partkey FROM lineitem")
def union_graph(spark, d):
    o = b.claims(spark, d).select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    return o.unionByName(b.table(spark, d, "lineitem").select(F.lit("evidence").alias("kind"), F.col("l_partkey").alias("id"))).distinct()


@query("closer_than_original", f"WITH {b.EVIDENCE_SQL}, x AS (SELECT claim_id, document_id, CASE WHEN source_type = 'regulatory_document' THEN 0 WHEN source_type IN ('academic_preprint','academic_peer_reviewed','press_release') THEN 1 ELSE 3 END AS dist FROM ev) SELECT a.claim_id, count(*) AS closer FROM x a JOIN x o USING (claim_id) WHERE a.dist < o.dist AND a.document_id <> o.document_id GROUP BY 1")
def closer_than_original(spark, d):
    """Per claim, pairs of documents of which one is closer to a record: from counts by distance, not from pairs."""
    from ..operators.claims import primary_source_distance

    x = b.evidence(spark, d).select("claim_id", "document_id", primary_source_distance(F.col("source_type")).alias("dist"))
    def pairs(keys, name):
        n = x.groupBy(*keys, "dist").agg(F.count("*").alias("n"))
        far = n.toDF(*keys, "far", "m")
        return n.join(far, keys).where("dist < far").groupBy("claim_id").agg(F.sum(F.col("n") * F.col("m")).alias(name))

    # a document linked at two distances is no pair with itself
    out = pairs(["claim_id"], "every").join(pairs(["claim_id", "document_id"], "own"), "claim_id", "left")
    return out.select("claim_id", (F.col("every") - F.coalesce("own", F.lit(0))).alias("closer")).where("closer > 0")


@query("primary_source_candidates", """SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1)))::INTEGER AS links, list_sort(regexp_extract_all(html, 'href="/([^"]*)"', 1))[1] AS first_link FROM pages""")
def primary_source_candidates(spark, d):
    p = b.table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)).alias("l"))
    return p.select("page_id", F.size(F.array_distinct("l")).alias("links"), F.get(F.array_sort("l"), F.lit(0)).alias("first_link"))


@query("join_attribution", r"""WITH k AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || '/' AS home FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)[1:50]) AS link FROM pages)
SELECT link, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM l GROUP BY 1 HAVING count(DISTINCT page_id) > 1""")
def join_attribution(spark, d):
    """Links that several pages credit, within the first fifty of each."""
    p = b.table(spark, d, "pages").select("page_id", F.explode(F.slice(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), 1, 50)).alias("link"))
    return p.groupBy("link").agg(F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")
