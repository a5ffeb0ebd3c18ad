"""Copies and independent sources over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import fingerprint as fp
from ..functions import ids
from ..operators import dedup, setjoin
from ..shared import cut
from .registry import query
from .texts import _TITLE

_HASH = r"CASE WHEN trim(regexp_replace(lower(text), '\s+', ' ', 'g')) <> '' THEN 'sha256:' || sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) END"
_TKEY = "CASE WHEN len(string_split(t, ' ')) >= 3 AND length(replace(t, ' ', '')) >= 12 THEN replace(t, ' ', '-') END"
_IDS = f"""ids AS (SELECT doc_id AS id, source AS outlet, 0 AS pos, 'content_hash' AS scheme, {_HASH} AS value FROM documents
  UNION ALL SELECT id, outlet, 1, 'title_key', {_TKEY} FROM (SELECT doc_id AS id, source AS outlet, {_TITLE} AS t FROM documents))"""
_TOKS = "tok AS (SELECT doc_id AS id, source AS outlet, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"
_BITS = ", ".join(f"sum(CASE WHEN (('0x' || substr(md5(g), {1 if h == 'hi' else 9}, 8))::BIGINT >> {i}) & 1 = 1 THEN 1 ELSE -1 END) AS {h}{i}" for h in ("hi", "lo") for i in range(32))
_PACK = {h: " + ".join(f"CASE WHEN {h}{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(32)) for h in ("hi", "lo")}
_SIM = f"""{_TOKS},
gram AS (SELECT id, unnest(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)])) AS g FROM tok WHERE len(w) >= 8),
vote AS (SELECT id, {_BITS} FROM gram GROUP BY id),
sim AS (SELECT id, ({_PACK['hi']})::BIGINT AS hi, ({_PACK['lo']})::BIGINT AS lo FROM vote)"""
_PAIRS = f"""{_SIM},
band AS (SELECT id, 0 AS band, hi >> 16 AS value FROM sim UNION ALL SELECT id, 1, hi & 65535 FROM sim UNION ALL SELECT id, 2, lo >> 16 FROM sim UNION ALL SELECT id, 3, lo & 65535 FROM sim),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band, value ORDER BY id) AS r FROM band) WHERE r <= 120),
tk AS (SELECT id, outlet, {_TKEY} AS tkey FROM (SELECT doc_id AS id, source AS outlet, {_TITLE} AS t FROM documents)),
lsh AS (SELECT DISTINCT e.id AS a, o.id AS b FROM early e JOIN band o USING (band, value) WHERE e.id < o.id),
pair AS (SELECT a, b FROM lsh UNION SELECT f.a, tk.id FROM tk JOIN (SELECT tkey, min(id) AS a FROM tk WHERE tkey IS NOT NULL GROUP BY 1) f USING (tkey) WHERE f.a < tk.id)"""
_WIRE_ALT = "|".join(ids.WIRES)
_WIRE_MAP = "{" + ", ".join(f"'{k}': '{v}'" for k, v in ids.WIRES.items()) + "}"
_SETS = "sets AS (SELECT id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM tok)"
_SCORED = f"""{_PAIRS}, {_SETS},
both_ AS (SELECT p.a, p.b, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.s, y.s)) AS i FROM pair p JOIN sets x ON x.id = p.a JOIN sets y ON y.id = p.b),
scored AS (SELECT a, b, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE greatest(i / (na + nb - i), i / na, i / nb) END AS score FROM both_),
best AS (SELECT b AS id, arg_max(a, struct_pack(s := score, n := -a)) AS matched_id, max(score) AS score FROM scored GROUP BY b),
credit AS (SELECT tk.*, MAP {_WIRE_MAP}[lower(coalesce(nullif(regexp_extract(h, '(?i)\\(\\s*({_WIRE_ALT})\\s*\\)', 1), ''), nullif(regexp_extract(h, '(?i)(?:^|\\n)\\s*(?:by\\s+)?({_WIRE_ALT})\\s*[–—-]\\s', 1), '')))] AS wire
  FROM tk JOIN (SELECT doc_id AS id, substr(text, 1, 600) AS h FROM documents) USING (id)),
ver AS (SELECT t.id, t.matched_id, CASE WHEN score >= 0.72 THEN CASE WHEN d.outlet <> m.outlet THEN 'syndicated_copy' ELSE 'near_duplicate' END
    WHEN d.tkey = m.tkey AND (coalesce(d.wire = m.wire, false) OR score >= 0.4) THEN CASE WHEN coalesce(d.wire = m.wire, false) OR d.outlet <> m.outlet THEN 'syndicated_copy' ELSE 'near_duplicate' END
    WHEN score >= 0.4 AND regexp_extract(d.outlet, '([0-9]+)$', 1)::INTEGER % 2 = 0 THEN 'derived_article' ELSE 'independent' END AS relation,
  round(score, 3) AS similarity FROM best t JOIN credit d ON d.id = t.id JOIN credit m ON m.id = t.matched_id)"""


#: The cap on candidates of the queries that keep it: a band value pairs its holders with the earliest so many.
HOT = 120
_CAP = """early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band, value ORDER BY id) AS r FROM band) WHERE r <= 120),
"""
#: The same without it.
_ALL = _SCORED.replace(_CAP, "").replace("FROM early e JOIN band o", "FROM band e JOIN band o")


def _verdicts(spark, d, hot=None):
    docs = b.documents(spark, d)
    return dedup.verdicts(dedup.scored_candidates(docs, hot=hot), docs)


@query("identity_keys", f"WITH {_IDS} SELECT id, pos, scheme, value FROM ids WHERE value IS NOT NULL")
def identity_keys(spark, d):
    return dedup.identities(b.documents(spark, d)).select("id", "pos", "scheme", "value")


@query("first_seen_wins", f"WITH {_IDS} SELECT id, scheme, min(id) OVER (PARTITION BY scheme, value) AS first_id FROM ids WHERE value IS NOT NULL")
def first_seen_wins(spark, d):
    return dedup.first_seen(dedup.identities(b.documents(spark, d))).select("id", "scheme", "first_id")


@query("dedup_identity", f"""WITH {_IDS}, f AS (SELECT id, outlet, min(id) OVER (PARTITION BY value) AS first_id FROM ids WHERE scheme = 'content_hash' AND value IS NOT NULL)
SELECT f.id, f.first_id AS matched_id, CASE WHEN f.outlet <> d.source THEN 'syndicated_copy' ELSE 'exact_duplicate' END AS relation FROM f JOIN documents d ON d.doc_id = f.first_id WHERE f.first_id < f.id""")
def dedup_identity(spark, d):
    return dedup.identity_verdicts(b.documents(spark, d))


@query("simhash", f"WITH {_SIM} SELECT id, hi, lo FROM sim")
def simhash(spark, d):
    return dedup.simhash(b.documents(spark, d))


@query("simhash_bands", f"WITH {_PAIRS} SELECT band::INTEGER AS band, value, count(*) AS n FROM band GROUP BY 1, 2 HAVING n > 1")
def simhash_bands(spark, d):
    return dedup.bands(dedup.simhash(b.documents(spark, d))).groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")


@query("join_lsh_candidates", f"WITH {_PAIRS}, h AS (SELECT p.a, p.b, bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS distance FROM lsh p JOIN sim x ON x.id = p.a JOIN sim y ON y.id = p.b) SELECT a, b, distance::INTEGER AS distance FROM h")
def join_lsh_candidates(spark, d):
    sim = dedup.simhash(b.documents(spark, d))
    p = dedup.lsh_candidates(sim, HOT)
    j = p.join(sim.toDF("a", "ah", "al"), "a").join(sim.toDF("b", "bh", "bl"), "b")
    return j.select("a", "b", (fp.hamming(F.col("ah"), F.col("bh")) + fp.hamming(F.col("al"), F.col("bl"))).cast("int").alias("distance"))


@query("join_similarity_theta", f"WITH {_ALL} SELECT a, b, round(score, 4) AS score FROM scored")
def join_similarity_theta(spark, d):
    docs = b.documents(spark, d)
    return dedup.scored_candidates(docs).select("a", "b", F.round("score", 4).alias("score"))


@query("set_jaccard", f"WITH {_ALL} SELECT a, b, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE i / (na + nb - i) END, 6) AS jaccard, round(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE i / na END, 6) AS containment FROM both_")
def set_jaccard(spark, d):
    docs = b.documents(spark, d)
    i, empty = F.col("i"), F.least("na", "nb") == 0
    jaccard, containment = (F.when(empty, 0.0).otherwise(i / of) for of in (F.col("na") + F.col("nb") - i, F.col("na")))
    return dedup.compared(docs).select("a", "b", F.round(jaccard, 6).alias("jaccard"), F.round(containment, 6).alias("containment"))


@query("dedup_near_lsh", f"WITH {_SCORED} SELECT * FROM ver")
def dedup_near_lsh(spark, d):
    return _verdicts(spark, d, HOT)


_FOREST = f"""WITH RECURSIVE {_ALL},
par AS (SELECT id, matched_id FROM ver WHERE relation <> 'independent'),
up(id, root) AS (SELECT id, matched_id FROM par UNION ALL SELECT up.id, par.matched_id FROM up JOIN par ON par.id = up.root),
roots AS (SELECT id, min(root) AS root FROM up GROUP BY id),
keys AS (SELECT d.doc_id AS id, d.source, d.lang, coalesce(r.root, d.doc_id) AS independence_key FROM documents d LEFT JOIN roots r ON r.id = d.doc_id)"""


def _keys(spark, d):
    docs = b.documents(spark, d)
    return dedup.independence(docs, _verdicts(spark, d).where("relation <> 'independent'").select("id", "matched_id"))


@query("independence_forest", f"{_FOREST} SELECT id, independence_key FROM keys")
def independence_forest(spark, d):
    return _keys(spark, d)


@query("independence_groups", f"{_FOREST} SELECT independence_key, count(*) AS members, array_to_string(list_sort(list(id)), ',') AS ids FROM keys GROUP BY 1 HAVING count(*) > 1")
def independence_groups(spark, d):
    g = _keys(spark, d).groupBy("independence_key").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("id")).alias("ids"))
    return g.where("members > 1").select("independence_key", "members", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("independent_sources", f"{_FOREST} SELECT lang, source AS outlet, count(*) AS documents, count(DISTINCT independence_key) AS independent FROM keys GROUP BY 1, 2")
def independent_sources(spark, d):
    """The flagship: documents against independent sources, by language and outlet."""
    return b.documents(spark, d).join(_keys(spark, d), "id").groupBy("lang", "outlet").agg(F.count("*").alias("documents"), F.count_distinct("independence_key").alias("independent"))


@query("group_head", f"{_FOREST} SELECT independence_key, arg_min(id, struct_pack(c := (id <> independence_key)::INTEGER, i := id)) AS head FROM keys GROUP BY 1")
def group_head(spark, d):
    k = _keys(spark, d)
    return k.groupBy("independence_key").agg(F.min_by("id", F.struct((F.col("id") != F.col("independence_key")).cast("int").alias("c"), F.col("id").alias("i"))).alias("head"))


@query("duplicates_of", f"WITH {_ALL} SELECT matched_id AS id, count(*) AS copies FROM ver WHERE relation IN ('syndicated_copy', 'near_duplicate') GROUP BY 1")
def duplicates_of(spark, d):
    return _verdicts(spark, d).where("relation in ('syndicated_copy', 'near_duplicate')").groupBy(F.col("matched_id").alias("id")).agg(F.count("*").alias("copies"))


@query("acquisition_summary", f"WITH {_ALL} SELECT count(*) AS candidates, count(*) FILTER (relation IN ('syndicated_copy', 'near_duplicate')) AS duplicates, count(*) FILTER (relation = 'derived_article') AS derived, count(*) FILTER (relation IS NULL OR relation = 'independent') AS new FROM documents d LEFT JOIN ver ON ver.id = d.doc_id")
def acquisition_summary(spark, d):
    v = b.documents(spark, d).select("id").join(_verdicts(spark, d), "id", "left")
    r = F.col("relation")
    return v.agg(F.count("*").alias("candidates"), F.count_if(r.isin("syndicated_copy", "near_duplicate")).alias("duplicates"), F.count_if(r == "derived_article").alias("derived"), F.count_if(r.isNull() | (r == "independent")).alias("new"))


@query("different_outlet", "WITH e AS (SELECT a.doc_id AS a, b.doc_id AS b, a.source <> b.source AS different FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id < b.doc_id) SELECT different, count(*) AS pairs FROM e GROUP BY 1")
def different_outlet(spark, d):
    """Outlet against outlet among equal texts: counts by text and outlet, not pairs of documents."""
    g = b.documents(spark, d).groupBy(F.md5("text").alias("h"), "outlet").agg(F.count("*").alias("n"))
    t = g.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    s = t.agg(F.sum("same").cast("long").alias("same"), F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("long").alias("diff"))
    rows = s.select(F.explode(F.array(F.struct(F.lit(False).alias("different"), F.col("same").alias("pairs")), F.struct(F.lit(True).alias("different"), F.col("diff").alias("pairs")))).alias("r"))
    return rows.select("r.different", "r.pairs").where("pairs > 0")


@query("evaluate_independence", f"""WITH {_SCORED}, j AS (SELECT a, b, score >= 0.72 AS predicted, a.quality = b2.quality AS actual FROM scored JOIN labels a ON a.doc_id = scored.a JOIN labels b2 ON b2.doc_id = scored.b)
SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM j""")
def evaluate_independence(spark, d):
    q = b.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("quality")).alias("q"))
    # a pair takes its labels along
    s = dedup.compared(b.documents(spark, d), hot=HOT, more=q)
    j = s.select((dedup.score() >= 0.72).alias("p"), F.explode("q_a").alias("qa"), "q_b").select("p", "qa", F.explode("q_b").alias("qb")).select("p", (F.col("qa.quality") == F.col("qb.quality")).alias("t"))
    return j.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(~F.col("p") & F.col("t")).alias("fn"), F.count_if(~F.col("p") & ~F.col("t")).alias("tn"))


_EXACT = f"""{_PAIRS}, {_SETS},
sh AS (SELECT id, unnest(s) AS g FROM sets),
cls AS (SELECT id, min(id) OVER (PARTITION BY list_sort(s)) AS first_id, len(s) AS n FROM sets WHERE len(s) > 0),
scored AS (SELECT a, b, i / least(x.n, y.n) AS score FROM (SELECT p.id AS a, q.id AS b, count(*) AS i FROM sh p JOIN sh q USING (g) WHERE p.id < q.id GROUP BY 1, 2) JOIN cls x ON x.id = a JOIN cls y ON y.id = b
  WHERE i >= ceil(0.4 * least(x.n, y.n) - 1e-9)),
lnk AS (SELECT u AS id, count(DISTINCT f) AS links FROM (SELECT a AS u, y.first_id AS f, x.first_id AS o FROM scored JOIN cls x ON x.id = a JOIN cls y ON y.id = b
  UNION ALL SELECT b, x.first_id, y.first_id FROM scored JOIN cls x ON x.id = a JOIN cls y ON y.id = b) WHERE f <> o GROUP BY 1),
best AS (SELECT b AS id, arg_max(a, struct_pack(s := score, n := -a)) AS matched_id, max(score) AS score FROM scored GROUP BY b),""" + _SCORED[_SCORED.index("\ncredit AS"):]


def _exact(spark, d, least=dedup.DERIVED, members=None):
    docs = b.documents(spark, d)
    return docs, setjoin.overlap_join(dedup.shingle_sets(docs), least, members=members)


@query("dedup_near_shingle", f"""WITH {_EXACT}
SELECT v.id, v.matched_id, v.relation, v.similarity, coalesce(l.links, 0) AS links FROM ver v LEFT JOIN lnk l ON l.id = v.id""")
def dedup_near_shingle(spark, d):
    """Verdicts by the exact join of all shingle sets: no candidates by fingerprint, no cap."""
    docs, found = _exact(spark, d)
    ver = dedup.verdicts(found.where("matched_id is not null").select(F.col("matched_id").alias("a"), F.col("id").alias("b"), "score"), docs)
    return ver.join(found.select("id", "links"), "id")


@query("similarity_classes", f"""WITH {_EXACT}
SELECT c.id, c.first_id, coalesce(l.links, 0) AS links FROM cls c LEFT JOIN lnk l ON l.id = c.id WHERE l.links > 0 OR c.first_id IN (SELECT first_id FROM cls GROUP BY 1 HAVING count(*) > 1)""".replace("0.4 * least", "0.72 * least"))
def similarity_classes(spark, d):
    """Documents that equal or resemble another by 0.72: the class of equal shingle sets, and how many other classes it links with."""
    return _exact(spark, d, dedup.NEAR)[1].select("id", "first_id", "links")


@query("lsh_recall", f"""WITH {_SCORED},
sh AS (SELECT id, unnest(s) AS g FROM sets),
truth AS (SELECT b, max(i / least(len(x.s), len(y.s))) AS score FROM (SELECT p.id AS a, q.id AS b, count(*) AS i FROM sh p JOIN sh q USING (g) WHERE p.id < q.id GROUP BY 1, 2) JOIN sets x ON x.id = a JOIN sets y ON y.id = b GROUP BY b),
found AS (SELECT b, max(score) AS score FROM scored GROUP BY b)
SELECT level, count(*) AS documents, count(*) FILTER (f.score >= level) AS found FROM truth t LEFT JOIN found f USING (b), (SELECT unnest([0.4, 0.72])::DOUBLE AS level) WHERE t.score >= level - 1e-9 GROUP BY 1""")
def lsh_recall(spark, d):
    """Of the documents with an earlier one so similar, by the exact join, those to which the fingerprints' candidates lead."""
    # what texts share is found once, for both
    members = cut(setjoin.sized_members(dedup.shingle_sets(b.documents(spark, d))), "members")
    docs, exact = _exact(spark, d, members=members)
    lsh = dedup.scored_candidates(docs, hot=HOT, members=members).groupBy(F.col("b").alias("id")).agg(F.max("score").alias("found"))
    levels = F.explode(F.array(F.lit(dedup.DERIVED), F.lit(dedup.NEAR))).alias("level")
    both = exact.where("score is not null").select("id", "score", levels).where("score >= level - 1e-9").join(lsh, "id", "left")
    return both.groupBy("level").agg(F.count("*").alias("documents"), F.count_if(F.col("found") >= F.col("level")).alias("found"))
