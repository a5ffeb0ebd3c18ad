"""Claims judged from their evidence, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source types by what they prove.
PRIMARY = ("corporate_filing", "regulatory_document", "government_document", "official_statement", "transcript")
SELF_REPORTED = ("press_release", "official_statement")
SECONDARY = ("secondary_news_reporting", "web_page", "forum_post", "social_post", "other")
STANCES = ("supports", "contradicts", "qualifies")
#: Steps from an underlying record.
DISTANCE = {
    "corporate_filing": 0, "regulatory_document": 0, "government_document": 0, "official_statement": 0, "transcript": 0,
    "academic_peer_reviewed": 1, "academic_preprint": 1, "press_release": 1, "social_post": 1, "video": 1,
    "original_news_reporting": 2, "forum_post": 3, "secondary_news_reporting": 3, "web_page": 3, "other": 4,
}


def primary_source_distance(source_type: Column) -> Column:
    """0 (a record itself) to 4; unknown types are 4."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DISTANCE.items() for x in kv])[source_type], F.lit(4))


def evidence_summary(links: DataFrame, by: tuple[str, ...] = ("claim_id", "stance")) -> DataFrame:
    """Per claim and stance: documents, independent sources, kinds, retractions, dates. One aggregation."""
    t = F.col("source_type")
    return links.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.count_distinct("source_key").alias("independent"),
        F.count_if(t.isin(*PRIMARY)).alias("primary"),
        F.count_if(t == "academic_preprint").alias("preprints"),
        F.count_if(t == "academic_peer_reviewed").alias("peer_reviewed"),
        F.count_if(t.isin(*SELF_REPORTED)).alias("self_reported"),
        F.count_if(t.isin(*SECONDARY)).alias("secondary"),
        F.count_if("retracted").alias("retracted"),
        F.count_if("has_excerpt").alias("excerpts"),
        F.min("wire_service").alias("wire"),
        F.min("published_at").alias("earliest"),
        F.max("published_at").alias("latest"),
    )


def assessment(claims: DataFrame, links: DataFrame) -> DataFrame:
    """One row per claim: the summaries of its stances side by side, status, gaps, explanation.

    Stances become columns by conditional aggregation: links are shuffled once.
    """
    s = evidence_summary(links)
    cols = [c for c in s.columns if c not in ("claim_id", "stance")]
    wide = s.groupBy("claim_id").agg(*[F.max(F.when(F.col("stance") == st, F.col(c))).alias(f"{st[0]}_{c}") for st in STANCES for c in cols])
    out = claims.select("claim_id").join(wide, "claim_id", "left")
    zero = [f"{st[0]}_{c}" for st in STANCES for c in cols if c not in ("wire", "earliest", "latest")]
    out = out.fillna(0, zero)
    return out.withColumns({"status": derive_status(), "superseded": F.coalesce(F.col("c_latest") > F.col("s_latest"), F.lit(False))}).withColumns({"gaps": gaps(), "explanation": explain()})


def _thin() -> Column:
    one = (F.col("s_independent") <= 1) & (F.col("s_primary") == 0)
    return one & ((F.col("s_secondary") == F.col("s_documents")) | (F.col("s_self_reported") == F.col("s_documents")))


def derive_status() -> Column:
    """Rules over the wide summary: retracted documents do not stand on either side."""
    s, c = F.col("s_documents") - F.col("s_retracted"), F.col("c_documents") - F.col("c_retracted")
    return (
        F.when((F.col("s_documents") == 0) & (F.col("c_documents") == 0), "unverified").when((s > 0) & (c > 0), "mixed").when(c > 0, "contradicted")
        .when(s == 0, "insufficient_evidence").when(_thin(), "insufficient_evidence").otherwise("supported")
    )


#: What is missing, in the order worth addressing: name and rule over the wide summary.
GAPS = (
    ("no_evidence", "s_documents + c_documents + q_documents = 0"),
    ("single_source", "s_documents > 0 and s_independent <= 1"),
    ("no_primary_record", "s_documents > 0 and s_primary = 0"),
    ("no_counterevidence", "s_documents > 0 and c_documents = 0"),
    ("only_self_reported", "s_documents > 0 and s_self_reported = s_documents"),
    ("preprint_only", "s_preprints > 0 and s_peer_reviewed = 0"),
    ("no_excerpt", "s_documents + c_documents + q_documents > 0 and s_excerpts + c_excerpts + q_excerpts = 0"),
)


def gaps() -> Column:
    return F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in GAPS]), lambda g: g.isNotNull())


def _describe(p: str) -> Column:
    c = lambda name: F.col(f"{p}_{name}")
    word = (
        F.when(c("primary") > 0, "primary ").when(c("self_reported") == c("documents"), "self-reported ").when(c("secondary") == c("documents"), "secondary ")
        .when(c("peer_reviewed") == c("documents"), "peer-reviewed ").when(c("preprints") > 0, "preprint ").otherwise("")
    )
    years = F.when(F.year(c("earliest")) == F.year(c("latest")), F.year(c("latest")).cast("string")).otherwise(F.concat(F.year(c("earliest")).cast("string"), F.lit("-"), F.year(c("latest")).cast("string")))
    copies = F.when(c("documents") > c("independent"), F.concat(F.lit(" ("), c("documents").cast("string"), F.lit(" documents, "), (c("documents") - c("independent")).cast("string"), F.lit(" copies)"))).otherwise("")
    return F.concat(c("independent").cast("string"), F.lit(" independent "), word, F.when(c("independent") == 1, "source").otherwise("sources"), copies, F.lit(", "), years)


#: Phrases that readers of an explanation look for. Name, rule over the wide summary, SQL text of the note.
NOTES = (
    ("self_reported", "s_documents > 0 and s_self_reported = s_documents", "'all support comes from the announcing party: evidence that it was claimed, not that it holds'"),
    ("wire", "s_wire is not null and s_independent < s_documents", "concat('copies of one ', s_wire, ' story are counted once')"),
    ("preprints", "s_preprints > 0 and s_primary = 0", "'preprints among the support are not peer reviewed'"),
    ("retracted_support", "s_retracted > 0", "concat(s_retracted, case when s_retracted = 1 then ' retracted item' else ' retracted items' end, ' supporting it')"),
    ("retracted_contradiction", "c_retracted > 0", "concat(c_retracted, case when c_retracted = 1 then ' retracted item' else ' retracted items' end, ' contradicting it')"),
    ("superseded", "superseded", "'what contradicts it is more recent than all support'"),
)


def notes() -> Column:
    """What a reader has to know about the evidence beside its number, in the order of ``NOTES``."""
    return F.concat_ws("; ", *[F.when(F.expr(rule), F.expr(text)) for _, rule, text in NOTES])


def explain() -> Column:
    """Prose on the evidence, counted in independent sources, with notes in brackets; needs ``superseded``."""
    part = lambda p, verb: F.when(F.col(f"{p}_documents") > 0, F.concat(F.lit(verb), _describe(p)))
    said = F.nullif(F.concat_ws("; ", part("s", "supported by "), part("c", "contradicted by "), part("q", "qualified by ")), F.lit(""))
    return F.when(said.isNull(), F.lit("no evidence linked")).when(notes() == "", said).otherwise(F.concat(said, F.lit(" ("), notes(), F.lit(")")))


def snapshot(assessed: DataFrame) -> DataFrame:
    """What a snapshot keeps of each claim."""
    return assessed.select("claim_id", "status", "superseded", F.col("s_independent").alias("support"), F.col("c_independent").alias("contradiction"), F.col("s_retracted").alias("retracted"), (F.col("s_primary") > 0).alias("has_primary"), F.size("gaps").alias("gaps"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``claim_id, kind, changes, material`` of claims that are new, dropped or changed: one full outer join."""
    b, a = (df.select("claim_id", F.struct(*[c for c in df.columns if c != "claim_id"]).alias(n)) for df, n in ((before, "b"), (after, "a")))
    j = b.join(a, "claim_id", "full_outer")
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    up = F.col("a.support") > F.col("b.support")
    rules = [
        ("retracted", F.col("a.retracted") > F.col("b.retracted"), F.lit(True)),
        ("status", F.col("a.status") != F.col("b.status"), F.lit(True)),
        ("superseded", F.col("a.superseded") & ~F.col("b.superseded"), F.lit(True)),
        ("gained", up, (F.col("b.support") < 2) & (F.col("a.support") >= 2)),
        ("lost", F.col("a.support") < F.col("b.support"), F.lit(True)),
        ("counterevidence", F.col("a.contradiction") > F.col("b.contradiction"), F.lit(True)),
        ("primary", F.col("a.has_primary") & ~F.col("b.has_primary"), F.lit(False)),
        ("gaps_closed", F.col("a.gaps") < F.col("b.gaps"), F.lit(False)),
        ("gaps_opened", F.col("a.gaps") > F.col("b.gaps"), F.lit(False)),
    ]
    changes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c, _ in rules]), lambda x: x.isNotNull())
    material = F.lit(False)
    for _, c, m in rules:
        material = material | (F.coalesce(c, F.lit(False)) & m)
    out = j.select(
        "claim_id", F.when(new, "new").when(gone, "dropped").otherwise("changed").alias("kind"),
        F.when(new | gone, F.lit("")).otherwise(F.array_join(changes, ",")).alias("changes"),
        F.when(new, (F.col("a.support") > 0) | (F.col("a.contradiction") > 0)).when(gone, F.lit(False)).otherwise(material).alias("material"),
    )
    return out.where("kind <> 'changed' or changes <> ''")
