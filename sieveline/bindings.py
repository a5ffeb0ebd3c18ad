"""How the driver's tables stand for the engine's concepts. The only place that knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores is dealt out; large tables stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence documents: id (also the order of arrival), outlet, title (first line), text, language, family.

    Outlets of an even number are news, the others web.
    """
    d = spread(table(spark, sf_dir, "documents"))
    family = F.when(F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2 == 0, "news").otherwise("web")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("outlet"), "lang", "text", F.substring_index("text", "\n", 1).alias("title"), family.alias("family"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: orders, of which each has an id, a day and a priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"))


#: l_returnflag as the stance of a piece of evidence.
STANCE = {"N": "supports", "R": "contradicts", "A": "qualifies"}
#: l_suppkey modulo 6 as the type of its source.
SOURCE_TYPES = ("regulatory_document", "academic_preprint", "academic_peer_reviewed", "press_release", "secondary_news_reporting", "web_page")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-evidence links: lineitem. The supplier is the independent source behind a document.

    One in 50 documents is retracted; one in 7 has no verbatim excerpt.
    """
    li = table(spark, sf_dir, "lineitem")
    types = F.array(*map(F.lit, SOURCE_TYPES))
    return li.select(
        F.col("l_orderkey").alias("claim_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("document_id"),
        F.when(F.col("l_returnflag") == "N", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("qualifies").alias("stance"),
        F.col("l_suppkey").alias("source_key"),
        F.get(types, (F.col("l_suppkey") % 6).cast("int")).alias("source_type"),
        F.col("l_shipdate").alias("published_at"),
        (F.col("l_partkey") % 50 == 0).alias("retracted"),
        (F.col("l_partkey") % 7 != 0).alias("has_excerpt"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("Reuters")).alias("wire_service"),
    )


#: The same binding in SQL, for the oracles.
EVIDENCE_SQL = """ev AS (SELECT l_orderkey AS claim_id, l_partkey * 10 + l_linenumber AS document_id,
  CASE l_returnflag WHEN 'N' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'qualifies' END AS stance,
  l_suppkey AS source_key,
  ['regulatory_document','academic_preprint','academic_peer_reviewed','press_release','secondary_news_reporting','web_page'][(l_suppkey % 6) + 1] AS source_type,
  l_shipdate AS published_at, l_partkey % 50 = 0 AS retracted, l_partkey % 7 <> 0 AS has_excerpt,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Reuters' END AS wire_service FROM lineitem)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges between documents: every third document cites the one a seventh of its id, others the next but four; some stay unresolved."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    cited = F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("doc_id") / 7)).when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 5)
    doi = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("10.1000/x"), (F.col("doc_id") % 40).cast("string"))).otherwise("")
    return d.select(F.col("doc_id").alias("citing"), cited.cast("bigint").alias("cited"), doi.alias("cited_doi"), (F.col("doc_id") % 4).cast("int").alias("depth")).where("cited is null or cited <> citing")


CITATIONS_SQL = """cit AS (SELECT * FROM (SELECT doc_id AS citing, (CASE WHEN doc_id % 3 = 0 THEN doc_id // 7 WHEN doc_id % 3 = 1 THEN doc_id + 5 END)::BIGINT AS cited,
  CASE WHEN doc_id % 3 = 2 THEN '10.1000/x' || (doc_id % 40) ELSE '' END AS cited_doi, (doc_id % 4)::INTEGER AS depth FROM documents) WHERE cited IS NULL OR cited <> citing)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and fetch log: events; an error event is a failed call, the user its provider, value what it spent."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("provider"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"))


CALLS_SQL = """calls AS (SELECT event_id AS call_id, ts, user_id AS provider, event_type AS kind, event_type <> 'error' AS ok, value AS amount,
  (props::JSON ->> '$.k')::INTEGER AS k FROM events)"""
