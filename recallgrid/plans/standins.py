"""The benchmark tables read as a memory store, in Spark and as common table expressions for the SQL side.

facts: documents with a trust from labels, every thirtieth of them a call transcript. Graph: customers and suppliers in nations, nations in regions,
suppliers offering parts. Recall log: events. Decisions: orders. Entities of facts: parts of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    q = table(spark, sf, "labels").select("doc_id", "quality")
    trust = F.when(F.col("quality") == 1, 0.7).when(F.col("quality") == 0, 0.3).otherwise(0.5)
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("fact_id"), F.when(F.col("doc_id") % 30 == 0, F.concat(F.lit("Voice call just ended. "), "text")).otherwise(F.col("text")).alias("content"), F.col("source").alias("category"), trust.alias("trust_score"), (F.col("doc_id") % 3).alias("helpful_count"), (F.col("doc_id") % 5).alias("retrieval_count"))


FACTS = """facts AS (SELECT doc_id AS fact_id, CASE doc_id % 30 WHEN 0 THEN 'Voice call just ended. ' || text ELSE text END AS content, source AS category,
  CAST(CASE quality WHEN 1 THEN 0.7 WHEN 0 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS trust_score, doc_id % 3 AS helpful_count, doc_id % 5 AS retrieval_count
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, rel, dst, src_tag, seq): seq orders the assertions; a supplier asserts OFFERS once a line."""
    c, s, n = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    l = table(spark, sf, "lineitem")
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    tag = lambda key: F.when(F.col(key) % 50 == 7, "proposed").when(F.col(key) % 50 == 11, "rejected").when(F.col(key) % 50 == 13, None).otherwise("etl")
    rows = [
        c.select(name("customer", "c_custkey").alias("src"), F.lit("LOCATED_IN").alias("rel"), name("nation", "c_nationkey").alias("dst"), tag("c_custkey").alias("src_tag"), F.col("c_custkey").alias("seq")),
        s.select(name("supplier", "s_suppkey"), F.lit("LOCATED_IN"), name("nation", "s_nationkey"), tag("s_suppkey"), F.col("s_suppkey") + 10_000_000_000),
        n.select(name("nation", "n_nationkey"), F.lit("PART_OF"), name("region", "n_regionkey"), F.lit("etl"), F.col("n_nationkey").cast("long") + 20_000_000_000),
        l.select(name("supplier", "l_suppkey"), F.when(F.col("l_returnflag") == "R", "SUPPLIES").otherwise("OFFERS"), name("part", "l_partkey"), tag("l_partkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber") + 30_000_000_000),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def _tag(key: str) -> str:
    return f"CASE {key} % 50 WHEN 7 THEN 'proposed' WHEN 11 THEN 'rejected' WHEN 13 THEN NULL ELSE 'etl' END"


EDGES = f"""edges AS (
  SELECT 'customer:' || c_custkey AS src, 'LOCATED_IN' AS rel, 'nation:' || c_nationkey AS dst, {_tag('c_custkey')} AS src_tag, c_custkey AS seq FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey, {_tag('s_suppkey')}, s_suppkey + 10000000000 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey, 'etl', n_nationkey + 20000000000 FROM nation
  UNION ALL SELECT 'supplier:' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'SUPPLIES' ELSE 'OFFERS' END, 'part:' || l_partkey, {_tag('l_partkey')}, l_orderkey * 8 + l_linenumber + 30000000000 FROM lineitem)"""


def small_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the graph without parts, and only suppliers and customers below a fixed share: it stays legible and connected."""
    return edges(spark, sf).where("rel IN ('LOCATED_IN', 'PART_OF')")


SMALL_EDGES = EDGES + ", small AS (SELECT * FROM edges WHERE rel IN ('LOCATED_IN', 'PART_OF'))"


def recall_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    fact = F.get_json_object("props", "$.k").try_cast("bigint")
    query = F.concat_ws(" ", F.col("event_type"), F.lit("item"), fact.cast("string"))
    return e.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), (F.floor(F.col("event_id") / 3)).alias("turn_number"), query.alias("query"), F.col("event_type").alias("block"), fact.alias("fact_id"), F.col("value").alias("score"))


RECALL = """recall_log AS (SELECT event_id AS id, ts, 's' || user_id AS session_id, event_id // 3 AS turn_number,
  concat_ws(' ', event_type, 'item', json_extract_string(props, '$.k')) AS query, event_type AS block,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS fact_id, value AS score FROM events)"""


def fact_entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("entity_id")).distinct()


FACT_ENTITIES = "fact_entities AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS entity_id FROM lineitem)"


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderkey") % 4 == 0, "modified").otherwise("pending")
    kind = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 97).cast("string").alias("session_id"), (F.col("o_orderkey") % 7).alias("turn_number"), kind.alias("kind"), outcome.alias("outcome"), (F.col("o_orderkey") % 100).alias("fact_id"))


DECISIONS = """decisions AS (SELECT o_orderkey AS id, o_orderdate AS ts, CAST(o_custkey % 97 AS VARCHAR) AS session_id, o_orderkey % 7 AS turn_number,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderkey % 4 = 0 THEN 'modified' ELSE 'pending' END AS outcome,
  o_orderkey % 100 AS fact_id FROM orders)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vid, text, type, embedding, seq) of the vector store."""
    e = table(spark, sf, "embeddings")
    kind = F.when(F.col("label") == 3, "situation").when(F.col("label") == 5, "scratch").otherwise("fact")
    return e.select(F.concat(F.lit("holo_fact_"), F.col("vec_id").cast("string")).alias("vid"), F.concat(F.lit("Item "), (F.col("vec_id") % 400).cast("string")).alias("text"), kind.alias("type"), F.col("embedding"), F.col("vec_id").alias("seq"))


VECTORS = """vectors AS (SELECT 'holo_fact_' || vec_id AS vid, 'Item ' || (vec_id % 400) AS text,
  CASE label WHEN 3 THEN 'situation' WHEN 5 THEN 'scratch' ELSE 'fact' END AS type, CAST(embedding AS DOUBLE[]) AS embedding, vec_id AS seq FROM embeddings)"""
