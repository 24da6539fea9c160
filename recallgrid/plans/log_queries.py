"""Logs, trust, decisions, retention and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import calendar, consolidate, context, feedback, maintain, relations, store
from recallgrid.streaming import ingest

from . import standins as s
from .registry import query

_AS_OF = f"TIMESTAMP '{s.AS_OF}'"


@query(f"WITH {s.RECALL} SELECT block, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT fact_id) AS facts FROM recall_log WHERE ts >= {_AS_OF} - INTERVAL 14 DAYS GROUP BY block")
def recall_counts(spark, sf):
    return store.retain(s.recall_log(spark, sf), s.AS_OF, 14).groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("fact_id").alias("facts"))


@query(f"WITH {s.RECALL} SELECT id FROM recall_log WHERE ts >= {_AS_OF} - INTERVAL 20 DAYS")
def retention(spark, sf):
    return store.retain(s.recall_log(spark, sf), s.AS_OF, 20).select("id")


@query(f"""WITH {s.FACTS}, {s.RECALL}, b AS (SELECT fact_id, count(DISTINCT session_id || '|' || turn_number) AS bumps FROM recall_log WHERE fact_id IS NOT NULL GROUP BY 1)
SELECT fact_id, retrieval_count + coalesce(bumps, 0) AS retrieval_count FROM facts LEFT JOIN b USING (fact_id)""")
def bump_retrieval(spark, sf):
    shown = s.recall_log(spark, sf).select(F.concat_ws("|", "session_id", F.col("turn_number").cast("string")).alias("call"), "fact_id")
    return store.bump_retrieval(s.facts(spark, sf), shown).select("fact_id", "retrieval_count")


# facts for the feedback loop: item k is engaged when a later query of the session names it
_NAMED = "named AS (SELECT DISTINCT fact_id, CASE fact_id % 3 WHEN 0 THEN 'click item ' || fact_id WHEN 1 THEN 'item ' || fact_id || ' unseen' ELSE 'other' END AS name, 'plain words about nothing' AS content FROM recall_log WHERE fact_id IS NOT NULL)"
_ENGAGED = f"""WITH {s.RECALL}, {_NAMED}, w AS (SELECT * FROM recall_log WHERE ts >= {_AS_OF} - INTERVAL 14 DAYS),
g AS (SELECT a.id, a.fact_id, a.session_id, a.turn_number, a.ts >= {_AS_OF} - INTERVAL 1 DAYS AS recent,
  EXISTS (SELECT 1 FROM w b WHERE b.session_id = a.session_id AND b.id > a.id AND contains(lower(b.query), n.name)) AS engaged
  FROM w a JOIN named n ON n.fact_id = a.fact_id)"""


def _named(spark, sf):
    f = s.recall_log(spark, sf).where("fact_id IS NOT NULL").select("fact_id").distinct()
    key = F.col("fact_id").cast("string")
    name = F.when(F.col("fact_id") % 3 == 0, F.concat(F.lit("click item "), key)).when(F.col("fact_id") % 3 == 1, F.concat(F.lit("item "), key, F.lit(" unseen"))).otherwise("other")
    return f.withColumn("name", name).withColumn("content", F.lit("plain words about nothing")).withColumn("trust_score", F.when(F.col("fact_id") % 5 == 0, 0.845).when(F.col("fact_id") % 5 == 1, 0.36).when(F.col("fact_id") % 5 == 2, 0.0).otherwise(0.6))


@query(f"{_ENGAGED} SELECT id, fact_id, recent, engaged FROM g")
def engagement(spark, sf):
    f = _named(spark, sf)
    return feedback.engagement(s.recall_log(spark, sf), f, f.select("fact_id", "name"), s.AS_OF).select("id", "fact_id", "recent", "engaged")


_MOVES = f"""{_ENGAGED}, m AS (SELECT fact_id, bool_or(engaged AND recent) AS fresh, bool_or(engaged) AS ever, count(DISTINCT session_id || '|' || turn_number) AS turns FROM g GROUP BY fact_id),
d AS (SELECT fact_id, CASE WHEN fresh THEN 0.02 ELSE -0.02 END AS delta, CASE WHEN fresh THEN 'engaged' ELSE 'unengaged' END AS reason FROM m WHERE fresh OR (NOT ever AND turns >= 5)),
t AS (SELECT fact_id, delta, reason, CASE fact_id % 5 WHEN 0 THEN 0.845 WHEN 1 THEN 0.36 WHEN 2 THEN 0.5 ELSE 0.6 END AS old FROM d)
SELECT fact_id, CAST(old AS DOUBLE) AS old_trust, CAST(round(CASE WHEN delta > 0 THEN least(old + delta, 0.85) ELSE greatest(old + delta, 0.35) END, 4) AS DOUBLE) AS new_trust, reason FROM t
WHERE old <> round(CASE WHEN delta > 0 THEN least(old + delta, 0.85) ELSE greatest(old + delta, 0.35) END, 4)"""


@query(_MOVES)
def trust_feedback(spark, sf):
    f = _named(spark, sf)
    return feedback.feedback(s.recall_log(spark, sf), f, f.select("fact_id", "name"), s.AS_OF)


_LAST = "TIMESTAMP '1998-01-01 00:00:00'"


@query(f"""WITH {s.DECISIONS}, d AS (SELECT * FROM decisions WHERE ts >= {_LAST} - INTERVAL 900 DAYS)
SELECT coalesce(kind, 'recommendation') AS kind, count_if(outcome = 'accepted') AS accepted, count_if(outcome = 'modified') AS modified, count_if(outcome = 'rejected') AS rejected, count_if(outcome = 'pending') AS pending, count_if(outcome = 'ignored') AS ignored,
 round((count_if(outcome = 'accepted') + count_if(outcome = 'modified')) / nullif(count_if(outcome IN ('accepted', 'modified', 'rejected')), 0), 4) AS acceptance FROM d GROUP BY 1""")
def decision_acceptance(spark, sf):
    return feedback.acceptance(s.decisions(spark, sf), "1998-01-01 00:00:00", 900)


@query(f"WITH {s.DECISIONS} SELECT id, outcome FROM decisions WHERE outcome = 'rejected' ORDER BY id DESC LIMIT 15")
def latest_rejections(spark, sf):
    return feedback.latest_decisions(s.decisions(spark, sf), 15, "rejected").select("id", "outcome")


@query(f"WITH {s.DECISIONS} SELECT DISTINCT fact_id FROM decisions WHERE outcome IN ('accepted', 'modified') AND fact_id <> 0")
def decision_boosts(spark, sf):
    d = s.decisions(spark, sf).withColumn("refs", F.array("fact_id")).withColumn("trust_applied", F.lit(0))
    return feedback.decision_signals(d, "1998-01-01 00:00:00")[0]


@query(f"WITH {s.DECISIONS} SELECT id FROM decisions WHERE outcome = 'pending' AND ts < {_LAST} - INTERVAL 7 DAYS")
def stale_decisions(spark, sf):
    d = s.decisions(spark, sf).withColumn("refs", F.array("fact_id")).withColumn("trust_applied", F.lit(0))
    return feedback.decision_signals(d, "1998-01-01 00:00:00")[2]


@query(f"WITH {s.DECISIONS}, t AS (SELECT DISTINCT session_id, turn_number FROM decisions WHERE outcome IN ('accepted', 'modified', 'rejected')) SELECT session_id, count(*) AS turns FROM t GROUP BY 1")
def resolved_turns(spark, sf):
    d = s.decisions(spark, sf).withColumn("refs", F.array("fact_id")).withColumn("trust_applied", F.lit(0))
    return feedback.decision_signals(d, "1998-01-01 00:00:00")[1].groupBy("session_id").agg(F.count("*").alias("turns"))


@query(f"""WITH {s.DECISIONS}, p AS (SELECT session_id, max(id) AS id FROM decisions WHERE outcome = 'pending' GROUP BY 1)
SELECT d.id, CASE WHEN p.id IS NOT NULL AND CAST(d.session_id AS INTEGER) % 2 = 0 THEN 'accepted' ELSE outcome END AS outcome FROM decisions d LEFT JOIN p ON p.id = d.id""")
def resolve_decisions(spark, sf):
    d = s.decisions(spark, sf).withColumn("chosen", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    pending = d.where("outcome = 'pending'").select("session_id").distinct()
    r = pending.where("CAST(session_id AS INT) % 2 = 0").select("session_id", F.lit(None).cast("bigint").alias("decision_id"), F.lit("accepted").alias("outcome"), F.lit("a").alias("chosen"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("seq"))
    return feedback.fold_decisions(d, r).select("id", "outcome")


@query(f"""WITH {s.RECALL}, e AS (SELECT fact_id, session_id || ':' || id AS ref, id FROM recall_log WHERE fact_id IS NOT NULL)
SELECT fact_id, CASE fact_id % 2 WHEN 0 THEN arg_min(ref, id) ELSE 'set' END AS source_ref FROM e GROUP BY fact_id""")
def provenance(spark, sf):
    log = s.recall_log(spark, sf).where("fact_id IS NOT NULL")
    facts = log.select("fact_id").distinct().withColumn("source_ref", F.when(F.col("fact_id") % 2 == 1, "set").otherwise(""))
    stamps = log.select("fact_id", F.concat("session_id", F.lit(":"), F.col("id").cast("string")).alias("source_ref"), F.col("id").alias("seq"))
    return store.stamp_source(facts, stamps).select("fact_id", "source_ref")


@query("""WITH chunk AS (SELECT doc_id % 40 AS c, doc_id AS m FROM documents WHERE doc_id BETWEEN 40 AND 400), shown AS (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)
SELECT doc_id AS fact_id FROM shown WHERE doc_id NOT IN (SELECT m FROM chunk WHERE c IN (SELECT doc_id FROM shown))""")
def chunk_suppression(spark, sf):
    d = s.table(spark, sf, "documents").select("doc_id")
    members = d.where("doc_id BETWEEN 40 AND 400").select((F.col("doc_id") % 40).alias("chunk_fact_id"), F.col("doc_id").alias("member_fact_id"))
    return context.suppress_chunks(d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("fact_id")), members)


@query(f"WITH {s.FACTS}, m AS (SELECT fact_id % 40 AS c, fact_id AS m FROM facts WHERE fact_id BETWEEN 40 AND 400) SELECT c AS chunk_fact_id, m AS fact_id, category, trust_score FROM m JOIN facts ON fact_id = m WHERE c = 4")
def chunk_expand(spark, sf):
    f = s.facts(spark, sf)
    members = f.where("fact_id BETWEEN 40 AND 400").select((F.col("fact_id") % 40).alias("chunk_fact_id"), F.col("fact_id").alias("member_fact_id"))
    return consolidate.expand_chunk(members, f, 4).select("chunk_fact_id", "fact_id", "category", "trust_score")


@query("""SELECT o_orderkey AS fact_id FROM orders WHERE o_orderstatus <> 'chunk' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 7 DAYS AND o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 10 <> 0""")
def eligible_facts(spark, sf):
    o = s.table(spark, sf, "orders")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("category"), F.col("o_orderdate").alias("created_at"))
    members = o.where("o_orderkey % 9 = 0").select((F.col("o_orderkey") * 0 - 1).alias("chunk_fact_id"), F.col("o_orderkey").alias("member_fact_id")).union(o.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit(-2).cast("bigint")))
    return consolidate.eligible(facts, members, "1998-01-01 00:00:00").select("fact_id")


@query("""WITH d AS (SELECT CASE WHEN page_id % 5 = 0 THEN substring(sha256(html), 1, 16) ELSE CAST(page_id AS VARCHAR) END AS id, html FROM pages)
SELECT id FROM (SELECT DISTINCT id, html FROM d) WHERE length(trim(html)) >= 20 AND id NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 7 = 1)""")
def document_gate(spark, sf):
    p = s.table(spark, sf, "pages")
    docs = p.select(F.when(F.col("page_id") % 5 != 0, F.col("page_id").cast("string")).alias("id"), F.lit("web").alias("source"), F.col("html").alias("text"))
    return ingest.gate(docs, p.where("page_id % 7 = 1").select(F.col("page_id").cast("string").alias("id")))[0].select("id")


@query(f"WITH {s.FACTS} SELECT fact_id FROM facts WHERE trim(content) <> '' AND fact_id % 3 <> 0 ORDER BY fact_id LIMIT 25")
def mining_batch(spark, sf):
    f = s.facts(spark, sf)
    return maintain.unprocessed(f, f.where("fact_id % 3 = 0")).select("fact_id")


@query(f"WITH {s.FACTS} SELECT fact_id, CASE WHEN fact_id % 4 = 0 THEN 'gist ' || fact_id ELSE substring(content, 1, 120) END AS gist FROM facts")
def gist_fallback(spark, sf):
    f = s.facts(spark, sf)
    found = f.where("fact_id % 4 = 0").select("fact_id", F.concat(F.lit("gist "), F.col("fact_id").cast("string")).alias("gist"))
    return maintain.gists(f, found)


@query(f"WITH {s.FACTS} SELECT fact_id FROM facts WHERE fact_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)")
def missing_vectors(spark, sf):
    return maintain.missing_vectors(s.facts(spark, sf), s.vectors(spark, sf).where("seq % 3 <> 0")).select("fact_id")


@query(f"""WITH {s.FACTS}, {s.VECTORS} SELECT vid, coalesce(category, v.type) AS type FROM vectors v LEFT JOIN facts ON 'holo_fact_' || fact_id = vid""")
def vector_types(spark, sf):
    return consolidate.refresh_types(s.vectors(spark, sf), s.facts(spark, sf)).select("vid", "type")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return ingest.event_windows(s.table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, sf):
    return ingest.sessions(s.table(spark, sf, "events"))


@query("""WITH e AS (SELECT 'e' || event_id AS id, event_type || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS name, ts FROM events WHERE event_id < 300),
n AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'old name ' || event_id ELSE event_type || ' (' || strftime(ts, '%Y-%m-%d') || ')' END AS name, 'e' || event_id AS id, strftime(ts, '%Y-%m-%d') AS start FROM events WHERE event_id < 330)
SELECT n.name FROM n LEFT JOIN e ON e.id = n.id WHERE n.start >= '2024-01-01' AND (e.name IS NULL OR e.name <> n.name)""")
def stale_events(spark, sf):
    e = s.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    one = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit("confirmed").alias("status"), F.col("event_type").alias("summary"), day.alias("start"), "event_id")
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("old name "), F.col("event_id").cast("string"))).otherwise(text.event_name(F.col("summary"), F.col("start")))
    nodes = one.where("event_id < 330").select(name.alias("name"), F.lit("personal").alias("cal"), F.col("id").alias("event_id"), "start")
    return calendar.stale(nodes, one.where("event_id < 300").drop("event_id"), "2024-01-01")


@query("SELECT id, event_id FROM (SELECT event_id AS id, event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-17 23:59:59')")
def calendar_window(spark, sf):
    e = s.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"))
    return calendar.window(e, "2024-01-15", 1, 2).select("id", "event_id")


@query("""WITH f AS (SELECT doc_id, substring(text, 1, 60) AS c FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS n, min(doc_id) AS first FROM f WHERE length(c) BETWEEN 8 AND 400""")
def extracted_facts(spark, sf):
    docs = s.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("spool").alias("source"), "text")

    def extractor(body: str, source: str) -> list[dict]:
        return [{"kind": "fact", "content": body[:60], "category": source}]

    lines = ingest.extract(docs.where("CAST(id AS INT) % 2 = 0"), extractor)
    return lines.agg(F.count("*").alias("n"), F.min(F.col("doc").cast("bigint")).alias("first"))


@query(f"WITH {s.FACTS} SELECT coalesce(category, 'general') AS bank, count(*) AS facts FROM facts GROUP BY 1")
def bank_counts(spark, sf):
    return maintain.bank_counts(s.facts(spark, sf))


@query("SELECT count(*) AS n, max(o_orderkey) AS last_id, max(o_orderdate) AS last_change FROM orders")
def change_key(spark, sf):
    return maintain.change_key(s.table(spark, sf, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("updated_at")))


#: Thirteen titles, and three words that are none.
_TITLES = ["Analyst", "architect", "Consultant", "Designer", "DEVELOPER", "Director", "engineer", "Intern", "Lead", "Manager", "Recruiter", "Scientist", "Technician", "Specialist", "Leader", "Internal"]


@query(f"""WITH t AS (SELECT {_TITLES} AS titles), n AS (SELECT 'n' || c_custkey || ' ' || titles[c_custkey % 16 + 1] || ' x' AS name, CASE c_custkey % 3 WHEN 0 THEN 'person' ELSE 'idea' END AS type, c_custkey FROM customer, t)
SELECT name FROM n WHERE type = 'idea' AND (c_custkey % 6 = 1 OR c_custkey % 16 < 13)""")
def job_nodes(spark, sf):
    name = F.concat(F.lit("n"), F.col("c_custkey").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("c_custkey") % 16 + 1).cast("int")), F.lit(" x"))
    c = s.table(spark, sf, "customer").select(name.alias("name"), F.when(F.col("c_custkey") % 3 == 0, "person").otherwise("idea").alias("type"), "c_custkey")
    edges = c.where("c_custkey % 6 = 1").select(F.col("name").alias("src"), F.lit("APPLIED_TO").alias("rel"), F.lit("Acme").alias("dst"))
    return maintain.job_nodes(c, edges)


@query(f"""WITH {s.FACTS} SELECT 'holo_fact_' || fact_id AS vid, category AS type, CAST(length(content) AS DOUBLE) AS first FROM facts WHERE trim(content) <> '' AND fact_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)""")
def new_vectors(spark, sf):
    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), 1.0] for t in texts]

    rows = maintain.vectorize(s.facts(spark, sf), s.vectors(spark, sf).where("seq % 3 <> 0"), embed, 1)
    return rows.select("vid", "type", F.col("embedding")[0].cast("double").alias("first"))


@query("""WITH e AS (SELECT 'Ann ' || (event_id % 50) AS a, 'Acme ' || (user_id % 20) AS b FROM events WHERE event_id < 400)
SELECT b AS src, 'OWNS' AS rel, a AS dst, 'owned by' AS rel_orig, count(*) AS n FROM e GROUP BY a, b""")
def canonical_edges(spark, sf):
    e = s.table(spark, sf, "events").where("event_id < 400")
    a, b = F.concat(F.lit("Ann "), (F.col("event_id") % 50).cast("string")), F.concat(F.lit("Acme "), (F.col("user_id") % 20).cast("string"))
    edges = e.select(a.alias("src"), F.lit("owned by").alias("rel"), b.alias("dst"), F.lit("doc:1").alias("source_ref"))
    return relations.canonical_edges(edges).groupBy("src", "rel", "dst", "rel_orig").agg(F.count("*").alias("n"))
