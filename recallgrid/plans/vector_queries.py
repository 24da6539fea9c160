"""Recall over the stand-in vector store."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import context, store, vectors

from . import standins as s
from .registry import query

_NEAR = f"""WITH {s.VECTORS}, q AS (SELECT embedding AS e FROM vectors WHERE vid = 'holo_fact_7'),
n AS (SELECT vid, text, type, seq, list_cosine_similarity(embedding, e) AS c FROM vectors CROSS JOIN q),
r AS (SELECT *, row_number() OVER (ORDER BY c DESC, vid) AS rank, round(c, 3) AS similarity FROM n)"""


def _probe(spark, sf, vid: str = "holo_fact_7"):
    """One vector as a literal: what a query's embedding is in use."""
    row = s.vectors(spark, sf).where(F.col("vid") == vid).select("embedding").first()
    return vectors.literal(row["embedding"] if row else [1.0])


@query(f"{_NEAR} SELECT vid, type, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def vector_top_k(spark, sf):
    return vectors.top_k(s.vectors(spark, sf), _probe(spark, sf), 20).select("vid", "type", "similarity", "rank")


_RECALL = f"""{_NEAR}, w AS (SELECT *, row_number() OVER (PARTITION BY substring(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 1, 160) ORDER BY rank) AS n FROM r WHERE rank <= 22 AND type NOT IN ('scratch', 'situation')),
t AS (SELECT * FROM w WHERE n = 1 ORDER BY rank LIMIT 10)
SELECT vid, text, type, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vid) AS INTEGER) AS rank FROM t WHERE similarity >= 0.1"""


@query(_RECALL)
def recall_topk(spark, sf):
    return vectors.recall(s.vectors(spark, sf), _probe(spark, sf), 10, 0.1, ("scratch", "situation"))


@query(f"{_NEAR} SELECT vid, similarity FROM (SELECT * FROM r WHERE rank <= 24 AND type = 'situation' AND similarity >= 0.1 ORDER BY rank LIMIT 2)")
def situation_matches(spark, sf):
    return vectors.situations(s.vectors(spark, sf), _probe(spark, sf), 0.1).select("vid", "similarity")


@query(f"""{_NEAR} SELECT count(*) AS n, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS deviation, count_if(c >= (SELECT avg(c) + 2 * stddev_pop(c) FROM n)) AS passed FROM n""")
def similarity_gate(spark, sf):
    c = s.vectors(spark, sf).select(vectors.cosine(F.col("embedding"), _probe(spark, sf)).alias("c"))
    t = c.agg(F.avg("c").alias("mu"), F.stddev_pop("c").alias("sd"))
    return c.join(F.broadcast(t), how="cross").agg(F.count("*").alias("n"), F.round(F.first("mu"), 9).alias("mean"), F.round(F.first("sd"), 9).alias("deviation"), F.count_if(F.col("c") >= F.col("mu") + 2 * F.col("sd")).alias("passed"))


@query(f"""WITH {s.VECTORS}, p AS (SELECT vid, list_transform(embedding, lambda x: x * 3) AS a FROM vectors), q AS (SELECT a AS b FROM p WHERE vid = 'holo_fact_7')
SELECT vid, round((list_sum(list_transform(list_zip(a, b), lambda z: cos(z[1] - z[2]))) / len(a) + 1) / 2, 6) AS similarity FROM p CROSS JOIN q""")
def phase_similarity(spark, sf):
    v = s.vectors(spark, sf).select("vid", F.transform("embedding", lambda x: x.cast("double") * 3).alias("a"))
    row = v.where("vid = 'holo_fact_7'").first()
    return v.select("vid", F.round(vectors.phase_similarity(F.col("a"), vectors.literal(row["a"])), 6).alias("similarity"))


@query("""WITH v AS (SELECT vec_id AS fact_id, vec_id % 400 AS k, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS a FROM embeddings), q AS (SELECT a AS b FROM v WHERE fact_id = 7),
n AS (SELECT fact_id, k, (list_sum(list_transform(list_zip(a, b), lambda z: cos(z[1] - z[2]))) / len(a) + 1) / 2 AS sim FROM v CROSS JOIN q),
g AS (SELECT greatest(0.5, avg(sim) + 0.5 * stddev_pop(sim)) AS gate FROM n),
l AS (SELECT * FROM n, g WHERE sim >= gate AND fact_id <> 7 AND fact_id % 11 <> 0 ORDER BY sim DESC, fact_id LIMIT 8),
f AS (SELECT fact_id, sim, k, CASE WHEN k >= 100 THEN 1 / 3 ELSE 0.5 END AS surface FROM l)
SELECT fact_id, round(sim, 3) AS score, round(surface, 3) AS surface, 'Item ' || k AS content FROM f WHERE surface <= 0.4 ORDER BY sim - surface DESC, fact_id LIMIT 1""")
def analogy(spark, sf):
    """Of the memories that stand out by structure the one that looks least like the question."""
    v = s.vectors(spark, sf).select(F.col("seq").alias("fact_id"), F.col("text").alias("content"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("phases"))
    probe = v.where("fact_id = 7").first()["phases"]
    skip = v.where("fact_id = 7 OR fact_id % 11 = 0").select("fact_id")
    return vectors.analogies(v, vectors.literal(probe), F.array(F.lit("item"), F.lit("alpha")), skip, z=0.5, surface_max=0.4)


@query(f"WITH {s.VECTORS}, w AS (SELECT len(embedding) AS w, count(*) AS n FROM vectors GROUP BY 1 ORDER BY n DESC, w LIMIT 1) SELECT vid FROM vectors, w WHERE len(embedding) = w.w")
def dominant_width(spark, sf):
    return vectors.dominant_width(s.vectors(spark, sf), "embedding").select("vid")


@query(f"""WITH {s.VECTORS}, log AS (SELECT vid, text, type, seq, false AS gone FROM vectors UNION ALL SELECT vid, 'new ' || text, type, seq + 1000000, seq % 7 = 0 FROM vectors WHERE seq % 3 = 0)
SELECT vid, text, type FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND NOT gone""")
def vector_upserts(spark, sf):
    v = s.vectors(spark, sf).select("vid", "text", "type", "seq", F.lit(False).alias("gone"))
    late = v.where("seq % 3 = 0").select("vid", F.concat(F.lit("new "), "text").alias("text"), "type", (F.col("seq") + 1_000_000).alias("seq"), (F.col("seq") % 7 == 0).alias("gone"))
    return store.latest(v.union(late), "vid", "gone").select("vid", "text", "type")


@query(f"""WITH {s.VECTORS}, have AS (SELECT vid FROM vectors UNION ALL SELECT 'situation_' || vid FROM vectors), want AS (SELECT vid FROM vectors WHERE seq % 5 <> 0)
SELECT vid FROM have WHERE NOT starts_with(vid, 'holo_fact_') OR vid IN (SELECT vid FROM want)""")
def prune_vectors(spark, sf):
    v = s.vectors(spark, sf)
    have = v.select("vid").union(v.select(F.concat(F.lit("situation_"), "vid")))
    return store.prune_vectors(have, v.where("seq % 5 <> 0"), ("holo_fact_",))


@query(f"""WITH {s.VECTORS}, said AS (SELECT lower(text) AS t FROM vectors WHERE seq < 5) SELECT vid FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM said WHERE contains(lower(v.text), t) OR contains(t, lower(v.text)))""")
def cross_block_dedupe(spark, sf):
    v = s.vectors(spark, sf)
    return context.drop_cross_block(v, v.where("seq < 5").select("text")).select("vid")
