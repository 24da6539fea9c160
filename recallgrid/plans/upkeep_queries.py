"""Upkeep, review, ingestion and the parts of a turn's context, over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import calendar, consolidate, context, feedback, graph, maintain, resolve, review, snapshot, store, vectors
from recallgrid.streaming import ingest

from . import standins as s
from .graph_queries import _SMALL, _TAGGED, _TYPES, _small, _typed, _visible
from .registry import query


def _name(kind: str, key):
    return F.concat(F.lit(kind), key.cast("string"))


# schema, counts, defaults


@query("SELECT 'region' AS \"table\", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def store_counts(spark, sf):
    return snapshot.counts({n: s.table(spark, sf, n) for n in ("region", "nation", "orders")})


@query("SELECT n_nationkey, n_name, '' AS source_ref, CAST(0.5 AS DOUBLE) AS trust FROM nation")
def evolved_schema(spark, sf):
    """Columns that an older table lacks come with their defaults; those that exist stay."""
    return store.with_defaults(s.table(spark, sf, "nation").select("n_nationkey", "n_name"), {"n_name": F.lit("lost"), "source_ref": F.lit(""), "trust": F.lit(0.5)})


@query("SELECT o_orderkey AS k, printf('%.1f', CAST(o_orderkey % 7 AS DOUBLE) + 0.24) AS one, printf('%.2f', CAST(o_orderkey % 7 AS DOUBLE) + 0.126) AS two FROM orders")
def fixed_numbers(spark, sf):
    v = (F.col("o_orderkey") % 7).cast("double")
    return s.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.fixed(v + 0.24, 1).alias("one"), text.fixed(v + 0.126, 2).alias("two"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'a''b ' || c_custkey || ' [c] ''d' WHEN 1 THEN 'plain ' || c_custkey ELSE 'x <y> ' || c_custkey END AS label FROM customer""")
def safe_labels(spark, sf):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('a"b '), key, F.lit(' [c] "d'))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("plain "), key)).otherwise(F.concat(F.lit("x <y> "), key))
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.safe_label(raw).alias("label"))


@query("""SELECT c_custkey AS k, rtrim(substring('Dr Long Name of Customer ' || c_custkey || ' of the Society', 1, 40)) AS name FROM customer""")
def display_names(spark, sf):
    raw = F.concat(F.lit("  'Dr   Long Name of\tCustomer "), F.col("c_custkey").cast("string"), F.lit(" of the Society;. "))
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.display_name(raw).alias("name"))


@query("""SELECT event_id, '{"k":"' || (event_id % 5) || '","side":"right"' || CASE event_id % 2 WHEN 0 THEN ',"left":"1"' ELSE '' END || '}' AS merged FROM events WHERE event_id < 200""")
def merged_maps(spark, sf):
    """Two attribute maps as one; where both have a key the winner's value stays."""
    e = s.table(spark, sf, "events").where("event_id < 200")
    winner = F.create_map(F.lit("k"), (F.col("event_id") % 5).cast("string"), F.lit("side"), F.lit("right"))
    none = F.create_map().cast("map<string,string>")
    loser = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("side"), F.lit("wrong"), F.lit("left"), F.lit("1"))).otherwise(none)
    return e.select("event_id", F.to_json(store.merge_attrs(winner, loser)).alias("merged"))


# names


@query("""SELECT c_custkey AS k, 'Ann Lee ' || c_custkey || '|Prague|see Rome|visits' AS names FROM customer""")
def entity_candidates(spark, sf):
    """A leading preposition or verb comes off, repeats, line breaks, long spans and lower-case phrases go."""
    own = F.concat(F.lit("Ann  Lee "), F.col("c_custkey").cast("string"))
    raw = F.array(own, F.lit("from Prague"), F.lit("PRAGUE"), F.lit("a\nb"), F.lit("see Rome"), F.lit("one of the many phrases"), F.lit("x" * 61), F.lit(None), F.upper(own), F.lit("visits"))
    return store.spread(s.table(spark, sf, "customer").select("c_custkey")).select(F.col("c_custkey").alias("k"), F.array_join(text.tidy_entities(raw), "|").alias("names"))


_PLACES = "VALUES ('prague', 'Prague'), ('chicago', 'Chicago City'), ('rome', 'Rome')"


@query("""SELECT c_custkey AS fact_id, 'Ann Lee' || CASE c_custkey % 4 WHEN 0 THEN '|Prague' WHEN 1 THEN '|Chicago City' ELSE '' END AS names FROM customer""")
def known_entities(spark, sf):
    """Candidates and, after them, capitalised words that the alias map knows."""
    key = F.col("c_custkey")
    said = F.when(key % 4 == 0, "Ann Lee flew to (Prague), from prague.").when(key % 4 == 1, "Ann Lee likes Chicago! Chicago?").when(key % 4 == 2, "rome and Oslo").otherwise("Oslo, ann lee")
    docs = s.table(spark, sf, "customer").select(key.alias("fact_id"), said.alias("content"), F.array(F.lit("Ann Lee"), F.lit("ann lee")).alias("names"))
    aliases = spark.createDataFrame([("prague", "Prague"), ("chicago", "Chicago City"), ("rome", "Rome")], "alias string, canonical string")
    return resolve.known_entities(docs, aliases).select("fact_id", F.array_join("names", "|").alias("names"))


@query("""WITH k AS (SELECT 'norm:unit ' || (event_id % 40) AS key, 'Unit ' || (event_id % 40) || ' v' || event_id AS canonical, event_id AS seq FROM events WHERE event_id < 400),
l AS (SELECT key, arg_max(canonical, seq) AS canonical FROM k GROUP BY key) SELECT substring(key, 6) AS alias, CASE key WHEN 'norm:unit 3' THEN 'Curated' ELSE canonical END AS canonical FROM l
UNION ALL SELECT 'my unit', 'Unit 5'""")
def alias_index(spark, sf):
    """The last meaning of every name key, with variants that a person added."""
    e = s.table(spark, sf, "events").where("event_id < 400")
    n = F.concat(F.lit("unit "), (F.col("event_id") % 40).cast("string"))
    keys = e.select(F.concat(F.lit("norm:"), n).alias("key"), F.concat(F.initcap(n), F.lit(" v"), F.col("event_id").cast("string")).alias("canonical"), F.col("event_id").alias("seq"))
    more = e.where("event_id < 5").select(F.concat(F.lit("email:a"), F.col("event_id").cast("string")).alias("key"), F.lit("nobody").alias("canonical"), F.col("event_id").alias("seq"))
    current = resolve.alias_map(keys.union(more)).select(F.concat(F.lit("norm:"), "alias").alias("key"), "canonical")
    return resolve.alias_map(resolve.add_alias(resolve.add_alias(current, "The Unit 3", "Curated"), "My Unit, Inc.", "Unit 5"))


@query("""SELECT s_suppkey AS entity_id, 'E' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'org' ELSE 'person' END AS entity_type FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 < 2""")
def entity_types(spark, sf):
    """Entities of unknown type take that of the node they stand for, or of the node of their own name."""
    key = F.col("s_suppkey")
    base = s.table(spark, sf, "supplier")
    kind = F.when(key % 5 == 0, "thing").when(key % 2 == 0, "unknown")
    entities = base.select(key.alias("entity_id"), _name("E", key).alias("name"), kind.alias("entity_type"))
    aliases = base.where("s_suppkey % 4 = 0").select(F.lower(_name("E", key)).alias("alias"), _name("Firm ", key).alias("canonical"))
    nodes = base.where("s_suppkey % 4 = 0").select(_name("FIRM ", key).alias("name"), F.lit("org").alias("type")).union(base.where("s_suppkey % 4 = 1").select(_name("e", key), F.lit("person"))).union(base.where("s_suppkey % 4 = 2").select(_name("e", key), F.lit(None).cast("string")))
    return resolve.entity_types(entities, nodes, aliases)


# consolidation


_CLUSTER = "c AS (SELECT CAST(o_orderkey % 7 AS VARCHAR) AS signature, o_orderkey AS fact_id FROM orders WHERE o_orderkey < 400)"


def _clusters(spark, sf):
    o = s.table(spark, sf, "orders").where("o_orderkey < 400")
    return o.groupBy((F.col("o_orderkey") % 7).cast("string").alias("signature")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"))


@query(f"""WITH {_CLUSTER}, {s.FACT_ENTITIES}, n AS (SELECT signature, 'part ' || (entity_id % 20) AS name, count(*) AS n FROM c JOIN fact_entities USING (fact_id) GROUP BY ALL)
SELECT signature, name, n FROM n QUALIFY row_number() OVER (PARTITION BY signature ORDER BY n DESC, name) <= 6""")
def cluster_entities(spark, sf):
    links = s.fact_entities(spark, sf)
    entities = links.select("entity_id").distinct().withColumn("name", _name("part ", F.col("entity_id") % 20))
    return consolidate.cluster_entities(_clusters(spark, sf), links, entities)


@query(f"WITH {_CLUSTER} SELECT signature, count(*) AS n FROM c GROUP BY signature ORDER BY n DESC, signature LIMIT 6")
def clusters_due(spark, sf):
    return maintain.clusters_due(_clusters(spark, sf)).select("signature", F.size("members").cast("bigint").alias("n"))


@query(f"""WITH {_CLUSTER}, n AS (SELECT signature, row_number() OVER (ORDER BY signature) + 100 AS id FROM (SELECT DISTINCT signature FROM c))
SELECT 'fact' AS kind, id, 'chunk,sig:' || signature AS a, 'sum ' || signature AS b FROM n UNION ALL SELECT 'member', id, CAST(fact_id AS VARCHAR), NULL FROM n JOIN c USING (signature)
UNION ALL SELECT 'node', id, 'Title ' || signature, 'episode' FROM n UNION ALL SELECT 'edge', NULL, 'Title ' || signature, 'INVOLVES Ann chunk' FROM n""")
def chunk_rows(spark, sf):
    """A chunk is a fact, its members, a node and edges to the entities."""
    named = _clusters(spark, sf).select("signature", "members", F.concat(F.lit("Title "), "signature").alias("title"), F.concat(F.lit("sum "), "signature").alias("summary"), F.array(F.lit("Ann")).alias("names"))
    rows = consolidate.write_chunk_rows(named, 100)
    out = rows["facts"].select(F.lit("fact").alias("kind"), F.col("fact_id").cast("bigint").alias("id"), F.col("tags").alias("a"), F.col("content").alias("b"))
    out = out.union(rows["chunk_members"].select(F.lit("member"), F.col("chunk_fact_id").cast("bigint"), F.col("member_fact_id").cast("string"), F.lit(None).cast("string")))
    out = out.union(rows["nodes"].select(F.lit("node"), F.get_json_object("attrs", "$.chunk_fact_id").cast("bigint"), "name", "type"))
    return out.union(rows["edges"].select(F.lit("edge"), F.lit(None).cast("bigint"), "src", F.concat_ws(" ", "rel", "dst", "src_tag")))


@query(f"WITH {s.FACTS} SELECT vec_id AS fact_id, 'g' || vec_id AS gist FROM embeddings WHERE vec_id IN (SELECT fact_id FROM facts WHERE fact_id % 4 <> 0)")
def live_gists(spark, sf):
    """Gists of facts that are gone go too."""
    gists = s.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact_id"), _name("g", F.col("vec_id")).alias("gist"))
    return consolidate.dead_gists(gists, s.facts(spark, sf).where("fact_id % 4 <> 0"))


@query("""WITH g AS (SELECT 'kind ' || (s_suppkey % 3) AS name, s_suppkey AS k FROM supplier)
SELECT 'n:' || k AS src, 'INSTANCE_OF' AS rel, name AS dst, CASE name WHEN 'kind 0' THEN 'curated' WHEN 'kind 1' THEN 'rejected' ELSE 'proposed' END AS src_tag FROM g
UNION ALL SELECT name, 'type', 'category', min('consolidation') FROM g GROUP BY name""")
def category_review(spark, sf):
    """Proposals become edges and nodes; decisions on them are events, and a rejection holds."""
    base = s.table(spark, sf, "supplier").select(_name("n:", F.col("s_suppkey")).alias("member"), _name("kind ", F.col("s_suppkey") % 3).alias("name"))
    groups = base.groupBy("name").agg(F.collect_list("member").alias("members"))
    e = review.propose(groups, 1)
    events = review.category_events(e, "kind 0", "curated").withColumn("seq", F.lit(2)).union(review.category_events(e, "kind 1", "rejected").withColumn("seq", F.lit(3)))
    late = e.where("dst = 'kind 1'").select("src", "rel", "dst", F.lit("curated").alias("tag"), F.lit(4).alias("seq"))
    reviewed = store.retag(store.retag(e, events), late)
    nodes = review.category_nodes(groups, 1).select(F.col("name").alias("src"), F.lit("type").alias("rel"), F.col("type").alias("dst"), F.get_json_object("attrs", "$.proposed_by").alias("src_tag"))
    return reviewed.select("src", "rel", "dst", "src_tag").union(nodes)


_MERGED = """m(name, now) AS (VALUES ('supplier:1', 'supplier:0'), ('supplier:2', 'supplier:0'), ('nation:1', 'nation:2'))"""


@query(f"""WITH {_TAGGED}, {_MERGED}, x AS (SELECT coalesce(a.now, src) AS src, rel, coalesce(b.now, dst) AS dst, a.now IS NOT NULL OR b.now IS NOT NULL AS moved, seq FROM vis LEFT JOIN m a ON a.name = src LEFT JOIN m b ON b.name = dst)
SELECT src, rel, dst, seq FROM x WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, rel, dst ORDER BY moved, seq) = 1""")
def reviewed_edges(spark, sf):
    """Edges after approved aliases: 1 goes into 2 and 2 into 0, whatever came first."""
    to = store.merged_names([("supplier:2", "supplier:0", 2), ("supplier:1", "supplier:2", 1), ("nation:1", "nation:2", 3)])
    return store.apply_merges(_visible(spark, sf), spark.createDataFrame(list(to.items()), "name string, now string")).select("src", "rel", "dst", "seq")


@query("""WITH k AS (SELECT s_suppkey // 2 * 2 AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT 'n' || k AS name, CASE WHEN k % 4 = 0 THEN 'org' WHEN n = 2 THEN 'lent' ELSE 'concept' END AS type,
CASE WHEN n = 2 THEN '{"both":"winner","own":"' || k || '","lost":"' || (k + 1) || '"}' ELSE '{"both":"winner","own":"' || k || '"}' END AS attrs FROM k""")
def reviewed_nodes(spark, sf):
    """Odd nodes go into the even ones before: the winner's attributes and type stay, unless its type says nothing."""
    key = F.col("s_suppkey")
    even = key % 2 == 0
    kind = F.when(even & (key % 4 == 0), "org").when(even, "concept").otherwise("lent")
    attrs = F.when(even, F.concat(F.lit('{"both":"winner","own":"'), key.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"both":"loser","lost":"'), key.cast("string"), F.lit('"}')))
    nodes = s.table(spark, sf, "supplier").select(_name("n", key).alias("name"), kind.alias("type"), attrs.alias("attrs"))
    merges = s.table(spark, sf, "supplier").where("s_suppkey % 2 = 1").select(_name("n", key).alias("name"), _name("n", key - 1).alias("now"))
    return store.apply_node_merges(nodes, merges)


@query("""WITH p AS (SELECT 'a' || s_suppkey AS src, 'b' || s_suppkey AS dst, s_suppkey AS k FROM supplier)
SELECT src, dst, CASE WHEN k = 2 OR k = 3 THEN 'rejected' ELSE 'alias-candidate' END AS src_tag FROM p""")
def alias_review(spark, sf):
    """A pair is rejected from either side and stays in the table, so that it is not proposed again."""
    key = F.col("s_suppkey")
    e = s.table(spark, sf, "supplier").select(_name("a", key).alias("src"), F.lit("POSSIBLE_ALIAS").alias("rel"), _name("b", key).alias("dst"), F.lit("alias-candidate").alias("src_tag"), key.alias("seq"))
    events = review.alias_events(e, "a2", "b2").union(review.alias_events(e, "b3", "a3")).withColumn("seq", F.lit(9))
    return store.retag(e, events).select("src", "dst", "src_tag")


@query("SELECT 'alias: a' || s_suppkey || ' = b' || s_suppkey AS line FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'category: kind <- ' || string_agg('m' || s_suppkey, ', ' ORDER BY 'm' || s_suppkey) FROM supplier WHERE s_suppkey % 2 = 1")
def review_lines(spark, sf):
    key = F.col("s_suppkey")
    base = s.table(spark, sf, "supplier")
    e = base.where("s_suppkey % 2 = 0").select(_name("a", key).alias("src"), F.lit("POSSIBLE_ALIAS").alias("rel"), _name("b", key).alias("dst"), F.lit("alias-candidate").alias("src_tag"))
    e = e.union(base.where("s_suppkey % 2 = 1").select(_name("m", key), F.lit("INSTANCE_OF"), F.lit("kind"), F.lit("proposed")))
    return review.summary(e)


# context of a turn


@query("""WITH n AS (SELECT 'Item ' || event_id AS name, event_id AS seq FROM events WHERE event_id < 200), a AS (SELECT 'thing ' || event_id AS alias, 'Item ' || event_id AS canonical, event_id AS seq FROM events WHERE event_id < 200),
q AS (SELECT 'has item 12, thing 150 and thing 7 or ITEM 31' AS q), f AS (SELECT name, 0 AS kind, seq FROM n, q WHERE length(name) >= 4 AND contains(lower(q), lower(name)) UNION ALL SELECT canonical, 1, seq FROM a, q WHERE contains(lower(q), alias))
SELECT name FROM (SELECT name, min(kind * 1000000 + seq) AS o FROM f GROUP BY name) ORDER BY o, name LIMIT 5""")
def mentioned_nodes(spark, sf):
    """Nodes that a question names, by their entry; those that it names by an alias come after."""
    e = s.table(spark, sf, "events").where("event_id < 200")
    nodes = e.select(_name("Item ", F.col("event_id")).alias("name"), F.col("event_id").alias("seq"))
    aliases = e.select(_name("thing ", F.col("event_id")).alias("alias"), _name("Item ", F.col("event_id")).alias("canonical"), F.col("event_id").alias("seq"))
    return context.mentioned_nodes(nodes, aliases, "Has item 12, thing 150 and thing 7 or ITEM 31", 5)


@query(f"""WITH {_SMALL}, f AS (SELECT 'nation:2' AS start, b AS node FROM both_ WHERE a = 'nation:2' UNION ALL SELECT 'nation:3', b FROM both_ WHERE a = 'nation:3'),
r AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY node) AS rank FROM f), k AS (SELECT * FROM r WHERE rank <= 6 ORDER BY start, rank LIMIT 10)
SELECT start, CAST(rank AS INTEGER) AS rank, '- ' || v.src || ' ' || v.rel || ' ' || v.dst AS line FROM k JOIN vis v ON (v.src = start AND v.dst = node) OR (v.dst = start AND v.src = node)""")
def neighbour_lines(spark, sf):
    start = spark.createDataFrame([("nation:2",), ("nation:3",)], "start string")
    return context.neighbour_lines(graph.neighbours(_small(spark, sf), start))


@query("""WITH b AS (SELECT c_custkey % 5 AS block, c_custkey // 5 AS line, '- text ' || c_custkey AS text, 'e' || c_custkey AS entry_id, false AS header FROM customer WHERE c_custkey BETWEEN 5 AND 60),
h AS (SELECT DISTINCT block, 0 AS line, '## T' || block AS text, CAST(NULL AS VARCHAR) AS entry_id, true AS header FROM b),
u AS (SELECT *, sum(length(text) + 1) OVER (ORDER BY block, line) AS used FROM (SELECT * FROM b UNION ALL SELECT * FROM h)),
k AS (SELECT *, sum(CASE WHEN header THEN 0 ELSE 1 END) OVER (PARTITION BY block) AS body FROM u WHERE used <= 400)
SELECT CAST(block AS INTEGER) AS block, CAST(line AS INTEGER) AS line, text, entry_id FROM k WHERE body > 0""")
def prefetch_blocks(spark, sf):
    """Five blocks in order under a budget of characters; the first line that does not fit ends the context."""
    c = s.table(spark, sf, "customer").where("c_custkey BETWEEN 5 AND 60")
    key = F.col("c_custkey")
    blocks = [(f"T{k}", c.where(key % 5 == k).select(F.floor(key / 5).alias("rank"), _name("text ", key).alias("text"), _name("e", key).alias("entry_id"))) for k in range(5)]
    return context.prefetch_lines(blocks, 400).select("block", "line", "text", "entry_id")


@query(f"""WITH {s.RECALL}, a AS (SELECT fact_id FROM recall_log WHERE block = 'click' AND fact_id IS NOT NULL ORDER BY id DESC LIMIT 20) SELECT DISTINCT fact_id FROM a""")
def recent_analogies(spark, sf):
    """The facts of the last twenty lines of one kind, which are not shown again."""
    log = s.recall_log(spark, sf).withColumn("block", F.when(F.col("block") == "click", "analogy").otherwise(F.col("block")))
    return vectors.recent_analogies(log)


@query("""WITH v AS (SELECT vec_id AS fact_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 60), p AS (SELECT e AS p FROM v WHERE fact_id = 3)
SELECT fact_id, CASE fact_id % 3 WHEN 0 THEN 0.5 ELSE round(list_cosine_similarity(e, p), 6) END AS surface FROM v, p""")
def surface_similarity(spark, sf):
    """Likeness by vector, and by words for facts that have none."""
    v = s.table(spark, sf, "embeddings").where("vec_id < 60")
    probe = v.where("vec_id = 3").first()["embedding"]
    facts = v.select(F.col("vec_id").alias("fact_id"), F.lit("alpha item").alias("content"))
    stored = v.where("vec_id % 3 <> 0").select(_name("holo_fact_", F.col("vec_id")).alias("vid"), "embedding")
    out = vectors.surface(facts, stored, vectors.literal(probe), F.array(F.lit("alpha")))
    return out.select("fact_id", F.round("surface", 6).alias("surface"))


@query("""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x) AS a FROM embeddings WHERE vec_id < 50), p AS (SELECT a AS b FROM v WHERE vec_id = 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] + z[2])), 6) AS total FROM v, p""")
def phase_binding(spark, sf):
    """Binding adds phases place by place."""
    v = s.table(spark, sf, "embeddings").where("vec_id < 50")
    probe = vectors.literal(v.where("vec_id = 1").first()["embedding"])
    bound = vectors.bind(F.transform("embedding", lambda x: x.cast("double")), probe)
    return v.select("vec_id", F.round(F.aggregate(bound, F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query(f"""WITH {s.FACTS}, n AS (SELECT unnest(['license', 'the', 'password=', 'benefits']) AS name), f AS (SELECT fact_id, content, trust_score FROM facts)
SELECT name, fact_id FROM n JOIN f ON contains(lower(content), name) WHERE length(name) >= 4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY trust_score DESC, fact_id) <= 6""")
def facts_of_nodes(spark, sf):
    nodes = spark.createDataFrame([("license",), ("the",), ("password=",), ("benefits",)], "name string")
    return snapshot.facts_of_nodes(nodes, s.facts(spark, sf)).select("name", "fact_id")


@query(f"""WITH {_SMALL}, {_TYPES.format('vis')}, d AS (SELECT a AS name, count(*) AS degree FROM both_ GROUP BY a)
SELECT name, type, degree FROM types JOIN d USING (name) WHERE name NOT LIKE '%:3' ORDER BY degree DESC, name LIMIT 26""")
def core_nodes(spark, sf):
    """The best connected nodes that are at no stage."""
    e = _small(spark, sf)
    nodes = _typed(e).withColumn("attrs", F.when(F.col("name").endswith(":3"), '{"stage":"1"}').when(F.col("name").endswith(":4"), '{"other":"1"}'))
    return snapshot.core_nodes(nodes, e).select("name", "type", "degree")


@query(f"WITH {s.FACT_ENTITIES}, e AS (SELECT DISTINCT entity_id, 'part ' || entity_id AS name FROM fact_entities WHERE entity_id % 2 = 0) SELECT fact_id, name FROM fact_entities JOIN e USING (entity_id) WHERE fact_id IN (1, 2, 3, 7, 32)")
def entities_of_facts(spark, sf):
    links = s.fact_entities(spark, sf)
    entities = links.select("entity_id").distinct().where("entity_id % 2 = 0").withColumn("name", _name("part ", F.col("entity_id")))
    wanted = spark.createDataFrame([(1,), (2,), (3,), (7,), (32,)], "fact_id long")
    return consolidate.entity_names(links, entities, wanted)


# ingestion and calendar


@query("""SELECT event_id AS k, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 3 = 0""")
def parsed_lines(spark, sf):
    """Objects of an answer in lines, commas and backticks around them taken off; words and broken objects are left out."""
    key = F.col("event_id")
    line = F.when(key % 3 == 0, F.concat(F.lit("` "), "props", F.lit(",`"))).when(key % 3 == 1, F.concat(F.lit("so "), "props")).otherwise(F.lit("{broken"))
    rows = ingest.parse_lines(s.table(spark, sf, "events").select(key.alias("k"), line.alias("line")))
    return rows.select("k", F.try_variant_get("object", "$.k", "string").alias("value"))


_LINES = "l AS (SELECT CAST(event_id AS VARCHAR) AS doc, 'fact number ' || (event_id % 50) AS content, event_id FROM events WHERE event_id < 300)"


def _lines(spark, sf):
    e = s.table(spark, sf, "events").where("event_id < 300")
    none = F.lit(None).cast("string")
    key = F.col("event_id")
    return e.select(key.cast("string").alias("doc"), F.lit("fact").alias("kind"), _name("fact number ", key % 50).alias("content"), F.lit("x").alias("category"), *[none.alias(c) for c in ("src", "rel", "dst", "name", "type")])


@query(f"""WITH {_LINES}, f AS (SELECT content, min(doc) AS doc FROM l WHERE event_id % 50 >= 5 GROUP BY content)
SELECT content, CASE CAST(doc AS BIGINT) % 2 WHEN 0 THEN 'mail' ELSE 'note' END AS category, CASE CAST(doc AS BIGINT) % 2 WHEN 0 THEN 'mail,from:Ann' ELSE 'note' END AS tags,
 CASE CAST(doc AS BIGINT) % 2 WHEN 0 THEN 'mail' ELSE 'note' END || ':' || doc AS source_ref, CAST(0.5 AS DOUBLE) AS trust, 1 AS ids FROM f""")
def ingested_facts(spark, sf):
    """New facts with an id, the source as category, tags and provenance; what the store has is left out."""
    lines = _lines(spark, sf)
    even = F.col("doc").cast("bigint") % 2 == 0
    docs = lines.select(F.col("doc").alias("id"), F.when(even, "mail").alias("source"), F.when(even, F.create_map(F.lit("from"), F.lit("Ann"), F.lit("other"), F.lit("x"))).alias("meta"))
    known = spark.createDataFrame([(f"fact number {k}",) for k in range(5)], "content string")
    rows = ingest.new_facts(lines, known, docs)
    same = F.count("*").over(_by("fact_id"))
    return rows.select("content", "category", "tags", "source_ref", F.col("trust_score").alias("trust"), (same * F.when(F.col("fact_id") >= 0, 1).otherwise(0)).cast("int").alias("ids"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


@query("""WITH e AS (SELECT event_id, 'Unit ' || (event_id % 9) AS a, 'Acme ' || (user_id % 4) AS b FROM events WHERE event_id < 200)
SELECT DISTINCT 'edge' AS kind, b AS src, 'OWNS' AS rel, a AS dst FROM e UNION SELECT DISTINCT 'node', a, 'project', '' FROM e
UNION SELECT DISTINCT 'key', 'norm:' || lower(a), a, '' FROM e UNION SELECT DISTINCT 'key', 'norm:' || lower(b), b, '' FROM e""")
def ingested_graph(spark, sf):
    """What a batch writes to the graph: canonical names and relations, listed nodes, and the keys that the next batch will know them by."""
    e = s.table(spark, sf, "events").where("event_id < 200")
    a, b = _name("Unit ", F.col("event_id") % 9), _name("Acme ", F.col("user_id") % 4)
    edges = e.select(F.concat(F.lit("The "), a).alias("src"), F.lit("owned by").alias("rel"), F.concat(b, F.lit(" Inc")).alias("dst"), F.lit("doc:1").alias("source_ref"))
    nodes = e.select(a.alias("name"), F.lit("project").alias("type"), F.lit(None).cast("string").alias("attrs")).distinct()
    seeds = e.select(F.concat(F.lit("norm:"), F.lower(b)).alias("key"), b.alias("canonical"), F.lit("org").alias("type"), F.lit(0).cast("bigint").alias("seq")).distinct()
    node_rows, edge_rows, keys = maintain.write_graph(nodes, edges, 1_000_000, index=seeds)
    empty = F.lit("")
    out = edge_rows.where("src_tag = 'ingest'").select(F.lit("edge").alias("kind"), "src", "rel", "dst").union(node_rows.select(F.lit("node"), "name", "type", empty))
    return out.union(keys.select(F.lit("key"), "key", "canonical", empty)).distinct()


@query("""SELECT DISTINCT event_type || ' (' || strftime(ts, '%Y-%m-%d') || ')' AS name, 'event' AS type, 'personal' AS cal, strftime(ts, '%Y-%m-%d') AS start FROM events WHERE event_id < 300 AND event_id % 4 <> 0""")
def calendar_nodes(spark, sf):
    """Every live event is a node, with what the mirror needs to find it again."""
    e = s.table(spark, sf, "events").where("event_id < 300")
    day = F.date_format("ts", "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    rows = e.select(_name("e", F.col("event_id")).alias("id"), F.when(F.col("event_id") % 4 == 0, "cancelled").alias("status"), F.col("event_type").alias("summary"), none.alias("description"), none.alias("location"), day.alias("start"), none.alias("end"))
    nodes = calendar.node_rows(rows, 1)
    return calendar.event_nodes(nodes).join(nodes.select("name", "type"), "name").select("name", "type", "cal", "start")


@query(f"""WITH {_SMALL} SELECT src, rel, dst FROM vis WHERE src NOT IN ('nation:1', 'region:2') AND dst NOT IN ('nation:1', 'region:2')""")
def pruned_edges(spark, sf):
    """A pruned node takes its edges along, at either end and whatever their tag."""
    return calendar.prune(_small(spark, sf), spark.createDataFrame([("nation:1",), ("region:2",)], "name string")).select("src", "rel", "dst")


@query("""SELECT o_orderkey AS fact_id, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.5 ELSE 0.84 END AS DOUBLE) AS old_trust, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.52 ELSE 0.85 END AS DOUBLE) AS new_trust, 'decision' AS reason FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey < 1000""")
def trust_moves(spark, sf):
    """Old and new trust with the reason, of facts whose trust moves; what is at the ceiling stays and makes no row."""
    o = s.table(spark, sf, "orders").where("o_orderkey < 1000")
    key = F.col("o_orderkey")
    facts = o.select(key.alias("fact_id"), F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 0.84).otherwise(0.85).alias("trust_score"))
    return feedback.apply(facts, o.select(key.alias("fact_id"), F.lit(0.02).alias("delta"), F.lit("decision").alias("reason")))
