"""The graph, its folds and its loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.operators import consolidate, graph, relations, resolve, review, snapshot, store

from . import standins as s
from .registry import query

_TAGGED = s.EDGES + """, fold AS (SELECT src, rel, dst, src_tag, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY seq) AS n FROM edges) WHERE n = 1),
vis AS (SELECT * FROM fold WHERE src_tag IS NULL OR src_tag NOT IN ('proposed', 'rejected', 'alias-candidate')),
single AS (SELECT src, dst, arg_max(rel, seq) AS rel, max(seq) AS seq FROM vis GROUP BY src, dst)"""
_SMALL = s.SMALL_EDGES + """, vis AS (SELECT * FROM small WHERE src_tag IS NULL OR src_tag NOT IN ('proposed', 'rejected', 'alias-candidate')),
both_ AS (SELECT src AS a, dst AS b FROM vis UNION SELECT dst, src FROM vis)"""
_TYPES = "types AS (SELECT name, split_part(name, ':', 1) AS type FROM (SELECT src AS name FROM {0} UNION SELECT dst FROM {0}))"


def _visible(spark, sf):
    return store.visible_edges(store.fold_edges(s.edges(spark, sf)))


def _seen(spark, sf):
    """The same without tags."""
    return store.seen_edges(s.edges(spark, sf))


def _small(spark, sf):
    return store.visible_edges(s.small_edges(spark, sf))


def _typed(edges):
    return store.ends(edges).withColumn("type", F.substring_index("name", ":", 1))


@query(f"WITH {_TAGGED} SELECT src, rel, dst, src_tag, seq FROM fold")
def edge_fold(spark, sf):
    return store.fold_edges(s.edges(spark, sf)).select("src", "rel", "dst", "src_tag", "seq")


@query(f"WITH {_TAGGED} SELECT rel, coalesce(src_tag, 'none') AS tag, count(*) AS n FROM vis GROUP BY ALL")
def graph_load(spark, sf):
    return _visible(spark, sf).groupBy("rel", F.coalesce("src_tag", F.lit("none")).alias("tag")).agg(F.count("*").alias("n"))


@query(f"WITH {_TAGGED} SELECT src, dst, rel FROM single")
def single_edges(spark, sf):
    return store.single_edges(_seen(spark, sf)).select("src", "dst", "rel")


@query(f"WITH {_TAGGED}, {_TYPES.format('vis')} SELECT type, count(*) AS n FROM (SELECT name, CASE WHEN type = 'part' THEN 'concept' ELSE type END AS type FROM types) GROUP BY type")
def node_types(spark, sf):
    e = _seen(spark, sf)
    listed = _typed(e).where("type <> 'part'")
    return store.graph_nodes(listed, e).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH log AS (SELECT 'n' || (event_id % 200) AS name, CASE WHEN event_id % 4 = 0 THEN event_type END AS type, CASE WHEN event_id % 3 = 0 THEN props ELSE '{}' END AS attrs, event_id AS seq FROM events)
SELECT name, coalesce(arg_max(type, seq) FILTER (WHERE attrs <> '{}' AND type IS NOT NULL), arg_min(type, seq) FILTER (WHERE type IS NOT NULL)) AS type, arg_max(attrs, seq) FILTER (WHERE attrs <> '{}') AS attrs FROM log GROUP BY name""")
def node_fold(spark, sf):
    e = s.table(spark, sf, "events")
    log = e.select(F.concat(F.lit("n"), (F.col("event_id") % 200).cast("string")).alias("name"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("type"), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("{}").alias("attrs"), F.col("event_id").alias("seq"))
    return store.fold_nodes(log)


@query(f"WITH {_TAGGED}, b AS (SELECT src AS a, dst AS b FROM vis UNION SELECT dst, src FROM vis) SELECT a AS name, count(*) AS degree FROM b GROUP BY a")
def degrees(spark, sf):
    return graph.degree(_seen(spark, sf))


@query(f"WITH {_TAGGED}, b AS (SELECT src AS a, dst AS b FROM vis UNION SELECT dst, src FROM vis) SELECT a AS name, count(*) AS degree FROM b GROUP BY a ORDER BY degree DESC, name LIMIT 20")
def hubs(spark, sf):
    return graph.degree(_seen(spark, sf)).orderBy(F.desc("degree"), "name").limit(20)


@query(f"WITH {_TAGGED} SELECT name, count(*) AS degree FROM (SELECT src AS name FROM single UNION ALL SELECT dst FROM single) GROUP BY name")
def directed_degrees(spark, sf):
    return graph.directed_degree(_seen(spark, sf))


@query(f"WITH {_TAGGED} SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM vis GROUP BY rel")
def relation_histogram(spark, sf):
    return _seen(spark, sf).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


_HOPS = """one AS (SELECT DISTINCT b AS node FROM both_ WHERE a = 'region:1'),
two AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM one) AND b <> 'region:1' AND b NOT IN (SELECT node FROM one))"""


@query(f"""WITH {_SMALL}, {_HOPS}
SELECT node, 1 AS hop, v.src AS from_node, v.rel AS relation, v.dst AS to_node FROM one JOIN vis v ON (v.src = 'region:1' AND v.dst = node) OR (v.dst = 'region:1' AND v.src = node)
UNION ALL SELECT node, 2, v.src, v.rel, v.dst FROM two JOIN vis v ON (v.src = node AND v.dst IN (SELECT node FROM one)) OR (v.dst = node AND v.src IN (SELECT node FROM one))""")
def two_hops(spark, sf):
    start = spark.range(1).select(F.lit("region:1").alias("start"))
    return graph.neighbours(_small(spark, sf), start, 2).select("node", "hop", "from_node", "relation", "to_node")


@query(f"WITH {_TAGGED}, b AS (SELECT src AS a, dst AS b FROM vis UNION SELECT dst, src FROM vis) SELECT b AS name FROM b WHERE a IN ('supplier:1', 'supplier:2') AND b NOT IN ('supplier:1', 'supplier:2') GROUP BY b HAVING count(*) = 2 ORDER BY b LIMIT 15")
def shared_neighbours(spark, sf):
    return graph.shared_neighbours(_seen(spark, sf), ["supplier:1", "supplier:2"])


_PAIRS = "pairs AS (SELECT 'customer:' || c_custkey AS a, 'supplier:' || (c_custkey % 8 + 1) AS b FROM customer WHERE c_custkey <= 20)"


@query(f"""WITH RECURSIVE {_SMALL}, {_PAIRS},
walk AS (SELECT DISTINCT a AS start, a AS at, 0 AS hops FROM pairs UNION SELECT w.start, e.b, w.hops + 1 FROM walk w JOIN both_ e ON e.a = w.at WHERE w.hops < 6)
SELECT p.a, p.b, CAST(min(w.hops) AS INTEGER) AS hops FROM pairs p LEFT JOIN walk w ON w.start = p.a AND w.at = p.b GROUP BY p.a, p.b""")
def shortest_paths(spark, sf):
    return graph.shortest_paths(_small(spark, sf), _pairs(spark, sf)).select("a", "b", "hops")


def _pairs(spark, sf):
    c = s.table(spark, sf, "customer").where("c_custkey <= 20")
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("supplier:"), (F.col("c_custkey") % 8 + 1).cast("string")).alias("b"))


@query(f"""WITH RECURSIVE {_SMALL}, {_PAIRS}, w AS (SELECT DISTINCT a AS start, a AS here, [a] AS path FROM pairs UNION ALL SELECT w.start, e.b, list_append(w.path, e.b) FROM w JOIN both_ e ON e.a = w.here WHERE NOT list_contains(w.path, e.b)),
p AS (SELECT a, b, path FROM pairs JOIN w ON w.start = a AND w.here = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1),
h AS (SELECT a, b, i AS step, path[i] AS x, path[i + 1] AS y FROM (SELECT a, b, path, unnest(range(1, len(path))) AS i FROM p))
SELECT a, b, CAST(step AS INTEGER) AS step, coalesce(f.src, g.src) AS from_node, coalesce(f.rel, g.rel) AS relation, coalesce(f.dst, g.dst) AS to_node
FROM h LEFT JOIN vis f ON f.src = x AND f.dst = y LEFT JOIN vis g ON g.src = y AND g.dst = x""")
def path_relations(spark, sf):
    """The hops of paths with their relations; which of several shortest paths it is goes by name."""
    e = _small(spark, sf)
    pairs = _pairs(spark, sf)
    return graph.path_relations(e, graph.shortest_paths(e, pairs))


@query("""WITH RECURSIVE e AS (SELECT event_id AS a, (event_id * 7 + 3) % (SELECT count(*) FROM events) AS b FROM events WHERE event_id % 5 = 0 AND event_id < 1000),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS label FROM b UNION SELECT b.b, w.label FROM w JOIN b ON b.a = w.node)
SELECT node, min(label) AS label FROM w GROUP BY node""")
def components(spark, sf):
    n = s.table(spark, sf, "events").count()
    e = s.table(spark, sf, "events").where("event_id % 5 = 0 AND event_id < 1000").select(F.col("event_id").alias("a"), ((F.col("event_id") * 7 + 3) % n).alias("b"))
    return graph.components(e)


_PRINTS = f"""{_TYPES.format('single')},
prints AS (SELECT name, dir, rel, type, count(*) AS n FROM (
  SELECT src AS name, 'out' AS dir, rel, t.type FROM single JOIN types t ON t.name = dst UNION ALL SELECT dst, 'in', rel, t.type FROM single JOIN types t ON t.name = src) GROUP BY ALL)"""


@query(f"WITH {_TAGGED}, {_PRINTS} SELECT name, dir, rel, type, n FROM prints")
def fingerprints(spark, sf):
    # all ends that were ever asserted have a type, so the edges need no second fold for it
    return graph.fingerprints(_seen(spark, sf), _typed(s.edges(spark, sf)))


@query(f"""WITH {_TAGGED}, {_PRINTS}, m AS (SELECT * FROM prints WHERE name = 'supplier:1'), norm AS (SELECT name, sqrt(sum(n * n)) AS norm FROM prints GROUP BY name),
d AS (SELECT p.name, sum(p.n * m.n) AS dot FROM prints p JOIN m USING (dir, rel, type) WHERE p.name <> 'supplier:1' GROUP BY p.name),
near AS (SELECT dst AS name FROM single WHERE src = 'supplier:1' UNION SELECT src FROM single WHERE dst = 'supplier:1')
SELECT name AS target, round(dot / (n.norm * (SELECT norm FROM norm WHERE name = 'supplier:1')), 3) AS similarity FROM d JOIN norm n USING (name)
WHERE name NOT IN (SELECT name FROM near) AND NOT contains(replace(name, ':', ' '), 'supplier 1') ORDER BY similarity DESC, name LIMIT 10""")
def analogize(spark, sf):
    e = _seen(spark, sf).withColumn("src_tag", F.lit(None).cast("string"))
    return graph.analogize(e, _typed(s.edges(spark, sf)), "supplier:1", 10).select("target", "similarity")


_WORKS = "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Harbor Works ' || s_suppkey ELSE substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 12) END AS name FROM supplier"


@query(f"WITH w AS ({_WORKS}) SELECT 'Harbor Works 3' AS source, name AS target, CAST(1.0 AS DOUBLE) AS similarity, 'LOCATED_IN' AS shared FROM w WHERE k % 3 <> 0 ORDER BY name LIMIT 5")
def analogize_by_ratio(spark, sf):
    """The same, where names that agree to 0.7 are left out as well: all other works in the harbour."""
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("Harbor Works "), key.cast("string"))).otherwise(F.substring(F.md5(key.cast("string")), 1, 12))
    e = s.table(spark, sf, "supplier").select(name.alias("src"), F.lit("LOCATED_IN").alias("rel"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("etl").alias("src_tag"), key.alias("seq"))
    nodes = e.select(F.col("src").alias("name"), F.lit("org").alias("type")).union(e.select("dst", F.lit("nation")).distinct())
    found = graph.analogize(e, nodes, "Harbor Works 3", 5, resolve.ratio("source_norm", "target_norm") >= 0.7)
    return found.select("source", "target", "similarity", F.col("shared_relations")[0].alias("shared"))


@query(f"""WITH {s.SMALL_EDGES}, x AS (SELECT src AS name, split_part(src, ':', 1) AS own, rel || (seq % 3) AS f, count(*) AS n FROM small WHERE src NOT LIKE 'region%' GROUP BY ALL),
norm AS (SELECT name, sqrt(sum(n * n)) AS norm FROM x GROUP BY name),
d AS (SELECT a.name AS a, b.name AS b, sum(a.n * b.n) AS dot FROM x a JOIN x b ON a.f = b.f AND a.own = b.own AND a.name < b.name WHERE a.own = 'supplier' GROUP BY a.name, b.name)
SELECT a, b, round(dot / (p.norm * q.norm), 6) AS cosine FROM d JOIN norm p ON p.name = a JOIN norm q ON q.name = b WHERE dot / (p.norm * q.norm) >= 0.8""")
def fingerprint_pairs(spark, sf):
    e = s.small_edges(spark, sf).where("src LIKE 'supplier%'")
    prints = e.groupBy(F.col("src").alias("name"), F.lit("out").alias("dir"), "rel", (F.col("seq") % 3).cast("string").alias("type")).agg(F.count("*").alias("n"))
    nodes = e.select(F.col("src").alias("name"), F.lit("supplier").alias("type")).distinct()
    return graph.fingerprint_pairs(prints, nodes).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""WITH m AS (SELECT 'org:' || s_suppkey AS name, s_suppkey % 3 AS c FROM supplier WHERE s_suppkey % 10 <> 9),
g AS (SELECT c, min(name) AS label, list(name ORDER BY name) AS members, count(*) AS n FROM m GROUP BY c HAVING count(*) >= 2)
SELECT 'org' AS type, label, array_to_string(members, ',') AS members, CASE c WHEN 0 THEN 'LOCATED_IN,OFFERS' WHEN 1 THEN 'LOCATED_IN,OWNS' ELSE 'LEADS,LOCATED_IN' END AS relations FROM g ORDER BY n DESC, label LIMIT 5""")
def categories(spark, sf):
    """Groups of alike suppliers; those that belong to a category already, if only as a rejected proposal, are left out."""
    base = s.table(spark, sf, "supplier").select(F.concat(F.lit("org:"), F.col("s_suppkey").cast("string")).alias("src"), F.col("s_suppkey").alias("seq"))
    rel = F.when(F.col("seq") % 3 == 0, "OFFERS").when(F.col("seq") % 3 == 1, "OWNS").otherwise("LEADS")
    row = lambda r, to, tag: base.select("src", r.alias("rel"), F.concat(F.lit(to), (F.col("seq") % 7).cast("string")).alias("dst"), F.lit(tag).alias("src_tag"), "seq")
    e = row(F.lit("LOCATED_IN"), "city:", "etl").union(row(rel, "thing:", "etl")).union(row(F.lit("INSTANCE_OF"), "kind:", "rejected").where("seq % 10 = 9"))
    nodes = base.select(F.col("src").alias("name"), F.lit("org").alias("type")).union(e.where("rel <> 'INSTANCE_OF'").select("dst", F.lit("event")).distinct())
    found = graph.categories(e, nodes, largest=1_000_000)
    return found.select("type", "label", F.array_join("members", ",").alias("members"), F.array_join("relations", ",").alias("relations"))


_SHARED = f"""WITH {s.FACT_ENTITIES}, n AS (SELECT entity_id, count(*) AS n FROM fact_entities GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
k AS (SELECT f.*, n FROM fact_entities f JOIN n USING (entity_id)),
p AS (SELECT a.fact_id AS a, b.fact_id AS b, count(*) AS shared, bool_or(a.n <= 15) AS small FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.fact_id < b.fact_id GROUP BY 1, 2)"""


@query(f"{_SHARED} SELECT a, b, shared, small FROM p WHERE shared >= 2 OR small")
def shared_entity_pairs(spark, sf):
    return consolidate.shared_pairs(s.fact_entities(spark, sf)).where("shared >= 2 OR small")


@query(_SHARED.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT a, b FROM p WHERE shared >= 2 OR small), e AS (SELECT a, b FROM t UNION SELECT b, a FROM t),
w AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.node),
c AS (SELECT node, min(label) AS label FROM w GROUP BY node), g AS (SELECT label, list(node ORDER BY node) AS members FROM c GROUP BY label)
SELECT substring(sha256(array_to_string(members, ',')), 1, 12) AS signature, CAST(len(members) AS INTEGER) AS size FROM g WHERE len(members) BETWEEN 3 AND 12""")
def fact_clusters(spark, sf):
    return consolidate.clusters(s.fact_entities(spark, sf)).select("signature", F.size("members").alias("size"))


_LINKS = "SELECT event_id AS fact_id, event_id // 5 AS entity_id FROM events WHERE event_id < 300 UNION SELECT event_id, 100000 + event_id // 20 FROM events WHERE event_id < 300 AND event_id % 5 = 0 AND event_id % 20 < 10"


@query(f"""WITH l AS ({_LINKS}), c AS (SELECT fact_id, CASE WHEN fact_id % 20 < 10 THEN fact_id // 20 * 20 ELSE fact_id // 5 * 5 END AS label FROM l GROUP BY ALL)
SELECT substring(sha256(array_to_string(list(fact_id ORDER BY fact_id), ',')), 1, 12) AS signature, CAST(count(*) AS INTEGER) AS size FROM c GROUP BY label""")
def small_clusters(spark, sf):
    """Facts in fives, every other pair of fives tied by one more entity."""
    e = s.table(spark, sf, "events").where("event_id < 300").select(F.col("event_id").alias("fact_id"))
    five = e.select("fact_id", F.floor(F.col("fact_id") / 5).alias("entity_id"))
    tie = e.where("fact_id % 5 = 0 AND fact_id % 20 < 10").select("fact_id", F.floor(F.col("fact_id") / 20) + 100000)
    return consolidate.clusters(five.union(tie)).select("signature", F.size("members").alias("size"))


_RELS = ["works_at", "OFFERS_HYBRID_IN", "currently managed by", "BLESSED_BY", "Owned By", "sells", "child_of", "has_ceo", "visited", "xyz", "applied via", "Position At"]
_MAPPED = [("WORKS_FOR", False), ("LOCATED_IN", False), ("LEADS", True), ("RELATED_TO", False), ("OWNS", True), ("OFFERS", False), ("PARENT_OF", True), ("LEADS", True), ("TRAVELS_TO", False), ("RELATED_TO", False), ("USES", False), ("HIRING", False)]


@query("WITH m(i, rel, canonical, flipped) AS (VALUES " + ", ".join(f"({i}, '{r}', '{c}', {f})" for i, (r, (c, f)) in enumerate(zip(_RELS, _MAPPED)))
       + f") SELECT rel, canonical, flipped, count(*) AS n FROM events JOIN m ON m.i = event_id % {len(_RELS)} GROUP BY ALL")
def relation_mapping(spark, sf):
    e = s.table(spark, sf, "events")
    rel = F.element_at(F.array(*map(F.lit, _RELS)), (F.col("event_id") % len(_RELS) + 1).cast("int"))
    return relations.mapping(e.select(rel.alias("rel")))


_REMAP_SQL = f"""WITH m(i, rel, canonical, flipped) AS (VALUES {", ".join(f"({i}, '{r}', '{c}', {f})" for i, (r, (c, f)) in enumerate(zip(_RELS, _MAPPED)))}),
e AS (SELECT 'u' || user_id AS src, 'x' || (event_id % 17) AS dst, m.*, event_id AS seq FROM events JOIN m ON m.i = event_id % {len(_RELS)}),
x AS (SELECT CASE WHEN flipped THEN dst ELSE src END AS src, canonical AS rel, CASE WHEN flipped THEN src ELSE dst END AS dst, CASE WHEN flipped OR canonical <> replace(upper(rel), ' ', '_') THEN rel ELSE '' END AS rel_orig, seq FROM e)
SELECT src, rel, dst, rel_orig FROM (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY rel_orig = '' DESC, seq) AS n FROM x) WHERE n = 1"""


@query(_REMAP_SQL)
def relation_remap(spark, sf):
    e = s.table(spark, sf, "events")
    rel = F.element_at(F.array(*map(F.lit, _RELS)), (F.col("event_id") % len(_RELS) + 1).cast("int"))
    edges = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), rel.alias("rel"), F.concat(F.lit("x"), (F.col("event_id") % 17).cast("string")).alias("dst"), F.lit("email:1").alias("src_tag"), F.col("event_id").alias("seq"))
    return relations.remap(edges).select("src", "rel", "dst", "rel_orig")


@query(f"""WITH {_TAGGED}, x AS (SELECT CASE WHEN src = 'supplier:2' THEN 'supplier:1' ELSE src END AS src, rel, CASE WHEN dst = 'supplier:2' THEN 'supplier:1' ELSE dst END AS dst, src = 'supplier:2' OR dst = 'supplier:2' AS moved, src_tag, seq FROM vis WHERE src IN ('supplier:1', 'supplier:2', 'supplier:3'))
SELECT src, rel, dst, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY moved, seq) AS n FROM x WHERE src <> dst) WHERE n = 1""")
def merged_nodes(spark, sf):
    e = _visible(spark, sf).where("src IN ('supplier:1', 'supplier:2', 'supplier:3')")
    return store.merge_nodes(e, "supplier:2", "supplier:1").select("src", "rel", "dst", "seq")


@query(f"WITH {_TAGGED} SELECT dst AS category, CAST(count(*) AS BIGINT) AS n, min(src) AS first FROM fold WHERE rel = 'LOCATED_IN' AND src_tag = 'proposed' GROUP BY dst")
def review_queue(spark, sf):
    e = store.fold_edges(s.edges(spark, sf)).withColumn("rel", F.when(F.col("rel") == "LOCATED_IN", "INSTANCE_OF").otherwise(F.col("rel")))
    return review.pending_categories(e.where("rel = 'INSTANCE_OF'")).select("category", F.size("members").cast("bigint").alias("n"), F.col("members")[0].alias("first"))


@query(f"WITH {_TAGGED} SELECT coalesce(src_tag, 'none') AS tag, count(*) AS n FROM fold WHERE src_tag IS NULL OR src_tag <> 'proposed' GROUP BY 1")
def delete_by_tag(spark, sf):
    e = store.without_tag(store.fold_edges(s.edges(spark, sf)), "proposed")
    return e.groupBy(F.coalesce("src_tag", F.lit("none")).alias("tag")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT 'Nation ' || n_name AS name FROM nation), a AS (SELECT name AS asked FROM n UNION ALL SELECT upper(name) FROM n UNION ALL SELECT 'alias ' || name FROM n UNION ALL SELECT 'nobody')
SELECT asked AS name, (SELECT min(n.name) FROM n WHERE lower(n.name) = lower(asked) OR 'alias ' || lower(n.name) = lower(asked)) AS node FROM a""")
def resolved_nodes(spark, sf):
    n = s.table(spark, sf, "nation").select(F.concat(F.lit("Nation "), "n_name").alias("name"))
    asked = n.union(n.select(F.upper("name"))).union(n.select(F.concat(F.lit("alias "), "name"))).union(spark.range(1).select(F.lit("nobody")))
    aliases = n.select(F.concat(F.lit("alias "), "name").alias("alias"), F.col("name").alias("canonical"))
    return graph.resolve_names(asked, n, aliases)


#: Names of four to six letters: with the last one doubled they agree to 8/9, 10/11 or 12/13.
_OLD_NAMES = ["Opal", "Ivory", "Quartz", "Meadow", "Falcon", "Ginger", "Violet", "Copper", "Tundra", "Jungle"]
_RESOLVED = f"""WITH n AS (SELECT s_suppkey AS k, {_OLD_NAMES}[s_suppkey + 1] AS w FROM supplier WHERE s_suppkey < 10)
SELECT k AS seq, w || ' Inc.' AS name, w || ' Inc' AS canonical, CAST(NULL AS VARCHAR) AS candidate, CAST(NULL AS DOUBLE) AS score FROM n
UNION ALL SELECT k + 1000, 'The  ' || w, w || ' Inc', NULL, NULL FROM n
UNION ALL SELECT k + 2000, w || right(w, 1), CASE WHEN length(w) < 6 THEN w || right(w, 1) ELSE w || ' Inc' END, CASE WHEN length(w) < 6 THEN w || ' Inc' END, CASE WHEN length(w) < 6 THEN round(2 * length(w) / (2 * length(w) + 1), 3) END FROM n"""


def _spellings(spark, sf):
    key = F.col("s_suppkey")
    base = s.table(spark, sf, "supplier").where("s_suppkey < 10").select(key.alias("k"), F.try_element_at(F.array(*map(F.lit, _OLD_NAMES)), (key + 1).cast("int")).alias("w"))
    rows = base.select(F.col("k").alias("seq"), F.concat("w", F.lit(" Inc.")).alias("name")).union(base.select(F.col("k") + 1000, F.concat(F.lit("The  "), "w"))).union(base.select(F.col("k") + 2000, F.concat("w", F.right("w", F.lit(1)))))
    return rows.select("seq", "name", *[F.lit(None).cast("string").alias(c) for c in ("domain", "email", "phone")], F.lit("org").alias("type"))


@query(_RESOLVED)
def resolved_entities(spark, sf):
    """Names and spellings of them, by the ordered rule: equal keys and near names merge, less near ones are for review."""
    return resolve.resolve_in_order(_spellings(spark, sf))


@query(_RESOLVED)
def resolved_at_scale(spark, sf):
    """The same by the order-free rule."""
    return resolve.resolve_at_scale(_spellings(spark, sf))


@query(_RESOLVED)
def resolved_with_index(spark, sf):
    """The same in two batches, of which the second knows the first by its keys."""
    rows = _spellings(spark, sf)
    first, second = rows.where("seq < 1000"), rows.where("seq >= 1000")
    one = resolve.resolve_in_order(first)
    return one.union(resolve.resolve_in_order(second, resolve.new_keys(first, one, 1)))


@query("""WITH f AS (SELECT s_suppkey AS seq, lower('unit ' || (s_suppkey % 30)) AS norm FROM supplier) SELECT seq, 'Unit ' || (seq % 30) AS name, 'Unit ' || (seq % 30) AS canonical FROM f""")
def resolved_by_key(spark, sf):
    rows = s.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("Unit "), (F.col("s_suppkey") % 30).cast("string")).alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("domain", "email", "phone")], F.lit("org").alias("type"))
    return resolve.resolve_at_scale(rows, merge=1.0, candidate=1.0).select("seq", "name", "canonical")


@query(f"""WITH {_SMALL}, {_HOPS}, k AS (SELECT 'region:1' AS name UNION SELECT node FROM (SELECT node FROM one ORDER BY node LIMIT 20))
SELECT count(*) AS lines FROM vis WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)""")
def subgraph_core(spark, sf):
    e = _small(spark, sf)
    start = spark.range(1).select(F.lit("region:1").alias("start"))
    first = graph.neighbours(e, start, 1).orderBy("node").limit(20).select(F.col("node").alias("name")).union(start)
    return e.join(first.withColumnRenamed("name", "src"), "src", "left_semi").join(first.withColumnRenamed("name", "dst"), "dst", "left_semi").agg(F.count("*").alias("lines"))


@query(f"""WITH {_SMALL}, seeds AS (SELECT unnest(['region:1', 'nation:3']) AS name),
one AS (SELECT b AS name FROM (SELECT DISTINCT s.name AS start, b FROM seeds s JOIN both_ ON a = s.name) QUALIFY row_number() OVER (PARTITION BY start ORDER BY b) <= 20),
f AS (SELECT name FROM seeds UNION SELECT name FROM one),
two AS (SELECT b AS name FROM (SELECT DISTINCT f.name AS start, b FROM f JOIN both_ ON a = f.name) QUALIFY row_number() OVER (PARTITION BY start ORDER BY b) <= 20),
k AS (SELECT name FROM (SELECT name, min(o) AS o FROM (SELECT name, 0 AS o FROM f UNION ALL SELECT name, 1 FROM two) GROUP BY name) ORDER BY o, name LIMIT 140)
SELECT src AS from_node, rel AS relation, dst AS to_node FROM vis WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k) ORDER BY src, rel, dst LIMIT 220""")
def reasoning_subgraph(spark, sf):
    return graph.reasoning_subgraph(_small(spark, sf), ["region:1", "nation:3"])


@query("SELECT n_name AS name FROM nation WHERE contains(lower(n_name), 'i') ORDER BY n_name LIMIT 5")
def did_you_mean(spark, sf):
    return graph.did_you_mean(s.table(spark, sf, "nation").select(F.col("n_name").alias("name")), "I")


@query("""WITH e AS (SELECT event_id, lower(event_type || ' in region ' || (event_id % 7)) AS hay FROM events WHERE event_id < 500), r AS (SELECT 'region ' || r_regionkey AS name FROM region)
SELECT event_id, name FROM e JOIN r ON contains(hay, name)""")
def names_in_text(spark, sf):
    from recallgrid.operators import calendar

    e = s.table(spark, sf, "events").where("event_id < 500").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").cast("string").alias("summary"), F.concat(F.col("event_type"), F.lit(" in Region "), (F.col("event_id") % 7).cast("string")).alias("description"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("status"))
    nodes = s.table(spark, sf, "region").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("name"), F.lit("place").alias("type"))
    found = calendar.edges(e, nodes, "owner").where("rel = 'LOCATED_IN'")
    return found.select(F.col("src").cast("bigint").alias("event_id"), F.col("dst").alias("name"))


@query(f"WITH {_TAGGED} SELECT rel, count(*) AS n FROM vis GROUP BY rel ORDER BY n DESC, rel LIMIT 18")
def relation_top(spark, sf):
    return snapshot.top_relations(_seen(spark, sf))
