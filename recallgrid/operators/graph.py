"""Neighbourhoods, paths, components and fingerprints over edge tables. Loops end on the data, and each round is written out."""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and goes on from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "recallgrid-checkpoints"))
    return df.checkpoint(eager=True)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every node; a pair of edges in both directions counts once."""
    return undirected(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))


def directed_degree(edges: DataFrame) -> DataFrame:
    """In- plus out-edges of every node, at most one edge a direction and pair."""
    single = store.single_edges(edges)
    return single.select(F.col("src").alias("name")).union(single.select("dst")).groupBy("name").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(start, hop, from_node, relation, to_node): every node within depth hops once, by the edge that found it.

    Successors come before predecessors, then earlier edges. starts: column start.
    """
    depth = max(1, min(int(depth), 2))
    single = store.single_edges(edges)
    steps = single.select(F.col("src").alias("at"), F.col("dst").alias("next"), "src", "rel", "dst", F.lit(0).alias("way"), "seq").union(
        single.select(F.col("dst"), F.col("src"), "src", "rel", "dst", F.lit(1), "seq"))
    visited = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("dst"))
    for hop in range(1, depth + 1):
        front = visited.where(F.col("hop") == hop - 1).select("start", F.col("node").alias("at"))
        found = front.join(steps, "at").select("start", F.col("next").alias("node"), F.lit(hop).alias("hop"), "src", "rel", "dst", F.struct("way", "seq", "src", "dst").alias("order"))
        found = found.groupBy("start", "node").agg(F.min_by(F.struct("hop", "src", "rel", "dst"), "order").alias("best")).select("start", "node", "best.*")
        visited = visited.union(found.join(visited.select("start", "node"), ["start", "node"], "left_anti"))
    return visited.where("hop > 0").select("start", "node", "hop", F.col("src").alias("from_node"), F.col("rel").alias("relation"), F.col("dst").alias("to_node"))


def shared_neighbours(edges: DataFrame, names: list[str], shown: int = 15) -> DataFrame:
    """Nodes next to every one of names, the first by name."""
    near = undirected(edges).where(F.col("src").isin(*names) & ~F.col("dst").isin(*names))
    both = near.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") == len(set(names)))
    return both.orderBy("name").limit(shown).select("name")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hops, path) of undirected shortest paths for pairs (a, b); null hops where there is none.

    All pairs advance a hop together, until no pair has a node left to go to; a node is visited once a pair, by the least path.
    A node next to the front is new, in the front or in the front before it, so only these two are looked up. Fronts are written out.
    """
    both = cut(undirected(edges).select(F.col("src").alias("at"), F.col("dst").alias("to")))
    front = cut(pairs.select("a", "b").distinct().select("a", "b", F.col("a").alias("at"), F.lit(0).alias("hops"), F.array("a").alias("path")))
    before = front
    done = front.where("at = b")
    for hop in itertools.count(1):
        open_ = front.join(done.select("a", "b"), ["a", "b"], "left_anti")
        step = open_.join(both, "at").select("a", "b", F.col("to").alias("at"), F.lit(hop).alias("hops"), F.concat("path", F.array("to")).alias("path"))
        step = step.groupBy("a", "b", "at").agg(F.first("hops").alias("hops"), F.min("path").alias("path"))
        seen = front.union(before).select("a", "b", "at")
        before, front = front, cut(step.join(seen, ["a", "b", "at"], "left_anti"))
        if front.isEmpty():
            break
        found = front.where("at = b")
        if not found.isEmpty():
            done = cut(done.union(found))
    return pairs.select("a", "b").distinct().join(done.select("a", "b", "hops", "path"), ["a", "b"], "left")


def path_relations(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, step, from_node, relation, to_node): the hops of paths; an edge in walking direction is preferred for the label."""
    single = store.single_edges(edges)
    hop = paths.where("hops > 0").select("a", "b", "path", F.explode(F.sequence(F.lit(1), F.col("hops"))).alias("step"))
    hop = hop.select("a", "b", "step", F.element_at("path", F.col("step")).alias("x"), F.element_at("path", F.col("step") + 1).alias("y"))
    ahead = single.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("rel").alias("ahead"))
    back = single.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.col("rel").alias("back"))
    out = hop.join(ahead, ["x", "y"], "left").join(back, ["x", "y"], "left")
    way = F.col("ahead").isNotNull()
    return out.select("a", "b", "step", F.when(way, F.col("x")).otherwise(F.col("y")).alias("from_node"), F.coalesce("ahead", "back").alias("relation"), F.when(way, F.col("y")).otherwise(F.col("x")).alias("to_node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of edges (a, b), label being the least node that is connected.

    A round takes the least label next door and then the label of that label, so distances halve; it ends when nothing changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(step.join(further, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def fingerprints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, dir, rel, type, n): how often a node has a relation to a type of neighbour. nodes: name, type."""
    return _prints(store.single_edges(edges), nodes)


def _prints(single: DataFrame, nodes: DataFrame) -> DataFrame:
    type_of = lambda c: nodes.select(F.col("name").alias(c), F.col("type"))
    out = single.join(type_of("dst"), "dst", "left").select(F.col("src").alias("name"), F.lit("out").alias("dir"), "rel", F.coalesce("type", F.lit("concept")).alias("type"))
    into = single.join(type_of("src"), "src", "left").select(F.col("dst").alias("name"), F.lit("in").alias("dir"), "rel", F.coalesce("type", F.lit("concept")).alias("type"))
    return out.union(into).groupBy("name", "dir", "rel", "type").agg(F.count("*").alias("n"))


#: Names of one fingerprint that go to a task together, and pairs that one task writes.
BLOCK, TASK_PAIRS = 1000, 4_000_000


def _kinds(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(own, name, print, id): every node with its type and whole fingerprint; id is the same for equal fingerprints of one type. Written out."""
    typed = prints.join(nodes.select("name", F.col("type").alias("own")), "name")
    feature = F.concat_ws("|", "dir", "rel", "type")
    whole = typed.groupBy("own", "name").agg(F.array_sort(F.collect_list(F.struct(feature.alias("f"), "n"))).alias("print"))
    return cut(whole.withColumn("id", F.xxhash64("own", "print")))


def _alike_kinds(whole: DataFrame, floor: float) -> DataFrame:
    """(id_a, id_b, cosine) of distinct fingerprints with id_a <= id_b, each with itself too; joins on shared features, as other pairs have cosine 0."""
    kinds = whole.select("own", "print", "id").distinct()
    square = F.aggregate("print", F.lit(0.0), lambda s, x: s + x.n * x.n)
    long = kinds.select("own", "id", F.sqrt(square).alias("norm"), F.explode("print").alias("x")).select("own", "id", "norm", "x.f", "x.n")
    a, b = (long.select("own", "f", *[F.col(c).alias(f"{c}_{p}") for c in ("id", "norm", "n")]) for p in "ab")
    return a.join(b, ["own", "f"]).where("id_a <= id_b").groupBy("id_a", "id_b").agg((F.sum(F.col("n_a") * F.col("n_b")) / (F.first("norm_a") * F.first("norm_b"))).alias("cosine")).where(F.col("cosine") >= floor - 1e-12)


def fingerprint_pairs(prints: DataFrame, nodes: DataFrame, floor: float = 0.8) -> DataFrame:
    """(a, b, cosine) of nodes of one type whose fingerprints are alike.

    Equal fingerprints are compared once. The pairs of names, whose number is quadratic where many are alike, are neither shuffled nor gathered:
    blocks of names meet, as many in a task as make TASK_PAIRS, and each task writes the pairs of its blocks one after another.
    """
    whole = _kinds(prints, nodes)
    alike = cut(_alike_kinds(whole, floor))
    sizes = whole.groupBy("id").agg(F.count("*").alias("size"))
    n = lambda p: sizes.select(F.col("id").alias(f"id_{p}"), F.col("size").alias(f"size_{p}"))
    total = alike.join(n("a"), "id_a").join(n("b"), "id_b").agg(F.sum(F.col("size_a").cast("double") * F.col("size_b"))).first()[0] or 0
    block = F.pmod(F.xxhash64("name"), F.ceil(F.col("size") / BLOCK)).alias("block")
    blocks = whole.join(sizes, "id").select("id", block, "name").groupBy("id", "block").agg(F.collect_list("name").alias("names"))
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{p}") for c in ("id", "block", "names")]) for p in "ab")
    same = F.col("id_a") == F.col("id_b")
    met = alike.join(left, "id_a").join(right, "id_b").where(~same | (F.col("block_a") <= F.col("block_b")))
    # an explicit number, as the rows are few and short before they are multiplied out
    met = met.repartition(max(1, min(20_000, int(total // TASK_PAIRS) + 1)))
    pairs = met.select((same & (F.col("block_a") == F.col("block_b"))).alias("own"), "cosine", "names_b", F.explode("names_a").alias("a")).select("own", "cosine", "a", F.explode("names_b").alias("b"))
    return pairs.where("NOT own OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def categories(edges: DataFrame, nodes: DataFrame, skip_types: tuple[str, ...] = ("event", "episode", "category", "situation"), floor: float = 0.8, smallest: int = 2, largest: int = 12, shown: int = 5) -> DataFrame:
    """(type, label, members, relations): groups of nodes of one type with alike fingerprints that belong to no category yet.

    edges: all edges including hidden ones, which tell what was ever proposed. Distinct fingerprints are grouped, not pairs of nodes;
    members are gathered of the groups that are shown only.
    """
    promoted = edges.where("rel = 'INSTANCE_OF'").select(F.col("src").alias("name")).distinct()
    seen = store.visible_edges(edges)
    able = directed_degree(seen).where("degree >= 2").join(promoted, "name", "left_anti").join(nodes.where(~F.col("type").isin(*skip_types)), "name")
    prints = fingerprints(seen, nodes).join(able.select("name"), "name", "left_semi")
    whole = _kinds(prints, nodes)
    linked = _alike_kinds(whole, floor).where("id_a < id_b")
    parts = components(linked.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("part"))
    placed = whole.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    # a node by itself is no group
    groups = placed.groupBy("own", "part").agg(F.min("name").alias("label"), F.count("*").alias("n")).where(F.col("n").between(max(smallest, 2), largest))
    best = F.broadcast(groups.orderBy(F.desc("n"), "label").limit(shown))
    member = placed.join(best, ["own", "part"])
    names = member.groupBy("own", "label", "n").agg(F.array_sort(F.collect_list("name")).alias("members"))
    shared = prints.drop("n").join(member.select("name", "label", "n"), "name").groupBy("label", "n", "dir", "rel", "type").agg(F.count("*").alias("have"))
    shared = shared.where("have = n").groupBy("label").agg(F.array_sort(F.collect_set("rel")).alias("relations"))
    typed = names.join(shared, "label", "left")
    return typed.orderBy(F.desc("n"), "label").limit(shown).select(F.col("own").alias("type"), "label", "members", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))


def analogize(edges: DataFrame, nodes: DataFrame, source: str, k: int = 5, alike: Column | None = None) -> DataFrame:
    """(source, target, similarity, shared_relations): nodes whose fingerprints resemble the source's, without neighbours and names that look alike.

    alike: a condition on normalized names source_norm and target_norm that counts as looking alike, besides one holding the other.
    """
    from recallgrid.functions import text

    k = max(1, min(int(k), 10))
    # the edges are folded once; fingerprints, which are many times smaller, are written too
    single = cut(store.single_edges(store.visible_edges(edges)))
    prints = cut(_prints(single, nodes))
    # a node has at most two features for each relation and type
    mine = prints.where(F.col("name") == source).select("dir", "rel", "type", F.col("n").alias("m"))
    own = mine.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("own"))
    near = single.where(F.col("src") == source).select(F.col("dst").alias("name")).union(single.where(F.col("dst") == source).select("src"))
    # dot product and norm of every other node in one pass
    met = prints.where(F.col("name") != source).join(F.broadcast(mine), ["dir", "rel", "type"], "left").groupBy("name").agg(
        F.sum(F.col("n") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.array_sort(F.collect_set(F.when(F.col("m").isNotNull(), F.col("rel")))).alias("shared"))
    found = met.where("dot > 0").join(near, "name", "left_anti").join(F.broadcast(own), how="cross")
    found = found.withColumn("source_norm", text.normalize_name(F.lit(source))).withColumn("target_norm", text.normalize_name(F.col("name")))
    apart = (F.length("target_norm") > 0) & ~F.col("source_norm").contains(F.col("target_norm")) & ~F.col("target_norm").contains(F.col("source_norm"))
    if alike is not None:
        apart = apart & ~alike
    out = found.where(apart).withColumn("similarity", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 3)).where("similarity > 0")
    return out.orderBy(F.desc("similarity"), "name").limit(k).select(F.lit(source).alias("source"), F.col("name").alias("target"), "similarity", F.slice("shared", 1, 8).alias("shared_relations"))


def resolve_names(names: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, node): exact, else without case, else by alias (alias, canonical)."""
    exact = nodes.select(F.col("name").alias("exact"))
    folded = nodes.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("folded"))
    other = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.min("canonical").alias("canonical"))
    out = names.join(exact, names["name"] == exact["exact"], "left").join(folded, F.lower(names["name"]) == F.col("low"), "left").join(other, F.lower(names["name"]) == F.col("alias"), "left")
    return out.select(names["name"], F.coalesce("exact", "folded", "canonical").alias("node"))


def did_you_mean(nodes: DataFrame, name: str, shown: int = 5) -> DataFrame:
    return nodes.where(F.lower("name").contains(name.lower())).orderBy("name").limit(shown).select("name")


def reasoning_subgraph(edges: DataFrame, seeds: list[str], per_seed: int = 20, most_nodes: int = 140, most_lines: int = 220) -> DataFrame:
    """(from_node, relation, to_node) lines around seeds, two hops; the limits go by name, so that the same question gives the same lines."""
    spark = edges.sparkSession
    single = store.single_edges(edges)
    frame = spark.createDataFrame([(s,) for s in seeds], "start string")
    one = neighbours(edges, frame, 1)
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("node"))).where(F.col("n") <= per_seed)
    first = frame.select(F.col("start").alias("name")).union(one.select("node")).distinct()
    two = neighbours(edges, first.select(F.col("name").alias("start")), 1)
    two = two.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("node"))).where(F.col("n") <= per_seed)
    kept = first.withColumn("o", F.lit(0)).union(two.select("node", F.lit(1))).groupBy("name").agg(F.min("o").alias("o")).orderBy("o", "name").limit(most_nodes)
    lines = single.join(F.broadcast(kept.select(F.col("name").alias("src"))), "src").join(F.broadcast(kept.select(F.col("name").alias("dst"))), "dst")
    return lines.orderBy("src", "rel", "dst").limit(most_lines).select(F.col("src").alias("from_node"), F.col("rel").alias("relation"), F.col("dst").alias("to_node"))
