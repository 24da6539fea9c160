"""Duplicates, junk and clusters of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text

from . import graph

PAIR_CAP, HUB_FACTS = 50, 15
SMALLEST, LARGEST, AGE_DAYS = 3, 12, 7


def duplicates(facts: DataFrame) -> DataFrame:
    """(fact_id, keeper): every fact whose text, without case and spacing, a better fact has: more helpful, more retrieved, more trusted, older.

    Texts meet by a 128-bit digest, so that no text is sorted or shuffled.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = facts.select("fact_id", text.squeeze(F.col("content")).alias("t"), (-zero("helpful_count")).alias("h"), (-zero("retrieval_count")).alias("r"), (-zero("trust_score")).alias("s")).where("t <> ''")
    keyed = one.select("fact_id", F.md5("t").alias("key"), F.struct("h", "r", "s", "fact_id").alias("rank"))
    best = F.min("rank").over(Window.partitionBy("key"))
    return keyed.select("fact_id", best["fact_id"].alias("keeper")).where("fact_id <> keeper")


def archive(facts: DataFrame, default_trust: float = 0.5) -> DataFrame:
    """(fact_id, reason): duplicates first, then junk that nobody ever used."""
    double = duplicates(facts).select("fact_id", F.lit("duplicate").alias("reason"))
    junk = facts.where(text.is_junk(F.col("content")) & ~text.is_protected(F.col("retrieval_count"), F.col("helpful_count"), F.col("trust_score"), default_trust))
    return double.union(junk.join(double, "fact_id", "left_anti").select("fact_id", F.lit("junk:call-transcript").alias("reason")))


def apply_archive(facts: DataFrame, entities: DataFrame, gone: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the rows to be archived as JSON lines, then returns the facts and links that stay. The archive is written before anything goes."""
    facts.join(gone, "fact_id").write.mode("append").json(path)
    return facts.join(gone, "fact_id", "left_anti"), entities.join(gone, "fact_id", "left_anti")


def eligible(facts: DataFrame, members: DataFrame, as_of: str, age_days: int = AGE_DAYS) -> DataFrame:
    """Facts old enough that are no chunk and in none. A null category fails the comparison and is left out."""
    old = facts.where((F.col("category") != "chunk") & (F.col("created_at") <= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {age_days} DAYS")))
    return old.join(members.select(F.col("member_fact_id").alias("fact_id")), "fact_id", "left_anti").join(members.select(F.col("chunk_fact_id").alias("fact_id")), "fact_id", "left_anti")


#: Pairs that one task of shared_pairs counts.
TASK_PAIRS = 500_000


def shared_pairs(links: DataFrame, cap: int = PAIR_CAP, hub: int = HUB_FACTS) -> DataFrame:
    """(a, b, shared, small) of facts with a common entity; entities of 2 to cap facts count, small tells that one has at most hub.

    Group sizes are filtered before facts are gathered, so a hub never makes pairs. A fact goes to its task beside the lists of those it meets,
    and pairs are made and counted there: as many tasks as make TASK_PAIRS each, whatever the size of the input.
    """
    links = graph.cut(links.select("entity_id", "fact_id").where("entity_id IS NOT NULL AND fact_id IS NOT NULL"))
    sizes = links.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap))
    total = sizes.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    # explicit numbers, which adaptive execution keeps
    tasks = max(1, min(50_000, int(total // TASK_PAIRS) + 1))
    kept = links.repartition(tasks, "entity_id").join(sizes.repartition(tasks, "entity_id"), "entity_id")
    groups = kept.groupBy("entity_id").agg(F.collect_list("fact_id").alias("facts"), (F.first("n") <= hub).alias("small"))
    met = groups.select("facts", "small", F.explode("facts").alias("a")).select("a", "small", F.filter("facts", lambda f: f > F.col("a")).alias("to")).where("size(to) > 0")
    pairs = met.repartition(tasks, "a").select("a", "small", F.explode("to").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.bool_or("small").alias("small"))


def clusters(links: DataFrame, used: DataFrame | None = None, cap: int = PAIR_CAP, hub: int = HUB_FACTS, smallest: int = SMALLEST, largest: int = LARGEST) -> DataFrame:
    """(signature, members): facts tied by two common entities or one small one, in groups of fitting size that were not written before (used: signature)."""
    ties = shared_pairs(links, cap, hub).where("shared >= 2 OR small").select("a", "b")
    labels = graph.components(ties)
    # sizes first: a component of any size is counted, but only fitting ones are gathered
    fitting = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n").between(smallest, largest)).select("label")
    groups = labels.join(fitting, "label").groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members"))
    out = groups.select(text.cluster_signature(F.col("members")).alias("signature"), "members")
    return out.join(used, "signature", "left_anti") if used is not None else out


def entity_names(links: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, name) of the entities of some facts."""
    return links.join(facts.select("fact_id"), "fact_id", "left_semi").join(entities, "entity_id").select("fact_id", "name")


def cluster_entities(cluster: DataFrame, links: DataFrame, entities: DataFrame, shown: int = 6) -> DataFrame:
    """(signature, name, n): the entities that most members of a cluster share."""
    members = cluster.select("signature", F.explode("members").alias("fact_id"))
    n = members.join(links, "fact_id").join(entities, "entity_id").groupBy("signature", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("n"), "name"))
    return n.withColumn("rank", rank).where(F.col("rank") <= shown).drop("rank")


def write_chunk_rows(cluster: DataFrame, first_id: int) -> dict[str, DataFrame]:
    """The rows that new chunks (signature, title, summary, members, names) add: a fact, its members, an episode node with the title and edges to its entities.

    A run writes few chunks, so they are numbered in one place.
    """
    numbered = cluster.withColumn("chunk_fact_id", F.lit(first_id) + F.row_number().over(Window.orderBy("signature")))
    return {
        "facts": numbered.select(F.col("chunk_fact_id").alias("fact_id"), F.col("summary").alias("content"), F.lit("chunk").alias("category"), F.concat(F.lit("chunk,sig:"), F.col("signature")).alias("tags")),
        "chunk_members": numbered.select("chunk_fact_id", F.explode("members").alias("member_fact_id")),
        "nodes": numbered.select(F.col("title").alias("name"), F.lit("episode").alias("type"), F.to_json(F.struct("chunk_fact_id")).alias("attrs")),
        "edges": numbered.select(F.col("title").alias("src"), F.lit("INVOLVES").alias("rel"), F.explode("names").alias("dst"), F.lit("chunk").alias("src_tag")),
    }


def expand_chunk(members: DataFrame, facts: DataFrame, chunk: int) -> DataFrame:
    return members.where(F.col("chunk_fact_id") == chunk).join(facts, F.col("member_fact_id") == F.col("fact_id")).select("chunk_fact_id", "fact_id", "content", "category", "trust_score")


def dead_gists(gists: DataFrame, facts: DataFrame) -> DataFrame:
    return gists.join(facts.select("fact_id"), "fact_id", "left_semi")


def refresh_types(vectors: DataFrame, facts: DataFrame, default: str = "general") -> DataFrame:
    """Vectors of facts take the fact's category as type; others keep theirs."""
    fid = text.fact_id_of(F.col("vid"))
    joined = vectors.join(facts.select("fact_id", "category"), fid == F.col("fact_id"), "left")
    return joined.withColumn("type", F.when(F.col("fact_id").isNull(), F.col("type")).otherwise(F.coalesce("category", F.lit(default)))).drop("fact_id", "category")
