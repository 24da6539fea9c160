"""Scheduled upkeep: the canonicalizing graph writer, vectors for new facts, type repairs and report counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text

from . import graph, relations, resolve

NODE_HINTS = ("company", "document", "event", "idea", "job", "location", "person", "project")
JOB_RELATIONS = ("APPLIED_TO", "HIRING", "POSTED_ON")
JOB_TITLE = r"(?i)\b(?:" + "|".join(sorted("manager engineer consultant recruiter director scientist developer designer architect technician analyst intern lead".split())) + r")\b"


def embedder(embed: Callable[[list[str]], list[list[float]]]):
    """A column function over texts that calls embed once a batch; the function is loaded once a task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embed(texts.fillna("").tolist()))

    return run


def missing_vectors(facts: DataFrame, vids: DataFrame) -> DataFrame:
    """Facts that have no vector yet; changed texts keep the vector they have."""
    return facts.withColumn("vid", text.vector_id("holo_fact_", F.col("fact_id"))).join(vids.select("vid"), "vid", "left_anti")


def unprocessed(facts: DataFrame, done: DataFrame, size: int = 25) -> DataFrame:
    """The next facts to mine, in order. Empty facts are left out before the cut, so that they never block the queue."""
    return facts.where("content IS NOT NULL AND trim(content) <> ''").join(done.select("fact_id"), "fact_id", "left_anti").orderBy("fact_id").limit(size)


def gists(facts: DataFrame, found: DataFrame, shown: int = 120) -> DataFrame:
    """(fact_id, gist): what a summarizer found, else the beginning of the fact."""
    return facts.join(found, "fact_id", "left").select("fact_id", F.coalesce("gist", F.substring("content", 1, shown)).alias("gist"))


def vectorize(facts: DataFrame, vids: DataFrame, embed: Callable[[list[str]], list[list[float]]], seq: int) -> DataFrame:
    """Vector rows of facts that have none yet; the facts are embedded in batches, changed texts keep what they have."""
    new = missing_vectors(facts.where("content IS NOT NULL AND trim(content) <> ''"), vids)
    return new.select("vid", F.col("content").alias("text"), F.lit("facts").alias("source"), F.coalesce("category", F.lit("general")).alias("type"), embedder(embed)(F.col("content")).alias("embedding"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone"))


def gist_vectors(gists: DataFrame, facts: DataFrame, operational: tuple[str, ...], embed: Callable[[list[str]], list[list[float]]], seq: int) -> DataFrame:
    """The text is the fact's, the embedding the gist's; facts of operational categories get none."""
    rows = gists.join(facts, "fact_id").where(~F.coalesce("category", F.lit("")).isin(*operational))
    return rows.select(text.vector_id("gist_", F.col("fact_id")).alias("vid"), F.col("content").alias("text"), F.lit("gists").alias("source"), F.coalesce("category", F.lit("general")).alias("type"), embedder(embed)(F.col("gist")).alias("embedding"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone"))


#: Names that one task may resolve in order; more go through the order-free rule.
IN_ORDER_NAMES = 20_000


def write_graph(nodes: DataFrame, edges: DataFrame, seq: int, at_scale: bool | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for the node and edge logs and the entity index, from extracted nodes (name, type, attrs) and edges (src, rel, dst, source_ref).

    Names go to their canonical spelling, relations to the vocabulary; near misses become edges for review. The ordered rule is for
    as many names as fit in a task, unless at_scale says otherwise. seq is the first number of the batch: rows get it and up to a second's worth more.
    """
    hint = F.when(F.col("type").isin(*NODE_HINTS), F.col("type"))
    said = nodes.select("name", hint.alias("type"), F.lit(0).alias("o")).union(edges.select("src", F.lit(None).cast("string"), F.lit(1))).union(edges.select("dst", F.lit(None).cast("string"), F.lit(1)))
    names = said.where("trim(name) <> ''").groupBy(F.trim("name").alias("name")).agg(F.max("type").alias("type"), F.min("o").alias("o"))
    # listed nodes come before the ends of edges, then by name, so that a batch resolves the same way each time
    numbered = names.orderBy("o", "name").withColumn("seq", F.monotonically_increasing_id() + 1)
    records = graph.cut(numbered.select("seq", "name", *[F.lit(None).cast("string").alias(c) for c in ("domain", "email", "phone")], "type"))
    if at_scale is None:
        known = 0 if index is None else index.limit(IN_ORDER_NAMES + 1).count()
        at_scale = records.limit(IN_ORDER_NAMES + 1).count() + known > IN_ORDER_NAMES
    found = graph.cut(resolve.resolve_at_scale(records, index=index) if at_scale else resolve.resolve_in_order(records, index))
    to = found.select("name", "canonical")
    stamp = F.lit(seq).cast("long")
    # rows of a batch keep an order of their own, the same each time
    placed = lambda *c: stamp + F.pmod(F.xxhash64(*c), F.lit(1_000_000))
    node_rows = nodes.join(to.withColumnRenamed("name", "said"), F.trim("name") == F.col("said")).select(F.col("canonical").alias("name"), F.coalesce("type", F.lit("concept")).alias("type"), "attrs", stamp.alias("seq"))
    ends = edges.join(to.select(F.col("name").alias("s"), F.col("canonical").alias("sc")), F.trim("src") == F.col("s")).join(to.select(F.col("name").alias("d"), F.col("canonical").alias("dc")), F.trim("dst") == F.col("d"))
    mapped = relations.canonical_edges(ends.select(F.col("sc").alias("src"), F.trim("rel").alias("rel"), F.col("dc").alias("dst"), "source_ref"))
    edge_rows = mapped.select("src", "rel", "dst", F.lit("ingest").alias("src_tag"), "source_ref", F.substring("rel_orig", 1, 60).alias("rel_orig"), placed("src", "rel", "dst", "source_ref").alias("seq"))
    near = resolve.candidate_edges(found).where("src <> dst").select("src", "rel", "dst", "src_tag", F.lit("").alias("source_ref"), F.lit("").alias("rel_orig"), placed("src", "rel", "dst").alias("seq"))
    return node_rows, edge_rows.union(near), resolve.new_keys(records, found, seq)


def job_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of idea nodes that are jobs: at an end of a job relation, or with a job title."""
    ends = edges.where(F.col("rel").isin(*JOB_RELATIONS))
    ends = ends.select(F.col("src").alias("name")).union(ends.select("dst")).distinct().withColumn("piped", F.lit(True))
    ideas = nodes.where("type = 'idea'").join(ends, "name", "left")
    return ideas.where(F.coalesce("piped", F.lit(False)) | F.col("name").rlike(JOB_TITLE)).select("name")


def bank_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce("category", F.lit("general")).alias("bank")).agg(F.count("*").alias("facts"))


def change_key(facts: DataFrame) -> DataFrame:
    """What a cache over all facts depends on: number of rows, last id, last change."""
    return facts.agg(F.count("*").alias("n"), F.max("fact_id").alias("last_id"), F.max("updated_at").alias("last_change"))


def clusters_due(clusters: DataFrame, shown: int = 6) -> DataFrame:
    """The clusters to write in a run, largest first."""
    return clusters.orderBy(F.desc(F.size("members")), "signature").limit(shown)


def name_clusters(clusters: DataFrame, facts: DataFrame, summarize: Callable[[list[str]], str]) -> DataFrame:
    """(signature, members, summary); summarize is called on the executors, with the members' texts in order."""
    texts = clusters.select("signature", "members", F.explode("members").alias("fact_id")).join(facts.select("fact_id", "content"), "fact_id")
    gathered = texts.groupBy("signature", "members").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "content"))), lambda x: x.content).alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"signature": frame["signature"], "members": frame["members"], "summary": [summarize([t[:280] for t in texts]) for texts in frame["texts"]]})

    return gathered.mapInPandas(run, "signature string, members array<long>, summary string")
