"""The queue of machine proposals: alias candidates and categories that a person accepts or rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def pending_aliases(edges: DataFrame) -> DataFrame:
    return edges.where("rel = 'POSSIBLE_ALIAS' AND src_tag = 'alias-candidate'").select("src", "dst").orderBy("src", "dst")


def pending_categories(edges: DataFrame) -> DataFrame:
    """(category, members) of proposed memberships."""
    rows = edges.where("rel = 'INSTANCE_OF' AND src_tag = 'proposed'")
    return rows.groupBy(F.col("dst").alias("category")).agg(F.array_sort(F.collect_list("src")).alias("members")).orderBy("category")


def category_nodes(groups: DataFrame, seq: int) -> DataFrame:
    """Rows for the node log: a category for every named group."""
    return groups.select("name", F.lit("category").alias("type"), F.lit('{"proposed_by":"consolidation"}').alias("attrs"), F.lit(seq).cast("long").alias("seq"))


def propose(groups: DataFrame, seq: int) -> DataFrame:
    """Edges for named groups (name, members): proposed, hidden from readers until approved."""
    return groups.select(F.explode("members").alias("src"), F.lit("INSTANCE_OF").alias("rel"), F.col("name").alias("dst"), F.lit("proposed").alias("src_tag"), F.lit(seq).cast("long").alias("seq"))


def approve_alias(edges: DataFrame, loser: str, winner: str) -> DataFrame:
    return store.merge_nodes(edges, loser, winner)


def _set(edges: DataFrame, hit, tag: str) -> DataFrame:
    return edges.withColumn("src_tag", F.when(hit, F.lit(tag)).otherwise(F.col("src_tag")))


def reject_alias(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Either direction of the pair; the rows stay, so the pair is not proposed again."""
    pair = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))
    return _set(edges, pair & (F.col("rel") == "POSSIBLE_ALIAS"), "rejected")


def alias_events(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, rel, dst, tag): the rejection of a pair, either direction."""
    pair = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))
    return edges.where(pair & (F.col("rel") == "POSSIBLE_ALIAS")).select("src", "rel", "dst", F.lit("rejected").alias("tag"))


def category_events(edges: DataFrame, category: str, tag: str) -> DataFrame:
    """(src, rel, dst, tag) for every open membership of a category: curated or rejected."""
    return edges.where(_category(category)).select("src", "rel", "dst", F.lit(tag).alias("tag"))


def _category(category: str):
    return (F.col("rel") == "INSTANCE_OF") & (F.col("dst") == category) & (F.col("src_tag") == "proposed")


def approve_category(edges: DataFrame, category: str) -> DataFrame:
    return _set(edges, _category(category), "curated")


def reject_category(edges: DataFrame, category: str) -> DataFrame:
    return _set(edges, _category(category), "rejected")


def summary(edges: DataFrame) -> DataFrame:
    """One line an open proposal; no rows if there is none."""
    aliases = pending_aliases(edges).select(F.concat(F.lit("alias: "), "src", F.lit(" = "), "dst").alias("line"))
    groups = pending_categories(edges).select(F.concat(F.lit("category: "), "category", F.lit(" <- "), F.array_join("members", ", ")))
    return aliases.union(groups)
