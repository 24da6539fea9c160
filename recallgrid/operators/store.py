"""State as append-only rows folded into current views. Every log carries seq, the order of its writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_TAGS = ("alias-candidate", "proposed", "rejected")


def fold_edges(log: DataFrame) -> DataFrame:
    """The first assertion of every (src, rel, dst); empty ends and self-edges are refused. One shuffle, combined before it."""
    named = log.where("src <> '' AND dst <> '' AND src <> dst")
    rest = [c for c in log.columns if c not in ("src", "rel", "dst", "seq")]
    first = named.groupBy("src", "rel", "dst").agg(F.min_by(F.struct("seq", *rest), "seq").alias("row"))
    return first.select("src", "rel", "dst", "row.*")


def visible_edges(edges: DataFrame, hidden: tuple[str, ...] = HIDDEN_TAGS) -> DataFrame:
    """What readers see: no hidden tags, no alias candidates; a null tag is visible."""
    return edges.where((F.col("src_tag").isNull() | ~F.col("src_tag").isin(*hidden)) & (F.col("rel") != "POSSIBLE_ALIAS"))


def seen_edges(log: DataFrame, hidden: tuple[str, ...] = HIDDEN_TAGS) -> DataFrame:
    """(src, rel, dst, seq) of the edges that are visible after the fold, without the other columns.

    An edge is hidden if its first assertion is. Two least numbers tell that, which are kept in a hash table; a first row of strings would be sorted for.
    """
    named = log.where("src <> '' AND dst <> '' AND src <> dst AND rel <> 'POSSIBLE_ALIAS'")
    first = named.groupBy("src", "rel", "dst").agg(F.min("seq").alias("seq"), F.min(F.when(F.col("src_tag").isin(*hidden), F.col("seq"))).alias("veiled"))
    return first.where("veiled IS NULL OR veiled > seq").drop("veiled")


def single_edges(edges: DataFrame) -> DataFrame:
    """At most one relation from a node to another: the one asserted last."""
    return edges.groupBy("src", "dst").agg(F.max_by("rel", "seq").alias("rel"), F.max("seq").alias("seq"))


def fold_nodes(log: DataFrame) -> DataFrame:
    """(name, type, attrs) from (name, type, attrs, seq).

    Rows with attributes replace the attributes whole, and the type if they name one; rows without set the type only where none was known.
    """
    filled = F.col("attrs").isNotNull() & (F.col("attrs") != "{}") & (F.col("attrs") != "")
    log = log.where("name <> ''")
    last = F.max_by("attrs", F.when(filled, F.col("seq"))).alias("attrs")
    strong = F.max_by("type", F.when(filled & F.col("type").isNotNull(), F.col("seq")))
    weak = F.min_by("type", F.when(F.col("type").isNotNull(), F.col("seq")))
    return log.groupBy("name").agg(F.coalesce(strong, weak).alias("type"), last)


def ends(edges: DataFrame) -> DataFrame:
    """(name) of all ends of edges, each once, in one pass over them."""
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type): listed nodes and all ends of visible edges; unknown types read as concept. Ends are made distinct before types are looked at."""
    rest = ends(edges).select("name", F.lit(None).cast("string").alias("type"))
    return nodes.select("name", "type").union(rest).groupBy("name").agg(F.coalesce(F.max("type"), F.lit("concept")).alias("type"))


def latest(log: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """The last row of every key; keys whose last row is a tombstone are gone. One aggregate, no sort."""
    rest = [c for c in log.columns if c != key]
    out = log.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("row")).select(key, "row.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def without_tag(edges: DataFrame, tag: str) -> DataFrame:
    """Edges without those of a tag. Rejections keep proposals from coming back, so they cannot be deleted."""
    if tag == "rejected":
        raise ValueError("rejected rows block their key and stay")
    return edges.where(F.col("src_tag").isNull() | (F.col("src_tag") != tag))


def retag(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Applies the last review event (src, rel, dst, tag, seq) of every edge; a rejected edge stays rejected."""
    last = events.groupBy("src", "rel", "dst").agg(F.max_by("tag", "seq").alias("tag"))
    tag = F.when(F.col("src_tag") == "rejected", F.col("src_tag")).otherwise(F.coalesce("tag", "src_tag"))
    return edges.join(last, ["src", "rel", "dst"], "left").withColumn("src_tag", tag).drop("tag")


def merged_names(merges: list[tuple[str, str, int]]) -> dict[str, str]:
    """Where each merged name ended up, from approvals (loser, winner, seq) in their order. People make them, so they are few."""
    to: dict[str, str] = {}
    for loser, winner, _ in sorted(merges, key=lambda m: m[2]):
        winner = to.get(winner, winner)
        if loser != winner:
            to.pop(winner, None)
            to = {k: winner if v == loser else v for k, v in to.items()} | {loser: winner}
    return to


def apply_merges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after names (name, now) were merged: ends are re-pointed, alias edges of a pair and other self-edges drop, on collision the row that was there before stays."""
    out = edges.withColumn("moved", F.lit(False))
    for end in ("src", "dst"):
        hit = merges.select(F.col("name").alias(end), "now")
        out = out.join(F.broadcast(hit), end, "left").withColumn("moved", F.col("moved") | F.col("now").isNotNull()).withColumn(end, F.coalesce("now", end)).drop("now")
    rest = [c for c in edges.columns if c not in ("src", "rel", "dst")]
    first = out.where("src <> dst").groupBy("src", "rel", "dst").agg(F.min_by(F.struct(*rest), F.struct("moved", "seq")).alias("row"))
    return first.select("src", "rel", "dst", *[F.col(f"row.{c}").alias(c) for c in rest]).select(*edges.columns)


def apply_node_merges(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Nodes after names were merged: attributes together, the winner's win; its type, unless that is unknown or concept and a loser has another; losers go."""
    named = nodes.join(F.broadcast(merges), "name", "left").select(F.coalesce("now", "name").alias("name"), F.col("now").isNotNull().alias("lost"), "type", "attrs", F.col("name").alias("was"))
    own = named.groupBy("name").agg(
        F.max(F.when(~F.col("lost"), F.nullif("type", F.lit("concept")))).alias("own"), F.min_by("type", F.when(F.col("lost") & F.col("type").isNotNull() & (F.col("type") != "concept"), F.col("was"))).alias("lent"),
        F.array_sort(F.collect_list(F.when(F.col("attrs").isNotNull(), F.struct((~F.col("lost")).alias("last"), "was", "attrs")))).alias("maps"),
        F.max(F.when(~F.col("lost"), F.col("attrs"))).alias("kept"), F.bool_or("lost").alias("merged"), F.max(F.when(~F.col("lost"), F.col("type"))).alias("said"))
    joined = F.aggregate("maps", F.create_map().cast("map<string,string>"), lambda m, x: merge_attrs(F.coalesce(F.from_json(x.attrs, "map<string,string>"), F.create_map().cast("map<string,string>")), m))
    attrs = F.when(F.col("merged") & (F.size(joined) > 0), F.to_json(joined)).otherwise(F.col("kept"))
    return own.select("name", F.coalesce("own", "lent", "said").alias("type"), attrs.alias("attrs"))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that an older table lacks; columns that exist stay."""
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})


def stamp_source(facts: DataFrame, stamps: DataFrame) -> DataFrame:
    """Sets source_ref where it is empty, to the first stamp (fact_id, source_ref, seq)."""
    first = stamps.where("source_ref <> ''").groupBy("fact_id").agg(F.min_by("source_ref", "seq").alias("stamp"))
    empty = F.coalesce(F.col("source_ref"), F.lit("")) == ""
    return facts.join(first, "fact_id", "left").withColumn("source_ref", F.when(empty, F.coalesce("stamp", F.lit(""))).otherwise(F.col("source_ref"))).drop("stamp")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def retain(log: DataFrame, as_of: str, days: int, column: str = "ts") -> DataFrame:
    return log.where(F.col(column) >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS"))


def prune_vectors(have: DataFrame, want: DataFrame, owned: tuple[str, ...]) -> DataFrame:
    """Vectors minus those with an owned prefix whose source is gone."""
    mine = F.lit(False)
    for prefix in owned:
        mine = mine | F.col("vid").startswith(prefix)
    gone = have.where(mine).join(want.select("vid"), "vid", "left_anti").select("vid")
    return have.join(gone, "vid", "left_anti")


def bump_retrieval(facts: DataFrame, shown: DataFrame) -> DataFrame:
    """retrieval_count plus one for every call (call, fact_id) that showed the fact, however often within the call."""
    n = shown.where("fact_id IS NOT NULL").select("call", "fact_id").distinct().groupBy("fact_id").agg(F.count("*").alias("bumps"))
    return facts.join(n, "fact_id", "left").withColumn("retrieval_count", F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("bumps", F.lit(0))).drop("bumps")


def merge_nodes(edges: DataFrame, loser: str, winner: str) -> DataFrame:
    """Edges after two nodes become one: alias edges of the pair go, ends are re-pointed, on collision the row that was there before stays, self-edges drop."""
    pair = F.col("src").isin(loser, winner) & F.col("dst").isin(loser, winner) & (F.col("rel") == "POSSIBLE_ALIAS")
    moved = F.col("src").isin(loser) | F.col("dst").isin(loser)
    to = lambda c: F.when(F.col(c) == loser, F.lit(winner)).otherwise(F.col(c))
    out = edges.where(~pair).withColumn("moved", moved).withColumn("src", to("src")).withColumn("dst", to("dst")).where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy("moved", "seq"))
    return out.withColumn("rank", rank).where("rank = 1").drop("rank", "moved")


def merge_attrs(winner: Column, loser: Column) -> Column:
    """Two attribute maps; the winner's values win."""
    rest = F.map_filter(loser, lambda k, v: ~F.map_contains_key(winner, k))
    return F.map_concat(winner, rest)


def spread(rows: DataFrame, per_task: int = 20_000) -> DataFrame:
    """rows in parts of about per_task each, for work that costs much a row: a narrow table is few bytes, so the reader makes few tasks of it."""
    return rows.repartition(max(1, -(-rows.count() // per_task)))
