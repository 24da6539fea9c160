"""Assembling the context of a turn: blocks of lines in order of priority under a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text


def rolling_queries(turns: DataFrame, size: int = 3, longest: int = 300) -> DataFrame:
    """(conv_id, turn, window): the last messages of the user up to each, a repeat of the one before left out."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    cut = turns.where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", F.substring("text", 1, longest).alias("message"))
    fresh = cut.withColumn("before", F.lag("message").over(by)).where("before IS NULL OR before <> message")
    return fresh.select("conv_id", "turn", F.array_join(F.collect_list("message").over(by.rowsBetween(-(size - 1), 0)), "\n").alias("window"))


def cap_lines(lines: DataFrame, cap: int, by: list[str] | None = None) -> DataFrame:
    """Whole lines of (block, line, text, header) in order until the budget is used up; a line costs its length and one more.

    The first line that does not fit ends everything. A block of which only the header fits is dropped. A budget of 0 or less is none.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy("block", "line") if by else Window.orderBy("block", "line")
    cost = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("used", cost).where(F.lit(cap <= 0) | (F.col("used") <= cap))
    body = F.sum(F.when(F.col("header"), 0).otherwise(1)).over(Window.partitionBy(*by, "block"))
    return kept.withColumn("body", body).where("body > 0").drop("body", "used")


def suppress_chunks(shown: DataFrame, members: DataFrame) -> DataFrame:
    """Shown facts without those whose chunk is shown as well."""
    pairs = members.join(shown.select(F.col("fact_id").alias("chunk_fact_id")), "chunk_fact_id", "left_semi")
    gone = pairs.join(shown.select(F.col("fact_id").alias("member_fact_id")), "member_fact_id", "left_semi").select(F.col("member_fact_id").alias("fact_id"))
    return shown.join(gone, "fact_id", "left_anti")


def drop_cross_block(vector_hits: DataFrame, fact_lines: DataFrame) -> DataFrame:
    """Vector hits whose text neither holds nor is held by a line that is shown already, in normal form."""
    # both sides are what one turn shows, a few lines
    said = fact_lines.select(text.dedupe_key(F.col("text")).alias("said"))
    key = text.dedupe_key(F.col("text"))
    return vector_hits.join(said, key.contains(F.col("said")) | F.col("said").contains(key), "left_anti")


def mentioned_nodes(nodes: DataFrame, aliases: DataFrame, query: str, shown: int = 2) -> DataFrame:
    """Nodes named in a query, then nodes whose alias is; the first by order of entry. nodes: name, seq; aliases: alias, canonical, seq."""
    low = F.lit(query.lower())
    own = nodes.where((F.length("name") >= 4) & low.contains(F.lower("name"))).select("name", F.lit(0).alias("kind"), "seq")
    other = aliases.where((F.length("alias") >= 4) & low.contains(F.lower("alias"))).select(F.col("canonical"), F.lit(1), "seq")
    found = own.union(other).groupBy("name").agg(F.min(F.struct("kind", "seq")).alias("at"))
    return found.orderBy("at", "name").limit(shown).select("name")


def neighbour_lines(found: DataFrame, per_node: int = 6, most: int = 10) -> DataFrame:
    """Lines of (start, from_node, relation, to_node), six a node and ten in all."""
    rank = F.row_number().over(Window.partitionBy("start").orderBy("hop", "node"))
    kept = found.withColumn("rank", rank).where(F.col("rank") <= per_node).orderBy("start", "rank").limit(most)
    return kept.select("start", "rank", F.concat(F.lit("- "), "from_node", F.lit(" "), "relation", F.lit(" "), "to_node").alias("line"))


def search_facts(facts: DataFrame, query: str, least_trust: float = 0.3, shown: int = 12, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Ours: BM25 over words. Counts are taken over all facts; only words of the query are exploded."""
    asked = sorted({w for w in query.lower().split() if w})
    words = F.split(text.squeeze(F.col("content")), " ")
    docs = facts.select("fact_id", "content", "category", "trust_score", words.alias("words")).withColumn("len", F.size("words"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hits = docs.select("fact_id", "len", F.explode(F.filter("words", lambda w: w.isin(asked) if asked else F.lit(False))).alias("word")).groupBy("fact_id", "len", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.join(F.broadcast(df), "word").join(F.broadcast(stats), how="cross").groupBy("fact_id").agg(F.sum(weight).alias("score"))
    out = scored.join(docs.drop("words", "len"), "fact_id").where(F.col("trust_score") >= least_trust)
    return out.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "fact_id").limit(shown)


def prefetch_lines(blocks: list[tuple[str, DataFrame]], cap: int = 2000) -> DataFrame:
    """(block, line, text, entry_id, header) of titled blocks (rank, text, entry_id) in order, under the budget."""
    out = None
    for number, (title, rows) in enumerate(blocks):
        head = rows.limit(1).select(F.lit(number).alias("block"), F.lit(0).alias("line"), F.lit(f"## {title}").alias("text"), F.lit(None).cast("string").alias("entry_id"), F.lit(True).alias("header"))
        body = rows.select(F.lit(number).alias("block"), F.col("rank").cast("int").alias("line"), F.concat(F.lit("- "), F.regexp_replace("text", "[\r\n]+", " ")).alias("text"), F.col("entry_id").cast("string"), F.lit(False).alias("header"))
        part = head.union(body)
        out = part if out is None else out.union(part)
    return cap_lines(out, cap)
