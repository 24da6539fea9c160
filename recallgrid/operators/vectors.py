"""Exact cosine search and phase vectors, as array expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(store: DataFrame, probe: Column, k: int, key: str = "vid", column: str = "embedding") -> DataFrame:
    """The k nearest rows with similarity rounded to three places; ties go by key. Plans as TakeOrderedAndProject: k rows a task move."""
    exact = store.withColumn("__cosine", cosine(F.col(column), probe)).where(F.col("__cosine").isNotNull())
    nearest = exact.orderBy(F.desc("__cosine"), key).limit(k)
    return nearest.withColumn("similarity", F.round("__cosine", 3)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__cosine"), key))).drop("__cosine", column)


def recall(store: DataFrame, probe: Column, k: int = 5, floor: float = 0.25, exclude: tuple[str, ...] = (), source: bool = False) -> DataFrame:
    """Recall: over-fetch min(k + 12, 40), then drop excluded types and later rows of equal text, cut to k, then apply the floor.

    The filter stays above the cut on purpose: with many excluded rows nearby the answer may be shorter than k.
    """
    k = max(1, min(int(k), 15))
    near = top_k(store, probe, min(k + 12, 40))
    kept = near.where(~F.coalesce("type", F.lit("")).isin(*exclude)) if exclude else near
    key = text.dedupe_key(F.col("text"))
    first = kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("__n = 1")
    cut = first.orderBy("rank").limit(k).where(F.col("similarity") >= floor)
    out = cut.select("vid", "text", "type", "similarity", *(["source"] if source and "source" in store.columns else []))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vid")))


def situations(store: DataFrame, probe: Column, floor: float = 0.42, reach: int = 24, shown: int = 2) -> DataFrame:
    near = top_k(store, probe, reach)
    return near.where((F.col("type") == "situation") & (F.col("similarity") >= floor)).orderBy("rank").limit(shown)


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def phase_similarity(a: Column, b: Column) -> Column:
    """Mean cosine of the phase differences, scaled to 0..1."""
    return (F.aggregate(F.zip_with(a, b, lambda x, y: F.cos(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a) + 1) / 2


def atom(name: Column, width: int) -> Column:
    """Ours: the phases of a word, from hashes of the word and the dimension."""
    turn = 2 * 3.141592653589793
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(F.xxhash64(name, i), F.lit(1_000_003)) / 1_000_003.0 * turn)


def encode(words: Column, width: int) -> Column:
    """Ours: the circular mean of the words' atoms. No words give zero phases."""
    zero = F.array_repeat(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), width)
    summed = F.aggregate(words, zero, lambda s, w: F.zip_with(s, atom(w, width), lambda p, a: F.struct((p.x + F.cos(a)).alias("x"), (p.y + F.sin(a)).alias("y"))))
    return F.transform(summed, lambda p: F.atan2(p.y, p.x))


def probe_phases(query: Column, width: int) -> Column:
    """The phases of a query: of its content words, or of all words where nothing is left."""
    bare = text.content_words(query)
    return encode(F.filter(F.split(F.when(bare != "", bare).otherwise(F.lower(query)), " "), lambda w: w != ""), width)


def surface(store: DataFrame, stored: DataFrame, probe: Column | None, query_tokens: Column) -> DataFrame:
    """store (fact_id, content, ...) with surface: the cosine of the fact's vector and the probe, or where there is none the overlap of tokens."""
    words = text.jaccard(text.tokens(F.col("content")), query_tokens)
    if probe is None:
        return store.withColumn("surface", words)
    near = stored.where(F.col("vid").startswith("holo_fact_")).select(text.fact_id_of(F.col("vid")).alias("fact_id"), cosine(F.col("embedding"), probe).alias("near"))
    return store.join(near, "fact_id", "left").withColumn("surface", F.coalesce("near", words)).drop("near")


def recent_analogies(log: DataFrame, shown: int = 20) -> DataFrame:
    """The facts of the last analogies that were shown."""
    return log.where("block = 'analogy' AND fact_id IS NOT NULL").orderBy(F.desc("id")).limit(shown).select("fact_id").distinct()


def dominant_width(store: DataFrame, column: str) -> DataFrame:
    """Rows of the most frequent vector width; on ties the narrower one."""
    width = store.groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).select("w")
    return store.join(F.broadcast(width), F.size(column) == F.col("w")).drop("w")


def analogies(store: DataFrame, probe: Column, query_tokens: Column, skip: DataFrame, surface: Column | None = None, least: float = 0.5, z: float = 2.0, surface_max: float = 0.3, looks: int = 8) -> DataFrame:
    """One memory that is close in structure and far in surface, or none.

    store: fact_id, content, phases. The gate is the higher of least and mean + z deviations over the whole store (the deviation
    counts only beyond 1e-9). Of the nearest facts that are not in skip (fact_id) looks are examined.
    """
    scored = store.withColumn("sim", phase_similarity(F.col("phases"), probe))
    stats = scored.agg(F.avg("sim").alias("mu"), F.stddev_pop("sim").alias("sd"))
    gate = F.when(F.col("sd") > 1e-9, F.greatest(F.lit(least), F.col("mu") + z * F.col("sd"))).otherwise(F.lit(least))
    passed = scored.join(F.broadcast(stats), how="cross").where(F.col("sim") >= gate).join(skip, "fact_id", "left_anti")
    seen = passed.orderBy(F.desc("sim"), "fact_id").limit(looks)
    look = surface if surface is not None else text.jaccard(text.tokens(F.col("content")), query_tokens)
    near = seen.withColumn("surface", look).where(F.col("surface") <= surface_max)
    return near.withColumn("gain", F.col("sim") - F.col("surface")).orderBy(F.desc("gain"), "fact_id").limit(1).select("fact_id", F.round("sim", 3).alias("score"), F.round("surface", 3).alias("surface"), text.ellipsis(F.trim("content")).alias("content"))
