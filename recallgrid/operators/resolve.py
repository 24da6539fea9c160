"""Entity resolution: identity keys first, then names that nearly agree.

``resolve_in_order`` keeps the exact rule, in which earlier names decide what later ones meet; it is sequential by nature and runs as one
group. ``resolve_at_scale`` is order-free: exact keys join to components, then names are compared within blocks of equal type and first letter.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import text

from . import graph

MERGE, CANDIDATE = 0.92, 0.85


@F.pandas_udf(T.DoubleType())
def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity; the order of the arguments matters: new name first."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def keyed(records: DataFrame) -> DataFrame:
    """(seq, name, type, norm, display, keys) from (seq, name, domain, email, phone, type)."""
    out = records.withColumn("norm", text.normalize_name(F.col("name"))).withColumn("display", text.display_name(F.col("name")))
    return out.select("seq", "name", "type", "norm", "display", text.merge_keys(F.col("norm"), F.col("domain"), F.col("email"), F.col("phone")).alias("keys"))


def _in_order(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    owner: dict[str, str] = {}
    known: dict[str, dict] = {}
    for r in index.sort_values(["seq", "key"], kind="stable").itertuples():
        owner[r.key] = r.canonical
        entry = known.setdefault(r.canonical, {"type": None, "norm": r.norm, "keys": []})
        entry["type"] = entry["type"] or (r.type if isinstance(r.type, str) and r.type else None)
        entry["keys"].append(r.key)
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples():
        keys, kind = list(r.keys), r.type if isinstance(r.type, str) and r.type else None
        if not r.norm:
            out.append((r.seq, r.name, r.display, None, None))
            continue
        hit, near = next((owner[k] for k in keys if k in owner), None), (None, None)
        if hit is None:
            domains = {k for k in keys if k.startswith("domain:")}
            best, found = 0.0, None
            for name, entry in known.items():
                if kind and entry["type"] and entry["type"] != kind or not entry["norm"] or entry["norm"][0] != r.norm[0]:
                    continue
                theirs = {k for k in entry["keys"] if k.startswith("domain:")}
                if domains and theirs and not domains & theirs:
                    continue
                score = difflib.SequenceMatcher(None, r.norm, entry["norm"]).ratio()
                if score > best:
                    best, found = score, name
            if found and best >= MERGE:
                hit = found
            elif found and best >= CANDIDATE:
                near = found, round(best, 3)
        target = hit or r.display
        entry = known.setdefault(target, {"type": kind, "norm": r.norm, "keys": []})
        entry["type"] = entry["type"] or kind
        for k in keys:
            owner[k] = target
            if k not in entry["keys"]:
                entry["keys"].append(k)
        out.append((r.seq, r.name, target, *near))
    return pd.DataFrame(out, columns=["seq", "name", "canonical", "candidate", "score"])


INDEX = "key string, canonical string, type string, seq long"


def _index(records: DataFrame, index: DataFrame | None) -> DataFrame:
    """The entity index (key, canonical, type, seq) with the last meaning of every key, and the normal form of what it stands for."""
    if index is None:
        index = records.sparkSession.createDataFrame([], INDEX)
    last = index.groupBy("key").agg(F.max_by(F.struct("canonical", "type", "seq"), "seq").alias("row")).select("key", "row.*")
    return last.withColumn("norm", text.normalize_name(F.col("canonical")))


def resolve_in_order(records: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(seq, name, canonical, candidate, score); candidate names a near miss for review. index holds what earlier batches resolved."""
    rows = keyed(records).select("seq", "name", "type", "norm", "display", "keys").withColumn("all", F.lit(0))
    known = _index(records, index).withColumn("all", F.lit(0))
    return rows.groupBy("all").cogroup(known.groupBy("all")).applyInPandas(lambda a, b: _in_order(a, b), "seq long, name string, canonical string, candidate string, score double")


def new_keys(records: DataFrame, resolved: DataFrame, seq: int) -> DataFrame:
    """The index rows of a batch: every key of every record stands for what the record resolved to, the first record of a key decides."""
    rows = keyed(records).select("seq", "type", F.explode("keys").alias("key")).join(resolved.select("seq", "canonical"), "seq")
    first = rows.groupBy("key").agg(F.min_by(F.struct("canonical", "type"), "seq").alias("row"))
    return first.select("key", "row.canonical", "row.type", F.lit(seq).cast("long").alias("seq"))


#: Letters from rare to frequent; two names that nearly agree share one of the rarest.
RARE = "0123456789zqxjkvbpygfwmucldrhsnioate "


def _letters(norm):
    """The letters of a name as distinct tokens, the second s apart from the first, rare ones first."""
    spelled = F.split(norm, "")
    counted = F.transform(spelled, lambda c, i: F.struct(F.position(c, F.lit(RARE)).alias("rank"), c.alias("c"), F.size(F.filter(F.slice(spelled, 1, i + 1), lambda x: x == c)).alias("n")))
    return F.transform(F.array_sort(F.filter(counted, lambda x: x.c != "")), lambda x: F.concat(x.c, x.n.cast("string")))


def resolve_at_scale(records: DataFrame, merge: float = MERGE, index: DataFrame | None = None, candidate: float = CANDIDATE) -> DataFrame:
    """(seq, name, canonical, candidate, score): an order-free approximation of the rule above. The earliest record of a component names it.

    A ratio of r means that two names have at least r (m + n) / 2 letters in common. So both have one of the rarest letters of the other among
    their own, beside the first letter that the rule asks for: names meet on these, few of them agree on that many letters, and only
    for those the ratio is taken.
    """
    floor = min(merge, candidate)
    rows = keyed(records)
    if index is not None:
        # entries of the index come before all records, in their order
        old = _index(records, index).where("norm <> ''").groupBy("canonical", "norm").agg(F.max("type").alias("type"), F.array_sort(F.collect_list("key")).alias("keys"))
        old = old.select(F.xxhash64("canonical").bitwiseOR(F.lit(-(2**63)).cast("long")).alias("seq"), F.col("canonical").alias("name"), "type", "norm", F.col("canonical").alias("display"), "keys")
        rows = rows.select(*old.columns).union(old)
    keys = rows.where("norm <> ''").select("seq", "type", "norm", "keys", F.explode("keys").alias("key"))
    lead = keys.groupBy("key").agg(F.min("seq").alias("a"))
    exact = keys.join(lead, "key").select("a", F.col("seq").alias("b"))
    names = rows.where("norm <> ''").groupBy(F.coalesce("type", F.lit("")).alias("type"), "norm").agg(F.min("seq").alias("seq"), F.array_distinct(F.flatten(F.collect_list(F.filter("keys", lambda k: k.startswith("domain:"))))).alias("domains"))
    # of n letters at least floor / (2 - floor) n are shared, so one of the first n - that + 1 is
    names = names.withColumn("letters", _letters(F.col("norm"))).withColumn("first", F.substring("norm", 1, 1))
    prefix = F.slice("letters", 1, F.size("letters") - F.ceil(F.lit(floor / (2 - floor)) * F.size("letters") - 1e-9).cast("int") + 1)
    block = names.select("*", F.explode(prefix).alias("letter"))
    x, y = (block.select("first", "letter", *[F.col(c).alias(f"{c}_{p}") for c in ("type", "norm", "seq", "domains", "letters")]) for p in "ab")
    typed = (F.col("type_a") == F.col("type_b")) | (F.col("type_a") == "") | (F.col("type_b") == "")
    free = (F.size("domains_a") == 0) | (F.size("domains_b") == 0) | F.arrays_overlap("domains_a", "domains_b")
    # a ratio of r needs lengths within a factor of (2 - r) / r
    sized = F.least(F.length("norm_a"), F.length("norm_b")) * (2 - floor) >= F.greatest(F.length("norm_a"), F.length("norm_b")) * floor
    met = x.join(y, ["first", "letter"]).where((F.col("seq_a") < F.col("seq_b")) & typed & free & sized)
    met = met.where(2.0 * F.size(F.array_intersect("letters_a", "letters_b")) >= floor * (F.size("letters_a") + F.size("letters_b")) - 1e-9)
    met = met.select("seq_a", "seq_b", "norm_a", "norm_b").distinct()
    near = graph.cut(met.withColumn("score", ratio("norm_b", "norm_a")).where(F.col("score") >= floor))
    labels = graph.components(exact.where("a <> b").union(near.where(F.col("score") >= merge).select("seq_a", "seq_b")))
    placed = rows.join(labels, rows["seq"] == labels["node"], "left").withColumn("lead", F.coalesce("label", "seq"))
    first = rows.select(F.col("seq").alias("lead"), F.col("display").alias("canonical"))
    named = placed.join(first, "lead").select("seq", "name", "canonical")
    # near misses between names that were not merged are for review: the best one of each
    missed = near.where(F.col("score") < merge).join(named.select(F.col("seq").alias("seq_a"), F.col("canonical").alias("candidate")), "seq_a").join(named.select(F.col("seq").alias("seq_b"), F.col("canonical").alias("own")), "seq_b")
    best = missed.where("candidate <> own").groupBy(F.col("seq_b").alias("seq")).agg(F.max_by(F.struct("candidate", F.round("score", 3).alias("score")), F.struct("score", "seq_a")).alias("best"))
    out = named.join(best, "seq", "left").select("seq", "name", "canonical", "best.candidate", "best.score")
    return out if index is None else out.join(records.select("seq"), "seq", "left_semi")


def alias_map(keys: DataFrame) -> DataFrame:
    """(alias, canonical) of name keys of four letters or more, from (key, canonical); with seq too, the last meaning of a key holds."""
    if "seq" in keys.columns:
        last = keys.groupBy("key").agg(F.max_by("canonical", "seq").alias("canonical"), F.min("seq").alias("seq"))
        return last.where(F.col("key").startswith("norm:")).select(F.expr("substring(key, 6)").alias("alias"), "canonical", "seq").where(F.length("alias") >= 4)
    return keys.where(F.col("key").startswith("norm:")).select(F.expr("substring(key, 6)").alias("alias"), "canonical").where(F.length("alias") >= 4)


def add_alias(keys: DataFrame, variant: str, canonical: str) -> DataFrame:
    """Keys with a curated variant; it replaces what the key meant before."""
    new = keys.sparkSession.range(1).select(F.concat(F.lit("norm:"), text.normalize_name(F.lit(variant))).alias("key"), F.lit(canonical).alias("canonical")).where("key <> 'norm:'")
    return keys.join(new.select("key"), "key", "left_anti").select("key", "canonical").union(new)


def known_entities(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (fact_id, content, names) with names tidied, and after them what capitalised words of the content stand for in the alias map, each once."""
    words = facts.select("fact_id", F.posexplode(text.capitalised_words(F.col("content"))).alias("at", "word"))
    met = words.withColumn("alias", text.normalize_name(F.col("word"))).join(aliases.select("alias", "canonical"), "alias")
    found = met.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical"))), lambda x: x.canonical).alias("more"))
    none = F.array().cast("array<string>")
    out = facts.join(found, "fact_id", "left").withColumn("names", text.tidy_entities(F.col("names")))
    return out.withColumn("names", text.first_of_each(F.concat("names", F.coalesce("more", none)))).drop("more")


def candidate_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("candidate IS NOT NULL").select(F.col("canonical").alias("src"), F.lit("POSSIBLE_ALIAS").alias("rel"), F.col("candidate").alias("dst"), F.lit("alias-candidate").alias("src_tag"), "score")


def entity_types(entities: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, name, entity_type) of untyped entities whose node, under the canonical name or else the raw one, has a type."""
    open_ = entities.where("entity_type = 'unknown' OR entity_type IS NULL")
    types = nodes.where("type IS NOT NULL").groupBy(F.lower("name").alias("low")).agg(F.max("type").alias("type"))
    known = aliases.select(F.col("alias"), F.lower("canonical").alias("canonical"))
    step = open_.join(known, text.normalize_name(F.col("name")) == F.col("alias"), "left")
    step = step.join(types.withColumnRenamed("type", "t1"), F.col("canonical") == F.col("low"), "left").drop("low")
    step = step.join(types.withColumnRenamed("type", "t2"), F.lower("name") == F.col("low"), "left")
    return step.select("entity_id", "name", F.coalesce("t1", "t2").alias("entity_type")).where("entity_type IS NOT NULL")
