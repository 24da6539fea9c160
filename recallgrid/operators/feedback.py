"""Trust from use: what is shown and then taken up rises, what is shown and never taken up falls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import text

from . import search
from .store import retain

STEP = 0.02
CEILING, FLOOR = 0.85, 0.35
LEAST_TURNS = 5
WINDOW_DAYS, RECENT_DAYS, KEEP_DAYS, IGNORE_DAYS = 14, 1, 60, 7
OVERLAP = 0.3


def decision_signals(decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (id, ts, session_id, turn_number, outcome, trust_applied, refs: array<long>): facts to boost, resolved turns, ids of pending ones to age out.

    A fact that several decisions name is boosted once.
    """
    open_ = decisions.where(F.col("outcome").isin("accepted", "rejected", "modified") & (F.coalesce("trust_applied", F.lit(0)) == 0))
    boost = open_.where("outcome <> 'rejected'").select(F.explode("refs").alias("fact_id")).where("fact_id IS NOT NULL AND fact_id <> 0").distinct()
    turns = open_.select("session_id", "turn_number").distinct()
    stale = decisions.where((F.col("outcome") == "pending") & (F.col("ts") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {IGNORE_DAYS} DAYS"))).select("id")
    return boost, turns, stale


def engagement(log: DataFrame, facts: DataFrame, entities: DataFrame, as_of: str, strict_turns: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """(id, fact_id, session_id, turn_number, recent, engaged) of surfacings in the window.

    Engaged: a later query of the session holds one of the fact's entities (name of four letters or more), or shares OVERLAP of its tokens.
    Later means a greater id; strict_turns asks for a later turn too. A query is looked at once a fact and session, not once a surfacing:
    the last query that engages a fact decides for all its surfacings before it. Facts and queries of a session meet where they share a token, or
    where a query holds the last four letters of a name; no session is multiplied out.
    """
    window = retain(log, as_of, WINDOW_DAYS).withColumn("session", F.coalesce("session_id", F.lit("")))
    shown = window.where("fact_id IS NOT NULL").join(facts.select("fact_id"), "fact_id", "left_semi")
    if excluded is not None:
        shown = shown.join(excluded, ["session_id", "turn_number"], "left_anti")
    asked = window.where("query <> ''").groupBy("session", "query").agg(F.max("id").alias("query_id"), F.max("turn_number").alias("query_turn"))
    asked = asked.withColumn("words", text.tokens(F.col("query"))).withColumn("low", F.lower("query"))
    pairs = shown.select("session", "fact_id").distinct()
    said = pairs.join(facts.select("fact_id", text.tokens(F.col("content")).alias("words")), "fact_id")
    said = said.select("session", "fact_id", F.size("words").alias("m"), F.explode("words").alias("word"))
    heard = asked.select("session", "query_id", "query_turn", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = said.join(heard, ["session", "word"]).groupBy("session", "fact_id", "query_id", "query_turn", "m", "n").agg(F.count("*").alias("both"))
    alike = common.where(F.col("both") / (F.col("m") + F.col("n") - F.col("both")) >= OVERLAP).select("session", "fact_id", "query_id", "query_turn")
    names = entities.where(F.length("name") >= 4).select("fact_id", F.lower("name").alias("name")).distinct()
    named = pairs.join(names, "fact_id").withColumn("end", search.ending(F.col("name")))
    parts = asked.select("session", "query_id", "query_turn", "low", F.explode(search.grams(F.col("low"))).alias("end"))
    held = named.join(parts, ["session", "end"]).where(F.col("low").contains(F.col("name"))).select("session", "fact_id", "query_id", "query_turn")
    last = alike.union(held).groupBy("session", "fact_id").agg(F.max("query_id").alias("last_id"), F.max("query_turn").alias("last_turn"))
    out = shown.join(last, ["session", "fact_id"], "left")
    later = F.col("last_id") > F.col("id")
    if strict_turns:
        later = later & (F.col("last_turn") > F.col("turn_number"))
    recent = F.col("ts") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {RECENT_DAYS} DAYS")
    return out.select("id", "fact_id", "session_id", "turn_number", recent.alias("recent"), F.coalesce(later, F.lit(False)).alias("engaged"))


def deltas(surfacings: DataFrame) -> DataFrame:
    """(fact_id, delta, reason): up for facts engaged lately, down for facts of LEAST_TURNS turns without any engagement in the window."""
    by = surfacings.groupBy("fact_id").agg(
        F.bool_or(F.col("engaged") & F.col("recent")).alias("fresh"), F.bool_or("engaged").alias("ever"),
        F.count_distinct(F.struct("session_id", "turn_number")).alias("turns"))
    up, down = F.col("fresh"), ~F.col("ever") & (F.col("turns") >= LEAST_TURNS)
    return by.where(up | down).select("fact_id", F.when(up, STEP).otherwise(-STEP).alias("delta"), F.when(up, "engaged").otherwise("unengaged").alias("reason"))


def apply(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """(fact_id, old_trust, new_trust, reason) of facts whose trust changes."""
    old = F.coalesce(F.when(F.col("trust_score") == 0, F.lit(0.5)).otherwise(F.col("trust_score")), F.lit(0.5))
    joined = facts.join(moves, "fact_id").select("fact_id", old.alias("old_trust"), text.clamp_trust(F.col("trust_score"), F.col("delta"), CEILING, FLOOR).alias("new_trust"), "reason")
    return joined.where("old_trust <> new_trust")


def feedback(log: DataFrame, facts: DataFrame, entities: DataFrame, as_of: str, decisions: DataFrame | None = None, strict_turns: bool = False) -> DataFrame:
    """The nightly pass: facts with a decision follow that, the others follow use."""
    if decisions is None:
        return apply(facts, deltas(engagement(log, facts, entities, as_of, strict_turns)))
    boost, turns, _ = decision_signals(decisions, as_of)
    used = deltas(engagement(log, facts, entities, as_of, strict_turns, turns)).join(boost, "fact_id", "left_anti")
    decided = boost.select("fact_id", F.lit(STEP).alias("delta"), F.lit("decision").alias("reason"))
    return apply(facts, used.unionByName(decided))


def acceptance(decisions: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Outcomes and acceptance rate by kind; a null kind is a recommendation."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    rows = retain(decisions, as_of, days).groupBy(F.coalesce("kind", F.lit("recommendation")).alias("kind"))
    out = rows.agg(n("accepted").alias("accepted"), n("modified").alias("modified"), n("rejected").alias("rejected"), n("pending").alias("pending"), n("ignored").alias("ignored"))
    resolved = F.col("accepted") + F.col("modified") + F.col("rejected")
    return out.withColumn("acceptance", F.round((F.col("accepted") + F.col("modified")) / F.nullif(resolved, F.lit(0)), 4))


def latest_decisions(decisions: DataFrame, shown: int = 15, outcome: str | None = None) -> DataFrame:
    rows = decisions.where(F.col("outcome") == outcome) if outcome else decisions
    return rows.orderBy(F.desc("id")).limit(shown)


def fold_decisions(records: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Current decisions from records (id, ...) and resolutions (session_id, decision_id or null, outcome, chosen, reason, seq).

    A resolution without an id goes to the session's latest pending decision, else to the latest pending one anywhere. Only pending rows
    change, so the first resolution that reaches a decision is the one that holds.
    """
    pending = records.where("outcome = 'pending'")
    by_session = pending.groupBy("session_id").agg(F.max("id").alias("own"))
    anywhere = pending.agg(F.max("id").alias("any"))
    to = resolutions.join(by_session, "session_id", "left").join(F.broadcast(anywhere), how="cross").withColumn("id", F.coalesce("decision_id", "own", "any"))
    first = to.groupBy("id").agg(F.min_by(F.struct(F.col("outcome").alias("r_outcome"), F.col("chosen").alias("r_chosen"), F.col("reason").alias("r_reason")), "seq").alias("r"))
    hit = (F.col("outcome") == "pending") & F.col("r").isNotNull()
    out = records.join(first, "id", "left")
    for c in ("outcome", "chosen", "reason"):
        out = out.withColumn(f"__{c}", F.when(hit, F.coalesce(f"r.r_{c}", c)).otherwise(F.col(c)))
    return out.drop("r", "outcome", "chosen", "reason").withColumnsRenamed({f"__{c}": c for c in ("outcome", "chosen", "reason")})
