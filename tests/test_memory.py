"""Feedback, consolidation, relations, entities, review, calendar and context on small literal rows."""

from pyspark.sql import functions as F

from recallgrid.operators import calendar, consolidate, context, feedback, relations, resolve, review, vectors

AS_OF = "2026-01-31 00:00:00"
LOG = "id long, ts timestamp, session_id string, turn_number long, query string, fact_id long"


def log(spark, items):
    return spark.createDataFrame(items, "id long, day string, session_id string, turn_number long, query string, fact_id long").select("id", F.to_timestamp("day").alias("ts"), "session_id", "turn_number", "query", "fact_id")


def facts(spark, trust=0.5):
    return spark.createDataFrame([(1, "Ann likes blue tea", "general", trust)], "fact_id long, content string, category string, trust_score double")


def entities(spark):
    return spark.createDataFrame([(1, "Bluehouse"), (1, "tea")], "fact_id long, name string")


def run(spark, items, trust=0.5, **more):
    return [tuple(r) for r in feedback.feedback(log(spark, items), facts(spark, trust), entities(spark), AS_OF, **more).collect()]


def test_engaged_fact_rises(spark):
    items = [(1, "2026-01-30 12:00:00", "s", 1, "first", 1), (2, "2026-01-30 12:01:00", "s", 2, "about BLUEHOUSE", None)]
    assert run(spark, items) == [(1, 0.5, 0.52, "engaged")]


def test_same_turn_counts_unless_strict(spark):
    items = [(1, "2026-01-30 12:00:00", "s", 1, "bluehouse", 1), (2, "2026-01-30 12:00:00", "s", 1, "bluehouse", 1)]
    assert run(spark, items) == [(1, 0.5, 0.52, "engaged")]
    assert run(spark, items, strict_turns=True) == []


def test_unengaged_after_five_turns(spark):
    four = [(i, "2026-01-25 00:00:00", "s", i, "other", 1) for i in range(4)]
    assert run(spark, four) == []
    assert run(spark, four + [(9, "2026-01-25 00:00:00", "s", 9, "other", 1)], 0.36) == [(1, 0.36, 0.35, "unengaged")]
    assert run(spark, [(i, "2025-12-01 00:00:00", "s", i, "other", 1) for i in range(9)]) == []


def test_decisions_decide(spark):
    items = [(1, "2026-01-30 12:00:00", "s", 1, "first", 1), (2, "2026-01-30 12:01:00", "s", 2, "bluehouse", None)]
    rows = [(1, "s", 1, "accepted", 0, [1]), (2, "s", 2, "rejected", 0, [1]), (3, "t", 1, "pending", 0, [1])]
    d = spark.createDataFrame(rows, "id long, session_id string, turn_number long, outcome string, trust_applied int, refs array<long>").withColumn("ts", F.to_timestamp(F.lit("2026-01-10 00:00:00")))
    assert run(spark, items, decisions=d) == [(1, 0.5, 0.52, "decision")]
    assert [r["id"] for r in feedback.decision_signals(d, AS_OF)[2].collect()] == [3]


def test_archive(spark):
    rows = [(1, "Same  text", 0, 0, 0.5), (2, "same text", 1, 0, 0.5), (3, "Voice call just ended", 0, 0, 0.5), (4, "Voice call just ended now", 0, 2, 0.5), (5, None, 0, 0, 0.5), (6, "", 0, 0, 0.5)]
    f = spark.createDataFrame(rows, "fact_id long, content string, helpful_count long, retrieval_count long, trust_score double")
    assert {tuple(r) for r in consolidate.archive(f).collect()} == {(1, "duplicate"), (3, "junk:call-transcript")}


def test_archive_writes_before_it_drops(spark, tmp_path):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "fact_id long, content string")
    links = spark.createDataFrame([(1, 7), (2, 7)], "fact_id long, entity_id long")
    gone = spark.createDataFrame([(1, "duplicate")], "fact_id long, reason string")
    kept, left = consolidate.apply_archive(f, links, gone, str(tmp_path / "archive"))
    assert [r["fact_id"] for r in kept.collect()] == [2] and [r["fact_id"] for r in left.collect()] == [2]
    assert spark.read.json(str(tmp_path / "archive")).first()["reason"] == "duplicate"


def links(spark, pairs):
    return spark.createDataFrame(pairs, "fact_id long, entity_id long")


def test_clusters(spark):
    four = [(f, e) for f in range(1, 5) for e in (1, 2)]
    assert [r["members"] for r in consolidate.clusters(links(spark, four)).collect()] == [[1, 2, 3, 4]]
    assert consolidate.clusters(links(spark, [(f, 1) for f in range(20)])).count() == 0
    assert consolidate.clusters(links(spark, [(f, 1) for f in range(2)])).count() == 0
    assert consolidate.clusters(links(spark, [(f, 1) for f in range(13)])).count() == 0
    used = consolidate.clusters(links(spark, four)).select("signature")
    assert consolidate.clusters(links(spark, four), used).count() == 0


def test_null_category_is_not_eligible(spark):
    f = spark.createDataFrame([(1, "x"), (2, None), (3, "chunk"), (4, "x")], "fact_id long, category string").withColumn("created_at", F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    members = spark.createDataFrame([(9, 4)], "chunk_fact_id long, member_fact_id long")
    assert [r["fact_id"] for r in consolidate.eligible(f, members, AS_OF).collect()] == [1]


def mapped(spark, name):
    r = spark.range(1).select(relations.canonical(F.lit(name)).alias("m")).first()["m"]
    return r["canonical"], r["flipped"]


def test_relations(spark):
    assert mapped(spark, "OFFERS_HYBRID_IN") == ("LOCATED_IN", False)
    assert mapped(spark, "CURRENTLY_MANAGED_BY") == ("LEADS", True)
    assert mapped(spark, "BLESSED_BY") == ("RELATED_TO", False)
    assert mapped(spark, "NOTIFIED_BY") == ("RELATED_TO", True)
    assert mapped(spark, "") == ("RELATED_TO", False)
    assert mapped(spark, "Works At") == ("WORKS_FOR", False)
    assert len({*relations.NAMES, *relations.INVERSE, *(t for t, _ in relations.STEMS), relations.OTHER}) == 38
    assert sum(len(v.split()) for v in relations.NAMES.values()) == 140 and sum(len(v.split()) for v in relations.INVERSE.values()) == 20


def test_remap_collides_and_repeats(spark):
    rows = [("a", "works_at", "b", "email:new", 2), ("a", "WORKS_FOR", "b", "email:old", 1), ("x", "owned_by", "y", None, 3), ("c", "Whatever", "c", "t", 4), ("n", "calls", "m", "calendar", 5)]
    e = spark.createDataFrame(rows, "src string, rel string, dst string, src_tag string, seq long")
    once = relations.remap(e)
    got = {(r["src"], r["rel"], r["dst"], r["src_tag"], r["rel_orig"]) for r in once.collect()}
    assert got == {("a", "WORKS_FOR", "b", "email:old", ""), ("y", "OWNS", "x", None, "owned_by"), ("n", "calls", "m", "calendar", "")}
    again = {(r["src"], r["rel"], r["dst"], r["src_tag"], r["rel_orig"]) for r in relations.remap(once).collect()}
    assert again == got


def records(spark, names, **extra):
    rows = [(i, n, extra.get("domain", [None] * len(names))[i], None, None, "org") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "seq long, name string, domain string, email string, phone string, type string")


def test_entities_in_order(spark):
    got = {r["seq"]: r["canonical"] for r in resolve.resolve_in_order(records(spark, ["Acme Construction Group", "Acmee Construction Group", "LLC"])).collect()}
    assert got == {0: "Acme Construction Group", 1: "Acme Construction Group", 2: "LLC"}
    near = resolve.resolve_in_order(records(spark, ["Nimbus Platform", "Nimbo Platform"])).where("seq = 1").first()
    assert near["canonical"] == "Nimbo Platform" and near["candidate"] == "Nimbus Platform" and 0.85 <= near["score"] < 0.92
    apart = {r["canonical"] for r in resolve.resolve_in_order(records(spark, ["Acme Group", "Acme Groupe"], domain=["a.com", "b.com"])).collect()}
    assert len(apart) == 2


def test_entities_at_scale(spark):
    got = {r["seq"]: r["canonical"] for r in resolve.resolve_at_scale(records(spark, ["Acme Construction Group", "Acmee Construction Group", "Zeta", "The Zeta, Inc."])).collect()}
    assert got == {0: "Acme Construction Group", 1: "Acme Construction Group", 2: "Zeta", 3: "Zeta"}


def test_review(spark):
    e = spark.createDataFrame([("a", "POSSIBLE_ALIAS", "b", "alias-candidate", 1), ("x", "INSTANCE_OF", "cat", "proposed", 2), ("y", "INSTANCE_OF", "cat", "proposed", 3)], "src string, rel string, dst string, src_tag string, seq long")
    assert [r["line"] for r in review.summary(e).collect()] == ["alias: a = b", "category: cat <- x, y"]
    done = review.reject_category(review.reject_alias(e, "b", "a"), "cat")
    assert {r["src_tag"] for r in done.collect()} == {"rejected"} and review.summary(done).count() == 0
    assert {r["src_tag"] for r in review.approve_category(e, "cat").where("rel = 'INSTANCE_OF'").collect()} == {"curated"}


def test_calendar(spark):
    e = spark.createDataFrame([("1", None, "Dinner", "with Maria", "Prague", "2026-02-01T10:00", None), ("2", "cancelled", "Gone", None, None, "2026-02-02", None)], "id string, status string, summary string, description string, location string, start string, `end` string")
    nodes = spark.createDataFrame([("Maria", "person"), ("Prague", "city"), ("Bo", "person")], "name string, type string")
    got = {(r["src"], r["rel"], r["dst"]) for r in calendar.edges(e, nodes, "me").collect()}
    name = "Dinner (2026-02-01)"
    assert got == {("me", "ATTENDS", name), (name, "INVOLVES", "Maria"), (name, "LOCATED_IN", "Prague")}
    made = spark.createDataFrame([(name, "personal", "1", "2026-02-01"), ("Old name", "personal", "1", "2026-02-01"), ("Gone (2026-02-02)", "personal", "2", "2026-02-02"), ("Past", "personal", "9", "2026-01-01"), ("Other", "work", "8", "2026-03-01")], "name string, cal string, event_id string, start string")
    assert {r["name"] for r in calendar.stale(made, e, "2026-01-31").collect()} == {"Old name", "Gone (2026-02-02)"}
    assert calendar.stale(made, e, "2026-01-31", complete=False).count() == 0


def lines(spark, blocks):
    rows = [(b, i, t, i == 0) for b, block in enumerate(blocks) for i, t in enumerate(block)]
    return spark.createDataFrame(rows, "block int, line int, text string, header boolean")


def reference_cap(blocks, cap):
    used, full, out = 0, False, []
    for b, block in enumerate(blocks):
        kept = []
        for t in block:
            if not full and cap > 0 and used + len(t) + 1 > cap:
                full = True
            if full:
                break
            used += len(t) + 1
            kept.append(t)
        if len(kept) > 1:
            out += [(b, t) for t in kept]
    return out


def test_cap(spark):
    blocks = [["## A", "- one", "- two"], ["## B", "- three"]]
    for cap in (0, 4, 5, 11, 16, 17, 22, 30, 100):
        got = [(r["block"], r["text"]) for r in context.cap_lines(lines(spark, blocks), cap).orderBy("block", "line").collect()]
        assert got == reference_cap(blocks, cap), cap


def test_chunks_and_cross_block(spark):
    shown = spark.createDataFrame([(1,), (2,), (3,)], "fact_id long")
    members = spark.createDataFrame([(1, 2), (9, 3)], "chunk_fact_id long, member_fact_id long")
    assert sorted(r["fact_id"] for r in context.suppress_chunks(shown, members).collect()) == [1, 3]
    hits = spark.createDataFrame([("Blue TEA",), ("other",)], "text string")
    said = spark.createDataFrame([("ann likes blue tea",)], "text string")
    assert [r["text"] for r in context.drop_cross_block(hits, said).collect()] == ["other"]


def test_prefetch(spark):
    rows = spark.createDataFrame([(1, "x\ny", "e1"), (2, "z", "e2")], "rank int, text string, entry_id string")
    out = context.prefetch_lines([("Facts", rows), ("None", rows.limit(0))], 100).orderBy("block", "line").collect()
    assert [r["text"] for r in out] == ["## Facts", "- x y", "- z"]


def test_recall_may_fall_short(spark):
    rows = [(f"v{i:02d}", f"t{i}", "scratch" if i < 25 else "fact", [1.0, i / 100]) for i in range(40)]
    store_ = spark.createDataFrame(rows, "vid string, text string, type string, embedding array<double>")
    got = vectors.recall(store_, vectors.literal([1.0, 0.0]), 5, 0.25, ("scratch",))
    assert got.count() == 0
    assert [r["vid"] for r in vectors.recall(store_, vectors.literal([1.0, 0.0]), 3).orderBy("rank").collect()] == ["v00", "v01", "v02"]


def test_phases(spark):
    df = spark.range(1).select(vectors.atom(F.lit("w"), 8).alias("a"), vectors.atom(F.lit("r"), 8).alias("r"), vectors.atom(F.lit("q"), 8).alias("q"))
    bound = vectors.phase_similarity(vectors.bind(F.col("a"), F.col("r")), vectors.bind(F.col("q"), F.col("r")))
    row = df.select(vectors.phase_similarity(F.col("a"), F.col("a")).alias("same"), bound.alias("bound"), vectors.phase_similarity(F.col("a"), F.col("q")).alias("plain")).first()
    assert abs(row["same"] - 1) < 1e-12 and abs(row["bound"] - row["plain"]) < 1e-9
