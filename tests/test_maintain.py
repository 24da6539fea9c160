from recallgrid.operators import consolidate, maintain


def test_graph_writer(spark):
    nodes = spark.createDataFrame([("Acme Construction Group", "company", '{"a":1}'), ("Acmee Construction Group", "company", None), ("Nimbus Platform", "project", None), ("Nimbo Platform", "project", None)], "name string, type string, attrs string")
    edges = spark.createDataFrame([("Acmee Construction Group", "owned by", "Ann", "doc:1"), ("Ann", "works at", "ann", "doc:1")], "src string, rel string, dst string, source_ref string")
    node_rows, edge_rows, keys = maintain.write_graph(nodes, edges, 5)
    # what a batch resolved is known to the next one, by either rule
    more = spark.createDataFrame([("Acmee Construction Group", "company", None), ("Nimda Platform", "project", None)], "name string, type string, attrs string")
    for at_scale in (False, True):
        rows, near, _ = maintain.write_graph(more, edges.limit(0), 2_000_000, at_scale, keys)
        assert {r["name"] for r in rows.collect()} == {"Acme Construction Group", "Nimda Platform"}, at_scale
        assert near.where("src_tag = 'alias-candidate'").count() >= 1
    assert {r["name"] for r in node_rows.collect()} == {"Acme Construction Group", "Nimbus Platform", "Nimbo Platform"}
    got = {(r["src"], r["rel"], r["dst"], r["src_tag"], r["rel_orig"]) for r in edge_rows.collect()}
    assert ("Ann", "OWNS", "Acme Construction Group", "ingest", "owned by") in got
    assert {(a, c) for a, r, c, t, _ in got if t == "alias-candidate"} & {("Nimbus Platform", "Nimbo Platform"), ("Nimbo Platform", "Nimbus Platform")}
    assert len(got) == 2


def test_vectors_and_names(spark):
    facts = spark.createDataFrame([(1, "one", "general"), (2, " ", "general"), (3, "three", "operational")], "fact_id long, content string, category string")
    vids = spark.createDataFrame([("holo_fact_3",)], "vid string")

    def embed(texts):
        return [[float(len(t))] for t in texts]

    assert [(r["vid"], r["embedding"]) for r in maintain.vectorize(facts, vids, embed, 1).collect()] == [("holo_fact_1", [3.0])]
    gists = spark.createDataFrame([(1, "g"), (3, "h")], "fact_id long, gist string")
    rows = maintain.gist_vectors(gists, facts, ("operational",), embed, 1).collect()
    assert [(r["vid"], r["text"], r["embedding"]) for r in rows] == [("gist_1", "one", [1.0])]
    clusters = spark.createDataFrame([("sig", [1, 3])], "signature string, members array<long>")
    named = maintain.name_clusters(clusters, facts, lambda texts: "+".join(texts))
    assert named.first()["summary"] == "one+three"
    chunk = consolidate.write_chunk_rows(named.selectExpr("*", "'One and three' AS title", "array('Ann') AS names"), 100)
    edge, node = chunk["edges"].first(), chunk["nodes"].first()
    assert (edge["src"], edge["src_tag"]) == ("One and three", "chunk") and (node["name"], node["attrs"]) == ("One and three", '{"chunk_fact_id":101}')
    assert chunk["facts"].first()["content"] == "one+three" and chunk["chunk_members"].count() == 2 and chunk["edges"].first()["dst"] == "Ann"


def test_shared_pairs_have_tasks_by_their_number(spark, monkeypatch):
    """Repeated links, nulls and hubs; as many tasks as the pairs ask for; large components are counted, not gathered."""
    import random
    from collections import Counter

    from recallgrid.operators import consolidate

    monkeypatch.setattr(consolidate, "TASK_PAIRS", 50)
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(30)) for _ in range(200)] + [(f, 99) for f in range(60)] + [(None, 1), (5, None), (7, 3), (7, 3)]
    links = spark.createDataFrame(rows, "fact_id long, entity_id long")
    groups = {}
    for f, e in rows:
        if f is not None and e is not None:
            groups.setdefault(e, []).append(f)
    shared, small, total = Counter(), set(), 0
    for facts in groups.values():
        if 2 <= len(facts) <= 20:
            total += len(facts) * (len(facts) - 1) // 2
            for a in facts:
                for b in facts:
                    if a < b:
                        shared[a, b] += 1
                        if len(facts) <= 6:
                            small.add((a, b))
    found = consolidate.shared_pairs(links, 20, 6)
    assert {(r["a"], r["b"]): (r["shared"], r["small"]) for r in found.collect()} == {p: (n, p in small) for p, n in shared.items()}
    assert found.rdd.getNumPartitions() == total // 50 + 1


def test_large_components_are_counted_only(spark):
    from recallgrid.operators import consolidate

    chain = spark.createDataFrame([(f, e) for e in range(40) for f in (e, e + 1)] + [(f, 500) for f in (900, 901, 902)], "fact_id long, entity_id long")
    assert [r["members"] for r in consolidate.clusters(chain).collect()] == [[900, 901, 902]]
    plan = consolidate.clusters(chain)._jdf.queryExecution().optimizedPlan().toString()
    # sizes are joined before members are gathered
    assert "Join" in plan[plan.index("collect_list") :]
