from recallgrid.operators import graph, store

EDGE = "src string, rel string, dst string, src_tag string, seq long"


def edges(spark, items):
    return spark.createDataFrame([(a, r, b, "t", i) for i, (a, r, b) in enumerate(items)], EDGE)


def test_degree_counts_a_pair_once(spark):
    e = edges(spark, [("a", "R", "b"), ("b", "S", "a"), ("a", "R", "c")])
    assert {tuple(r) for r in graph.degree(e).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in graph.directed_degree(e).collect()} == {("a", 3), ("b", 2), ("c", 1)}


def test_neighbours_go_out_before_in(spark):
    e = edges(spark, [("b", "BACK", "a"), ("a", "OUT", "b"), ("c", "IN", "a"), ("c", "R", "d"), ("d", "R", "e")])
    start = spark.createDataFrame([("a",)], "start string")
    found = {(r["node"], r["hop"], r["from_node"], r["relation"]) for r in graph.neighbours(e, start, 2).collect()}
    assert found == {("b", 1, "a", "OUT"), ("c", 1, "c", "IN"), ("d", 2, "c", "R")}


def test_paths(spark):
    e = edges(spark, [("a", "R", "b"), ("c", "S", "b"), ("c", "T", "d"), ("x", "R", "y")])
    pairs = spark.createDataFrame([("a", "d"), ("a", "y"), ("a", "a")], "a string, b string")
    paths = graph.shortest_paths(e, pairs)
    got = {(r["a"], r["b"]): r["hops"] for r in paths.collect()}
    assert got == {("a", "d"): 3, ("a", "y"): None, ("a", "a"): 0}
    steps = {(r["step"], r["from_node"], r["relation"], r["to_node"]) for r in graph.path_relations(e, paths.where("b = 'd'")).collect()}
    assert steps == {(1, "a", "R", "b"), (2, "c", "S", "b"), (3, "c", "T", "d")}


def test_long_paths_are_found(spark):
    e = edges(spark, [(f"n{i:03}", "R", f"n{i + 1:03}") for i in range(70)])
    pairs = spark.createDataFrame([("n000", "n070"), ("n000", "n065"), ("n070", "n067"), ("n000", "other")], "a string, b string")
    got = {(r["a"], r["b"]): (r["hops"], r["path"] and len(r["path"])) for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {("n000", "n070"): (70, 71), ("n000", "n065"): (65, 66), ("n070", "n067"): (3, 4), ("n000", "other"): (None, None)}


def test_components_equal_union_find(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 100), (50, 51)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_neighbours(spark):
    e = edges(spark, [("a", "R", "x"), ("y", "R", "a"), ("b", "R", "x"), ("b", "R", "y"), ("b", "R", "z")])
    assert [r["name"] for r in graph.shared_neighbours(e, ["a", "b"]).collect()] == ["x", "y"]


def test_categories_and_analogies(spark):
    items = [(p, "WORKS_FOR", c) for p, c in (("ann", "acme"), ("bob", "bolt"), ("cyd", "acme"))] + [(p, "LIVES_IN", "rome") for p in ("ann", "bob")] + [("cyd", "OWNS", "car"), ("cyd", "OWNS", "cat")]
    e = edges(spark, items)
    types = {"ann": "person", "bob": "person", "cyd": "person", "acme": "org", "bolt": "org", "rome": "city", "car": "thing", "cat": "thing"}
    nodes = spark.createDataFrame(list(types.items()), "name string, type string")
    row = graph.categories(e, nodes).where("type = 'person'").first()
    assert (row["members"], row["relations"]) == (["ann", "bob"], ["LIVES_IN", "WORKS_FOR"])
    promoted = e.union(spark.createDataFrame([("ann", "INSTANCE_OF", "people", "rejected", 99)], EDGE))
    assert graph.categories(promoted, nodes).where("type = 'person'").count() == 0
    first = graph.analogize(e, nodes, "ann", 3).first()
    assert (first["target"], first["similarity"], first["shared_relations"]) == ("bob", 1.0, ["LIVES_IN", "WORKS_FOR"])


def test_categories_group_fingerprints_not_pairs(spark, monkeypatch):
    """Sixty alike people are one group without an edge between any two of them; those of a second fingerprint close to it belong too."""
    counted = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda e: counted.append(e.count()) or whole(e))
    people = [f"p{i:02}" for i in range(60)]
    items = [(p, r, to) for p in people for r, to in (("WORKS_FOR", "acme"), ("LIVES_IN", "rome"), ("OWNS", "car"))] + [(p, "USES", "pen") for p in people[50:]]
    nodes = spark.createDataFrame([(p, "person") for p in people] + [("acme", "org"), ("rome", "city"), ("car", "thing"), ("pen", "tool")], "name string, type string")
    rows = graph.categories(edges(spark, items), nodes, largest=100).where("type = 'person'").collect()
    assert [(r["label"], r["members"], r["relations"]) for r in rows] == [("p00", people, ["LIVES_IN", "OWNS", "WORKS_FOR"])]
    assert counted == [1]
    assert graph.categories(edges(spark, items), nodes, largest=59).where("type = 'person'").count() == 0


def test_pairs_of_alike_nodes_are_spread(spark, monkeypatch):
    """Blocks of few names: no pair is lost or doubled, and the pairs are multiplied out in as many tasks as their number asks for."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "TASK_PAIRS", 100)
    kinds = {f"n{i:02}": i % 3 for i in range(50)}
    counts = {0: {"R": 3}, 1: {"R": 3, "S": 1}, 2: {"S": 2}}
    prints = spark.createDataFrame([(name, "out", rel, "t", n) for name, kind in kinds.items() for rel, n in counts[kind].items()], "name string, dir string, rel string, type string, n long")
    nodes = spark.createDataFrame([(name, "own") for name in kinds], "name string, type string")
    found = graph.fingerprint_pairs(prints, nodes)
    near = 9 / (3 * 10**0.5)
    want = {(a, b, 1.0 if kinds[a] == kinds[b] else round(near, 6)) for a in kinds for b in kinds if a < b and (kinds[a] == kinds[b] or {kinds[a], kinds[b]} == {0, 1})}
    rows = [(r["a"], r["b"], round(r["cosine"], 6)) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert found.rdd.getNumPartitions() >= 8


def test_names_resolve_exactly_first(spark):
    nodes = spark.createDataFrame([("Rome", 1), ("ROME", 2)], "name string, seq long")
    aliases = spark.createDataFrame([("eternal city", "Rome")], "alias string, canonical string")
    names = spark.createDataFrame([("Rome",), ("rome",), ("Eternal City",), ("x",)], "name string")
    got = {r["name"]: r["node"] for r in graph.resolve_names(names, nodes, aliases).collect()}
    assert got == {"Rome": "Rome", "rome": "ROME", "Eternal City": "Rome", "x": None}


def test_graph_nodes_default_to_concept(spark):
    e = edges(spark, [("a", "R", "b")])
    nodes = spark.createDataFrame([("a", "person"), ("c", None)], "name string, type string")
    assert {tuple(r) for r in store.graph_nodes(nodes, e).collect()} == {("a", "person"), ("b", "concept"), ("c", "concept")}
