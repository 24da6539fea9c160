import json

import pytest

from recallgrid import tables
from recallgrid.api import Memory
from recallgrid.operators import snapshot


@pytest.fixture
def memory(spark, tmp_path):
    # travels to the workers by value, as they cannot import a test
    def embed(body):
        words = body.lower().split()
        return [float(sum(w.startswith(c) for w in words)) + 0.01 for c in "abcdefgh"]

    ticks = iter(range(1_700_000_000, 1_800_000_000))
    m = Memory(spark, str(tmp_path), embed, lambda q, lines: f"{q}: {len(lines.splitlines())}", clock=lambda: float(next(ticks)))
    facts = [(1, "Ann works for Acme on blue things", "general", 0.6), (2, "Bolt builds cars", "general", 0.5), (3, "internal note", "operational", 0.9), (7, "Chunk of Ann and Bolt", "chunk", 0.5)]
    tables.append(spark.createDataFrame(facts, "fact_id long, content string, category string, trust_score double"), m.root, "facts")
    tables.append(spark.createDataFrame([(7, 1), (7, 2)], "chunk_fact_id long, member_fact_id long"), m.root, "chunk_members")
    tables.append(spark.createDataFrame([(1, 1)], "fact_id long, entity_id long"), m.root, "fact_entities")
    tables.append(spark.createDataFrame([(1, "Anna")], "entity_id long, name string"), m.root, "entities")
    for edge in (("Anna", "WORKS_FOR", "Acme"), ("Bolt", "CLIENT_OF", "Acme"), ("Bolt", "LOCATED_IN", "Rome"), ("Anna", "LIVES_IN", "Rome")):
        m.add_edge(*edge)
    m.add_node("Anna", "person", {"city": "Rome"})
    m.upsert_vector("holo_fact_1", "ann and acme blue", "fact")
    m.upsert_vector("holo_fact_2", "bolt builds cars", "fact")
    return m


def test_graph_tools(memory):
    found = json.loads(memory.call("graph_query", {"entity": "anna"}))
    assert found["entity"] == "Anna" and found["attrs"] == {"city": "Rome"} and {c["to"] for c in found["connections"]} == {"Acme", "Rome"}
    assert json.loads(memory.call("graph_query", {"entity": "ol"}))["did_you_mean"] == ["Bolt"]
    path = json.loads(memory.call("graph_path", {"a": "Anna", "b": "Bolt"}))
    assert path["hops"] == 2 and path["path"][0]["from"] == "Anna"
    assert json.loads(memory.call("graph_connections", {"entities": ["Anna", "Bolt", "nobody"]}))["shared"] == ["Acme", "Rome"]
    assert json.loads(memory.call("graph_reason", {"question": "what links Anna?"}))["answer"].endswith(": 4")
    assert "error" in json.loads(memory.call("nothing", {}))


def test_recall_situations_and_chunks(memory):
    memory.on_turn_start("hi")
    assert memory.recall("ann acme blue", 2)["results"][0]["text"] == "ann and acme blue"
    assert memory.stats()["recall_log"] >= 1
    assert memory.situation_store("add", "focus", "deep evening dark", "mute")["situations"] == ["focus: deep evening dark"]
    assert memory.situation_store("remove", "focus")["situations"] == []
    assert [x["fact_id"] for x in memory.chunk_expand(7)["members"]] == [1, 2]
    assert memory.count_results('{"results": [{"fact_id": 1, "score": 0.5}, {"fact_id": 1}]}', "q") == 1
    assert memory.count_results("broken", "q") == 0


def test_prefetch_ships_and_logs(memory):
    memory.on_turn_start("hi")
    shown = memory.prefetch(["tell me about Anna and blue things"])
    # the chunk stands for its member, which matched as well
    assert "## Facts" in shown and "Chunk of Ann and Bolt" in shown and "Ann works for Acme" not in shown
    assert "Anna WORKS_FOR Acme" in shown and "internal note" not in shown
    assert memory._table("recall_log").where("fact_id = 1").count() >= 1


def test_decisions(memory):
    memory.on_turn_start("hi")
    memory.count_results('{"results": [{"fact_id": 2}]}', "q")
    assert memory.decision_log("record", kind="plan", proposal="do it")["linked"] == 1
    assert memory.decision_log("resolve", outcome="accepted")["decisions"][0]["outcome"] == "accepted"
    assert memory.decision_log("resolve", outcome="rejected")["decisions"][0]["outcome"] == "accepted"


def test_review_is_events(memory):
    memory.add_node("Annie", "person", {"mail": "a@b.c", "city": "Oslo"})
    memory.add_edge("Annie", "POSSIBLE_ALIAS", "Anna", "alias-candidate")
    memory.add_edge("Annie", "OWNS", "Bolt")
    memory.add_edge("Rome", "POSSIBLE_ALIAS", "Roma", "alias-candidate")
    for member in ("Acme", "Bolt"):
        memory.add_edge(member, "INSTANCE_OF", "firm", "proposed")
    before = memory._table("edges").count()
    assert memory.ontology_review()["pending"] == ["alias: Annie = Anna", "alias: Rome = Roma", "category: firm <- Acme, Bolt"]
    assert memory.ontology_review("approve_alias", "Annie", "Anna")["pending"] == ["alias: Rome = Roma", "category: firm <- Acme, Bolt"]
    assert memory.ontology_review("reject_alias", "Roma", "Rome")["pending"] == ["category: firm <- Acme, Bolt"]
    assert memory.ontology_review("approve_category", "firm")["pending"] == []
    assert memory._table("edges").count() == before
    # the name that was merged stands for the other one, also when it is said again
    memory.add_edge("Annie", "USES", "Blue")
    found = memory.graph_query("Annie")
    assert found["entity"] == "Anna" and found["attrs"] == {"city": "Rome", "mail": "a@b.c"} and {"Bolt", "Blue"} <= {c["to"] for c in found["connections"]}
    tags = {(r["src"], r["rel"]): r["src_tag"] for r in memory.all_edges().where("rel IN ('INSTANCE_OF', 'POSSIBLE_ALIAS')").collect()}
    assert tags == {("Acme", "INSTANCE_OF"): "curated", ("Bolt", "INSTANCE_OF"): "curated", ("Rome", "POSSIBLE_ALIAS"): "rejected"}
    assert memory.analogize("Acme")["count"] >= 0
    assert memory.analogize(body="ann acme blue")["mappings"] is not None


def test_analogies_come_once(memory):
    memory.settings = tables.Settings(analogy_floor=0.0, analogy_z=-9.0, analogy_surface=1.0, analogy_chars=5, recall_floor=2.0, situation_floor=2.0)
    memory.on_turn_start("hi")
    shown = [memory.prefetch(["xyzzy plugh quux wibble frobnicate"]) for _ in range(4)]
    lines = [next((x for x in s.splitlines() if x.startswith("- [~")), None) for s in shown]
    assert all(lines[:3]) and len(set(lines[:3])) == 3 and lines[3] is None
    assert {r["retrieval_count"] for r in memory.facts().where("category <> 'operational'").collect()} == {1}


def test_upkeep(memory):
    def edges_of(body):
        return [("Bolt", "builds", "cars")] if "Bolt" in body else []

    assert memory.mine(edges_of, lambda body: body.upper(), 2) == 2 and memory.backfill(edges_of, None, 2) == 2 and memory.mine() == 0
    gists = {r["fact_id"]: r["gist"] for r in memory._table("fact_gists").collect()}
    assert gists[2] == "BOLT BUILDS CARS" and gists[7] == "Chunk of Ann and Bolt"
    assert {"cars"} <= {c["to"] for c in memory.graph_query("Bolt")["connections"]}
    assert memory.vectors().where("vid = 'gist_2' AND type = 'general'").count() == 1 and memory.vectors().where("vid = 'gist_3'").count() == 0
    memory.vectorize()
    assert memory.vectors().where("vid = 'holo_fact_7'").count() == 1
    # a fact that a decision names gains trust, and the audit log says so
    memory.on_turn_start("hi")
    memory.count_results('{"results": [{"fact_id": 2}]}', "q")
    memory.decision_log("record", kind="plan", proposal="do it")
    memory.decision_log("resolve", outcome="accepted")
    assert memory.feedback("2023-11-16 00:00:00") == 1
    row = memory._table("trust_log").first()
    assert (row["fact_id"], row["old_trust"], row["new_trust"], row["reason"]) == (2, 0.5, 0.52, "decision")
    assert memory.facts().where("fact_id = 2").first()["trust_score"] == 0.52


def test_schemas(memory):
    found = {t["name"]: t["parameters"] for t in memory.schemas()}
    assert list(found) == list(memory.TOOLS)
    import inspect

    for tool, given in found.items():
        wanted = inspect.signature(getattr(memory, tool)).parameters
        open_ = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
        assert open_ or set(given["properties"]) == set(wanted), tool
        assert given["required"] == [n for n, p in wanted.items() if p.default is p.empty and p.kind is not p.VAR_KEYWORD], tool


def test_settings_file(tmp_path, monkeypatch):
    from recallgrid.sources import readers

    monkeypatch.setenv("LIMIT", "7")
    (tmp_path / "a.yaml").write_text("# limits\ncontext_chars: ${LIMIT}\noperational: [x, y]\nanalogies: false\nrecall_floor: 0.5 # low\nother:\n  deep: 1\n")
    (tmp_path / "a.json").write_text('{"context_chars": 8}')
    s = tables.Settings.of(readers.settings(str(tmp_path / "a.yaml")))
    assert (s.context_chars, s.operational, s.analogies, s.recall_floor) == (7, ("x", "y"), False, 0.5)
    assert tables.Settings.of(readers.settings(str(tmp_path / "a.json"))).context_chars == 8 and readers.settings(str(tmp_path / "none")) == {}


def test_snapshot(memory):
    nodes = memory.nodes()
    assert json.loads(snapshot.node_link(nodes, memory.edges()))["nodes"][0]["id"] == "Anna"
    page = snapshot.page(nodes, memory.edges(), memory._table("facts"))
    assert "WORKS_FOR: 1" in page and "mermaid" in page and "Anna" in snapshot.web_page(nodes, memory.edges())


def test_settings():
    assert tables.Settings.of({"context_chars": 5, "unknown": 1, "operational": ["x"]}) == tables.Settings(context_chars=5, operational=("x",))
