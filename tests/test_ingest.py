import json

from recallgrid import tables
from recallgrid.api import Memory
from recallgrid.operators import maintain
from recallgrid.sources import readers
from recallgrid.streaming import ingest


def make_extractor():
    """A nested function, so that it travels by value: the workers cannot import a test module."""

    def extractor(text, source):
        return [{"kind": "fact", "content": text[:40], "category": source}, {"kind": "edge", "src": "Ann", "rel": "works at", "dst": "Acme"}, {"kind": "fact", "content": "short", "category": "x"}]

    return extractor


def test_spool_reader(spark, tmp_path):
    path = tmp_path / "spool.jsonl"
    path.write_text('{"id": "1", "source": "mail", "text": "hello there"}\n\nnot json\n{"text": "no id here"}\n')
    rows = {r["text"]: r["id"] for r in readers.spool(spark, str(path)).collect()}
    assert rows["hello there"] == "1" and len(rows["no id here"]) == 16 and len(rows) == 2


def test_sections(spark, tmp_path):
    path = tmp_path / "m.md"
    path.write_text("one\n§\n two \n§ §three")
    assert [r["section"] for r in readers.sections(spark, str(path)).collect()] == ["one", "two", "three"]


def test_missing_table_is_empty(spark, tmp_path):
    assert readers.table(spark, str(tmp_path / "none"), "id string").count() == 0


def test_stream_takes_each_document_once(spark, tmp_path):
    spool, store, check = (tmp_path / n for n in ("spool", "store", "check"))
    spool.mkdir()

    def put(name, *docs):
        (spool / name).write_text("".join(json.dumps(d) + "\n" for d in docs))

    put("a.json", {"id": "1", "source": "mail", "text": "a first document that is long enough"}, {"id": "2", "source": "mail", "text": "short"})
    for step in range(2):
        ingest.start(spark, str(spool), str(store), str(check), make_extractor()).awaitTermination()
        if not step:
            put("b.json", {"id": "1", "source": "mail", "text": "a first document that is long enough"}, {"id": "3", "source": "web", "text": "a third document that is long enough"})
    load = lambda name: tables.load(spark, str(store), name)
    assert sorted(r["id"] for r in load("ledger").collect()) == ["1", "2", "3"]
    facts = {r["source_ref"]: r for r in load("facts").collect()}
    assert set(facts) == {"mail:1", "web:3"} and facts["mail:1"]["category"] == "mail" and facts["mail:1"]["fact_id"] > 0
    edges = {(r["src"], r["rel"], r["dst"], r["rel_orig"]) for r in load("edges").collect()}
    assert edges == {("Ann", "WORKS_FOR", "Acme", "works at")} and load("edges").where("seq IS NULL").count() == 0
    # a batch that is repeated replaces what it wrote
    before = {n: load(n).drop("seq", "created_at", "updated_at").collect() for n in ("facts", "edges", "nodes", "keys", "ledger")}
    again = spark.read.schema(readers.DOCUMENT).json(str(spool / "b.json"))
    ingest.take(spark, again, str(store), "batch-1", make_extractor(), 7)
    assert all(sorted(map(str, load(n).drop("seq", "created_at", "updated_at").collect())) == sorted(map(str, rows)) for n, rows in before.items())
    # and the store answers
    memory = Memory(spark, str(store))
    assert memory.graph_query("ann")["connections"] == [{"from": "Ann", "relation": "WORKS_FOR", "to": "Acme"}]
    memory.add_edge("Bob", "WORKS_FOR", "Acme")
    assert memory.graph_path("Ann", "Bob")["hops"] == 2
    tables.compact(spark, str(store), "edges")
    assert memory.graph_path("Ann", "Bob")["hops"] == 2


def test_parse_lines(spark):
    rows = spark.createDataFrame([('`{"a": 1},`',), ("words",), ("{bad",)], "line string")
    assert ingest.parse_lines(rows).count() == 1


def test_mining_skips_empty_facts(spark):
    facts = spark.createDataFrame([(1, " "), (2, None), (3, "x"), (4, "y")], "fact_id long, content string")
    done = spark.createDataFrame([(3,)], "fact_id long")
    assert [r["fact_id"] for r in maintain.unprocessed(facts, done, 1).collect()] == [4]


def test_json_list(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"jobs": [{"id": 1, "name": "a"}, {"id": 2}], "other": 1}')
    rows = readers.json_list(spark, str(tmp_path / "m.json"), "jobs", "id long, name string").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [(1, "a"), (2, None)]
