"""The tools an assistant calls. This is the boundary where rows come to the driver; every answer is bounded.

Embedding and language-model calls are given in as functions; none is needed for the rest.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import tables
from recallgrid.functions import text
from recallgrid.operators import consolidate, context, feedback, graph, maintain, resolve, review, snapshot, store, vectors
from recallgrid.streaming import ingest

Embedder = Callable[[str], list[float]]

#: tool: what it is for, and its arguments (* must be given; s, i, b, l: string, integer, boolean, list of strings)
ARGUMENTS = {
    "recall": ("Memories by meaning.", "*query:s k:i include_operational:b"),
    "graph_query": ("What an entity is linked to.", "*entity:s depth:i"),
    "graph_path": ("How two entities are linked.", "*a:s *b:s max_hops:i"),
    "graph_connections": ("Paths between several entities, and what all of them are linked to.", "*entities:l"),
    "graph_reason": ("The part of the graph that a question is about, and an answer from it.", "*question:s entities:l"),
    "chunk_expand": ("The facts that a chunk sums up.", "*chunk:i"),
    "situation_store": ("Keeps situations that come again.", "*action:s=add|list|remove name:s description:s playbook:s"),
    "decision_log": ("Records what was proposed and what became of it.", "*action:s=record|resolve|list kind:s proposal:s options:l id:i outcome:s=accepted|rejected|modified chosen:s reason:s"),
    "ontology_review": ("Open proposals, and decisions on them.", "action:s=list|approve_alias|reject_alias|approve_category|reject_category a:s b:s"),
    "analogize": ("Entities that play a similar part.", "entity:s body:s k:i"),
}


class Memory:
    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None, reason: Callable[[str, str], str] | None = None, settings: tables.Settings | None = None, session: str = "s", clock: Callable[[], float] = time.time):
        self.spark, self.root, self.embed, self.reason, self.session, self.clock = spark, root, embed, reason, session, clock
        self.settings = settings or tables.Settings()
        self.turn = 0

    # state

    def _table(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.root, name)

    def _merged(self) -> DataFrame:
        """(name, now) of names that review merged; people approve these, so they are few."""
        to = store.merged_names([(r["loser"], r["winner"], r["seq"]) for r in self._table("merges").collect()])
        return self.spark.createDataFrame(list(to.items()), "name string, now string")

    def all_edges(self) -> DataFrame:
        """Current edges, hidden ones too: first assertions, what review said of them, and merged names in place of those they had."""
        reviewed = store.retag(store.fold_edges(self._table("edges")), self._table("reviews"))
        return store.apply_merges(reviewed, self._merged())

    def edges(self) -> DataFrame:
        return store.visible_edges(self.all_edges())

    def nodes(self) -> DataFrame:
        return store.apply_node_merges(store.fold_nodes(self._table("nodes")), self._merged())

    def facts(self) -> DataFrame:
        """Facts with the trust that feedback gave them last and every call that showed them counted."""
        moved = self._table("trust_log").groupBy("fact_id").agg(F.max_by("new_trust", "ts").alias("moved"))
        base = self._table("facts").join(moved, "fact_id", "left").withColumn("trust_score", F.coalesce("moved", "trust_score")).drop("moved")
        shown = self._table("recall_log").select(F.concat_ws("|", "session_id", F.col("turn_number").cast("string"), F.col("ts").cast("string"), "query").alias("call"), "fact_id")
        return store.bump_retrieval(base, shown)

    def aliases(self) -> DataFrame:
        return resolve.alias_map(self._table("keys"))

    def graph_nodes(self) -> DataFrame:
        return store.graph_nodes(self.nodes(), self.edges())

    def vectors(self) -> DataFrame:
        return store.latest(self._table("vectors"), "vid", "gone")

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        tables.append(self.spark.createDataFrame(rows, schema), self.root, name)

    def _seq(self) -> int:
        return int(self.clock() * 1e6)

    def add_edge(self, src: str, rel: str, dst: str, tag: str = "tool", source_ref: str = "") -> None:
        self._append("edges", [(src, rel, dst, tag, source_ref, self._seq())], "src string, rel string, dst string, src_tag string, source_ref string, seq long")

    def add_node(self, name: str, kind: str | None = None, attrs: dict | None = None) -> None:
        self._append("nodes", [(name, kind, json.dumps(attrs) if attrs else None, self._seq())], "name string, type string, attrs string, seq long")

    def upsert_vector(self, vid: str, body: str, kind: str, embedded: str | None = None, source: str = "") -> None:
        if body.strip() and self.embed:
            self._append("vectors", [(vid, body, source, kind, self.embed(embedded or body), self._seq(), False)], "vid string, text string, source string, type string, embedding array<float>, seq long, gone boolean")

    def delete_vector(self, vid: str) -> None:
        self._append("vectors", [(vid, self._seq(), True)], "vid string, seq long, gone boolean")

    def on_memory_write(self, action: str, block: str, body: str) -> None:
        vid = f"{block}_{hashlib.sha256(body.encode()).hexdigest()[:12]}"
        self.delete_vector(vid) if action == "remove" else self.upsert_vector(vid, body, block)

    # turns

    def on_turn_start(self, message: str) -> None:
        self.turn += 1

    def log_recall(self, rows: DataFrame, query: str) -> None:
        """rows: block, fact_id, vid, score. One append a turn."""
        base = rows.select("block", F.col("fact_id").cast("long"), "vid", F.col("score").cast("double"))
        numbered = base.withColumn("id", F.lit(self._seq()) + F.monotonically_increasing_id())
        stamp = F.timestamp_micros(F.lit(int(self.clock() * 1e6)))
        tables.append(numbered.select("id", stamp.alias("ts"), F.lit(self.session).alias("session_id"), F.lit(self.turn).cast("long").alias("turn_number"), F.lit(query[:400]).alias("query"), "block", "fact_id", "vid", "score"), self.root, "recall_log")

    def prefetch(self, window: list[str]) -> str:
        """The context for the last messages: facts, vector hits, graph lines, an analogy and situations under the budget; what ships is logged."""
        query = "\n".join(window[-3:])
        s = self.settings
        facts = self.facts().where(~F.coalesce("category", F.lit("")).isin(*s.operational))
        found = context.search_facts(facts, query, s.least_trust).withColumn("rank", F.row_number().over(_by("score"))).where("rank <= 5")
        found = found.select("rank", F.concat(F.lit("["), text.fixed(F.col("trust_score"), 1), F.lit("] "), "content").alias("text"), F.concat(F.lit("holo_fact_"), F.col("fact_id").cast("string")).alias("entry_id"), "fact_id", F.col("score"))
        found = context.suppress_chunks(found, self._table("chunk_members"))
        blocks, told = [("Facts", found)], found.select("fact_id")
        probe = vectors.literal(self.embed(query)) if self.embed and query.strip() else None
        if probe is not None:
            hits = vectors.recall(self.vectors(), probe, 6, s.recall_floor, (*s.operational, "situation"))
            hits = context.drop_cross_block(hits, found.select("text")).withColumn("fact_id", text.fact_id_of(F.col("vid"))).where("rank <= 5")
            told = told.union(hits.select("fact_id"))
            blocks.append(("Related", hits.select("rank", F.concat(F.lit("["), text.fixed(F.col("similarity"), 2), F.lit("] "), "text").alias("text"), F.col("vid").alias("entry_id"), "fact_id", F.col("similarity").alias("score"))))
        named = [r["name"] for r in context.mentioned_nodes(self._entered(), self.aliases(), query).collect()]
        if named:
            start = self.spark.createDataFrame([(n,) for n in named], "start string")
            lines = context.neighbour_lines(graph.neighbours(self.edges(), start)).withColumn("n", F.row_number().over(_by("start", "rank", up=True)))
            blocks.append(("Graph", lines.select(F.col("n").alias("rank"), F.substring("line", 3, 10_000).alias("text"), F.lit(None).cast("string").alias("entry_id"), F.lit(None).cast("long").alias("fact_id"), F.lit(None).cast("double").alias("score"))))
        analogy = self._analogy(query, facts, probe, told) if s.analogies and len(query) >= s.analogy_chars else None
        if analogy is not None:
            blocks.append(("Analogy", analogy))
        if probe is not None:
            near = vectors.situations(self.vectors(), probe, s.situation_floor)
            blocks.append(("Situations", near.select("rank", F.substring("text", 1, 300).alias("text"), F.col("vid").alias("entry_id"), F.lit(None).cast("long").alias("fact_id"), F.col("similarity").alias("score"))))
        shipped = context.prefetch_lines([(t, b.select("rank", "text", "entry_id")) for t, b in blocks], s.context_chars).orderBy("block", "line").collect()
        kept = {r["entry_id"] for r in shipped if r["entry_id"]}
        if kept:
            logged = None
            for title, b in blocks:
                part = b.where(F.col("entry_id").isin(*kept)).select(F.lit(title.lower()).alias("block"), "fact_id", F.col("entry_id").alias("vid"), "score")
                logged = part if logged is None else logged.union(part)
            self.log_recall(logged, query)
        return "\n".join(r["text"] for r in shipped)

    def _entered(self) -> DataFrame:
        """(name, seq) of the graph's nodes with the first write that named them."""
        said = self._table("nodes").select("name", "seq").union(self._table("edges").select(F.col("src"), "seq")).union(self._table("edges").select("dst", "seq"))
        return self.graph_nodes().select("name").join(said.groupBy("name").agg(F.min("seq").alias("seq")), "name", "left")

    def _analogy(self, query: str, facts: DataFrame, probe, shown: DataFrame) -> DataFrame:
        """At most one line: a memory built like the query that does not look like it, was not shown yet and is none of the last twenty."""
        s = self.settings
        said = facts.where("content IS NOT NULL").select("fact_id", "content")
        placed = said.withColumn("phases", vectors.probe_phases(F.col("content"), s.analogy_width))
        asked = text.tokens(F.lit(query))
        faced = vectors.surface(placed, self.vectors(), probe, asked).withColumnRenamed("surface", "near")
        skip = shown.union(vectors.recent_analogies(self._table("recall_log"))).where("fact_id IS NOT NULL").distinct()
        best = vectors.analogies(faced, vectors.probe_phases(F.lit(query), s.analogy_width), asked, skip, F.col("near"), s.analogy_floor, s.analogy_z, s.analogy_surface)
        line = F.concat(F.lit("[~"), text.fixed(F.col("score"), 2), F.lit("] "), "content")
        return best.select(F.lit(1).alias("rank"), line.alias("text"), text.vector_id("holo_fact_", F.col("fact_id")).alias("entry_id"), "fact_id", "score")

    # upkeep

    def feedback(self, as_of: str) -> int:
        """The nightly pass: moves of trust go to the audit log, which the facts' trust is read from; decisions that took effect or grew old are marked."""
        e = self._table("fact_entities").join(self._table("entities"), "entity_id").select("fact_id", "name")
        current = feedback.fold_decisions(self._table("decisions"), self._table("resolutions"))
        moves = graph.cut(feedback.feedback(self._table("recall_log"), self.facts(), e, as_of, current))
        tables.append(moves.withColumn("ts", F.lit(as_of).cast("timestamp")), self.root, "trust_log")
        stale = feedback.decision_signals(current, as_of)[2]
        tables.append(stale.select(F.lit(self.session).alias("session_id"), F.col("id").alias("decision_id"), F.lit("ignored").alias("outcome"), F.lit(self._seq()).alias("seq")), self.root, "resolutions")
        return moves.count()

    def mine(self, edges_of: Callable[[str], list[tuple[str, str, str]]] | None = None, gist_of: Callable[[str], str] | None = None, size: int = 25) -> int:
        """The next facts without a gist or edges: edges and gists are found on the executors, written, and only then are the facts marked as done."""
        work = graph.cut(maintain.unprocessed(self.facts(), self._table("mined"), size))
        many = work.count()
        if not many:
            return 0
        seq = self._seq()
        if edges_of is not None:
            told = ingest.extract(work.select(F.col("fact_id").cast("string").alias("id"), F.col("content").alias("text"), F.lit("fact").alias("source")), lambda body, _: [{"kind": "edge", "src": a, "rel": r, "dst": b} for a, r, b in edges_of(body)])
            nodes, links = ingest.graph_lines(graph.cut(told))
            links = links.withColumn("source_ref", F.regexp_replace("source_ref", "^doc:", "fact:"))
            node_rows, edge_rows, keys = maintain.write_graph(nodes, links, seq, index=self._table("keys"))
            for name, rows in (("nodes", node_rows), ("edges", edge_rows), ("keys", keys)):
                tables.append(rows, self.root, name)
        found = work.select("fact_id", F.lit(None).cast("string").alias("gist"))
        if gist_of is not None:
            found = work.mapInPandas(lambda frames: (f[["fact_id"]].assign(gist=[gist_of(t) for t in f["content"]]) for f in frames), "fact_id long, gist string")
        rows = graph.cut(maintain.gists(work, found))
        tables.append(rows, self.root, "fact_gists")
        if self.embed:
            one = self.embed
            tables.append(maintain.gist_vectors(rows, work, self.settings.operational, lambda texts: [one(t) for t in texts], seq), self.root, "vectors")
        tables.append(work.select("fact_id", F.lit(seq).alias("seq")), self.root, "mined")
        return many

    def backfill(self, edges_of=None, gist_of=None, size: int = 1000) -> int:
        """Mines until nothing is left."""
        total = 0
        while many := self.mine(edges_of, gist_of, size):
            total += many
        return total

    def vectorize(self) -> None:
        """Vectors for all facts that have none."""
        one = self.embed
        tables.append(maintain.vectorize(self.facts(), self.vectors(), lambda texts: [one(t) for t in texts], self._seq()), self.root, "vectors")

    # tools

    def recall(self, query: str, k: int = 5, include_operational: bool = False) -> dict:
        hidden = () if include_operational else self.settings.operational
        rows = vectors.recall(self.vectors(), vectors.literal(self.embed(query)), k, self.settings.tool_floor, hidden).orderBy("rank").collect()
        if rows:
            self.log_recall(self.spark.createDataFrame([("recall", None, r["vid"], r["similarity"]) for r in rows], "block string, fact_id long, vid string, score double").withColumn("fact_id", text.fact_id_of(F.col("vid"))), query)
        return {"results": [{"text": r["text"], "type": r["type"], "similarity": r["similarity"]} for r in rows]}

    def _node(self, name: str) -> str | None:
        row = graph.resolve_names(self.spark.createDataFrame([(name,)], "name string"), self.graph_nodes(), self.aliases()).first()
        return row["node"]

    def _unknown(self, name: str) -> dict:
        return {"error": f"'{name}' not found", "did_you_mean": [r["name"] for r in graph.did_you_mean(self.graph_nodes(), name).collect()]}

    def graph_query(self, entity: str, depth: int = 1) -> dict:
        node = self._node(entity)
        if node is None:
            return self._unknown(entity)
        near = graph.neighbours(self.edges(), self.spark.createDataFrame([(node,)], "start string"), depth)
        row = self.nodes().where(F.col("name") == node).first()
        rows = near.orderBy("hop", "node").collect()
        return {"entity": node, "type": row["type"] if row else "concept", "attrs": json.loads(row["attrs"]) if row and row["attrs"] else {}, "connections": [{"from": r["from_node"], "relation": r["relation"], "to": r["to_node"]} for r in rows]}

    def graph_path(self, a: str, b: str, max_hops: int = 4) -> dict:
        x, y = self._node(a), self._node(b)
        if x is None or y is None:
            return self._unknown(a if x is None else b)
        paths = graph.shortest_paths(self.edges(), self.spark.createDataFrame([(x, y)], "a string, b string"))
        found = paths.first()
        if found["hops"] is None:
            return {"path": None, "hops": None}
        steps = graph.path_relations(self.edges(), paths).orderBy("step").collect()
        return {"hops": found["hops"], "path": [{"from": r["from_node"], "relation": r["relation"], "to": r["to_node"]} for r in steps], "beyond_max_hops": found["hops"] > max_hops}

    def graph_connections(self, entities: list[str]) -> dict:
        found = {e: self._node(e) for e in entities}
        names = sorted({n for n in found.values() if n})
        missing = [e for e, n in found.items() if n is None]
        if len(names) < 2:
            return {"error": "at least two known entities are needed", "missing": missing}
        pairs = self.spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
        rows = graph.shortest_paths(self.edges(), pairs).orderBy("a", "b").collect()
        shared = [r["name"] for r in graph.shared_neighbours(self.edges(), names).collect()]
        return {"paths": [{"a": r["a"], "b": r["b"], "hops": r["hops"], "path": r["path"]} for r in rows], "shared": shared, "missing": missing}

    def graph_reason(self, question: str, entities: list[str] | None = None) -> dict:
        names = [n for n in map(self._node, entities or []) if n]
        if not names:
            names = [r["name"] for r in context.mentioned_nodes(self._entered(), self.aliases(), question, 4).collect()]
        if not names:
            return {"error": "no known entity in the question"}
        lines = [f"{r['from_node']} {r['relation']} {r['to_node']}" for r in graph.reasoning_subgraph(self.edges(), names).collect()]
        return {"seeds": names, "lines": lines, "answer": self.reason(question, "\n".join(lines)) if self.reason else None}

    def chunk_expand(self, chunk: int) -> dict:
        rows = consolidate.expand_chunk(self._table("chunk_members"), self.facts(), chunk).orderBy("fact_id").collect()
        return {"chunk": chunk, "members": [{"fact_id": r["fact_id"], "content": r["content"]} for r in rows]}

    def situation_store(self, action: str, name: str = "", description: str = "", playbook: str = "") -> dict:
        """A situation is found by its description and shown as name and description."""
        vid = f"situation_{hashlib.sha256(name.encode()).hexdigest()[:12]}"
        if action == "add":
            self.add_node(name, "situation", {"playbook": playbook} if playbook else None)
            self.upsert_vector(vid, f"{name}: {description}", "situation", description)
        elif action == "remove":
            self.delete_vector(vid)
        rows = self.vectors().where("type = 'situation'").select("vid", "text").orderBy("vid").collect()
        return {"situations": [r["text"] for r in rows]}

    def decision_log(self, action: str, **args) -> dict:
        if action == "record":
            shown = self._table("recall_log").where((F.col("session_id") == self.session) & (F.col("turn_number") == self.turn) & F.col("fact_id").isNotNull())
            refs = [r["fact_id"] for r in shown.groupBy("fact_id").agg(F.min("id").alias("id")).orderBy("id").limit(20).collect()]
            row = (self._seq(), self.session, self.turn, args.get("kind"), (args.get("proposal") or "")[:500], json.dumps(args.get("options") or []), "pending", refs, 0)
            frame = self.spark.createDataFrame([row], "id long, session_id string, turn_number long, kind string, proposal string, options_shown string, outcome string, refs array<long>, trust_applied int")
            tables.append(frame.withColumn("ts", F.timestamp_micros("id")), self.root, "decisions")
            return {"id": row[0], "linked": len(refs)}
        if action == "resolve":
            self._append("resolutions", [(self.session, args.get("id"), args["outcome"], args.get("chosen"), args.get("reason"), self._seq())], tables.SCHEMAS["resolutions"])
        current = feedback.fold_decisions(self._table("decisions"), self._table("resolutions"))
        return {"decisions": [{"id": r["id"], "proposal": r["proposal"], "outcome": r["outcome"]} for r in feedback.latest_decisions(current).collect()]}

    def ontology_review(self, action: str = "list", a: str = "", b: str = "") -> dict:
        """Decisions are events of their own; no log is rewritten. approve_alias: a goes into b, and its name stands for b from now on."""
        seq, e = self._seq(), self.all_edges()
        if action == "approve_alias" and a and b and a != b:
            kind = next((r["type"] for r in self.nodes().where(F.col("name") == b).collect() if r["type"] not in (None, "", "concept")), None)
            key = F.concat(F.lit("norm:"), text.normalize_name(F.lit(a)))
            tables.append(self.spark.range(1).select(key.alias("key"), F.lit(b).alias("canonical"), F.lit(kind).alias("type"), F.lit(seq).alias("seq")).where("key <> 'norm:'"), self.root, "keys")
            self._append("merges", [(a, b, seq)], tables.SCHEMAS["merges"])
        events = {"reject_alias": lambda: review.alias_events(e, a, b), "approve_category": lambda: review.category_events(e, a, "curated"), "reject_category": lambda: review.category_events(e, a, "rejected")}
        if action in events:
            tables.append(events[action]().withColumn("seq", F.lit(seq)), self.root, "reviews")
        return {"pending": [r["line"] for r in review.summary(self.all_edges()).collect()]}

    def text_seeds(self, body: str, reach: int = 12, facts: int = 6, shown: int = 3) -> list[str]:
        near = vectors.recall(self.vectors(), vectors.literal(self.embed(body)), reach, 0.0).withColumn("fact_id", text.fact_id_of(F.col("vid"))).where("fact_id IS NOT NULL").orderBy("rank").limit(facts)
        names = near.join(self._table("fact_entities"), "fact_id").join(self._table("entities"), "entity_id").groupBy("name").agg(F.min("rank").alias("rank"))
        placed = graph.resolve_names(names.select("name"), self.graph_nodes(), self.aliases()).where("node IS NOT NULL")
        return [r["node"] for r in placed.join(names, "name").groupBy("node").agg(F.min("rank").alias("rank")).orderBy("rank", "node").limit(shown).collect()]

    def analogize(self, entity: str = "", body: str = "", k: int = 5) -> dict:
        node = self._node(entity) if entity else None
        if entity and node is None:
            return self._unknown(entity)
        sources = [node] if node else self.text_seeds(body) if body and self.embed else []
        if not sources:
            return {"error": "an entity or a text is needed"}
        alike = resolve.ratio("source_norm", "target_norm") >= 0.7
        rows = [r.asDict() for s in sources for r in graph.analogize(self.edges(), self.graph_nodes(), s, k, alike).collect()]
        best = sorted(rows, key=lambda r: (-r["similarity"], r["source"], r["target"]))[:k]
        return {"mappings": best, "count": len(best)}

    def count_results(self, answer: str, query: str) -> int:
        """Logs the facts of a search tool's JSON answer, each once."""
        try:
            ids = {int(r["fact_id"]): r.get("score") for r in json.loads(answer).get("results", []) if isinstance(r, dict) and r.get("fact_id")}
        except (ValueError, AttributeError):
            return 0
        if ids:
            self.log_recall(self.spark.createDataFrame([("tool", i, f"holo_fact_{i}", None if s is None else float(s)) for i, s in ids.items()], "block string, fact_id long, vid string, score double"), query)
        return len(ids)

    def stats(self) -> dict:
        found = snapshot.counts({n: self._table(n) for n in ("facts", "edges", "nodes", "vectors", "recall_log")})
        return {r["table"]: r["n"] for r in found.collect()}

    TOOLS = ("recall", "graph_query", "graph_path", "graph_connections", "graph_reason", "chunk_expand", "situation_store", "decision_log", "ontology_review", "analogize")

    def schemas(self) -> list[dict]:
        """What an assistant may pass to each tool, as JSON schemas."""
        kinds = {"s": {"type": "string"}, "i": {"type": "integer"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "string"}}}
        out = []
        for tool in self.tools():
            about, fields = ARGUMENTS[tool]
            names = [f.partition(":") for f in fields.split()]
            given = {n.strip("*"): dict(kinds[k.split("=")[0]], **({"enum": k.split("=")[1].split("|")} if "=" in k else {})) for n, _, k in names}
            out.append({"name": tool, "description": about, "parameters": {"type": "object", "properties": given, "required": [n.strip("*") for n, _, _ in names if n.startswith("*")]}})
        return out

    def tools(self) -> list[str]:
        return [t for t in self.TOOLS if t != "analogize" or self.settings.analogies]

    def call(self, tool: str, args: dict) -> str:
        if tool not in self.tools():
            return json.dumps({"error": f"unknown tool {tool}"})
        try:
            return json.dumps(getattr(self, tool)(**args), ensure_ascii=False)
        except TypeError as error:
            return json.dumps({"error": str(error)})


def _by(*columns: str, up: bool = False):
    from pyspark.sql import Window

    return Window.orderBy(*[F.asc(c) if up else F.desc(c) for c in columns])
