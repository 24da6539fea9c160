"""A picture of the store: node-link JSON and a Markdown page. Counting is Spark's, only the text is put together on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text

from . import graph, search


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


def samples(facts: DataFrame, shown: int = 8) -> DataFrame:
    c = F.col("content")
    return facts.where(~text.shows_personal(c) & F.length(c).between(20, 160)).orderBy(F.desc("trust_score"), "fact_id").limit(shown).select("fact_id", "content", text.fixed(F.col("trust_score"), 1).alias("trust"))


def facts_of_nodes(nodes: DataFrame, facts: DataFrame, shown: int = 6) -> DataFrame:
    """(name, fact_id, content): the most trusted facts that hold a node's name of four letters or more."""
    hits = search.holding(facts.withColumn("hay", F.lower("content")), nodes.where(F.length("name") >= 4).select("name", F.lower("name").alias("low")).distinct(), "hay", "low")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("trust_score"), "fact_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= shown).select("name", "fact_id", "content")


def core_nodes(nodes: DataFrame, edges: DataFrame, shown: int = 26) -> DataFrame:
    """The best connected nodes without a stage attribute."""
    staged = F.try_variant_get(F.try_parse_json("attrs"), "$.stage", "string")
    core = nodes.where(staged.isNull()).select("name", F.coalesce("type", F.lit("concept")).alias("type"))
    return core.join(graph.degree(edges), "name").orderBy(F.desc("degree"), "name").limit(shown)


def node_link(nodes: DataFrame, edges: DataFrame) -> str:
    """JSON of a bounded view: what core_nodes picks and the edges between."""
    core = core_nodes(nodes, edges)
    names = F.broadcast(core.select("name"))
    links = edges.join(names.withColumnRenamed("name", "src"), "src").join(names.withColumnRenamed("name", "dst"), "dst").select("src", "rel", "dst").distinct()
    return json.dumps({"nodes": [{"id": r["name"], "type": r["type"], "degree": r["degree"]} for r in core.collect()], "links": [{"source": r["src"], "relation": r["rel"], "target": r["dst"]} for r in links.orderBy("src", "rel", "dst").collect()]}, ensure_ascii=False)


def top_relations(edges: DataFrame, shown: int = 18) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel").limit(shown)


def page(nodes: DataFrame, edges: DataFrame, facts: DataFrame, shown: int = 18) -> str:
    relations = top_relations(edges, shown).collect()
    types = nodes.groupBy(F.coalesce("type", F.lit("concept")).alias("type")).count().orderBy(F.desc("count"), "type").collect()
    view = json.loads(node_link(nodes, edges))
    number = {n["id"]: i for i, n in enumerate(view["nodes"])}
    safe = lambda s: s.replace('"', "'").replace("[", "(").replace("]", ")")
    chart = ["graph LR", *[f'  n{i}["{safe(name)}"]' for name, i in number.items()], *[f"  n{number[e['source']]} -- {e['relation']} --> n{number[e['target']]}" for e in view["links"]]]
    lines = ["# Memory snapshot", "", "## Node types", *[f"- {r['type']}: {r['count']}" for r in types], "", "## Relations", *[f"- {r['rel']}: {r['n']}" for r in relations], "", "## Samples", *[f"- [{r['trust']}] {r['content']}" for r in samples(facts).collect()], "", "```mermaid", *chart, "```", ""]
    return "\n".join(lines)


def web_page(nodes: DataFrame, edges: DataFrame) -> str:
    data = node_link(nodes, edges).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>Memory</title><ul id="list"></ul><script>
const data = {data};
for (const n of data.nodes) {{
  const item = document.createElement("li");
  item.textContent = `${{n.id}} (${{n.type}}): ` + data.links.filter(l => l.source === n.id).map(l => `${{l.relation}} ${{l.target}}`).join(", ");
  document.getElementById("list").append(item);
}}
</script>"""
