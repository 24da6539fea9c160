"""Incremental ingestion: new documents become facts, nodes and edges in micro-batches, each document once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import tables
from recallgrid.operators import graph, maintain
from recallgrid.sources import readers

Extractor = Callable[[str, str], list[dict]]
LINE = "doc string, kind string, content string, category string, src string, rel string, dst string, name string, type string"


def gate(documents: DataFrame, ledger: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Documents to work on, and the ids that enter the ledger: all new ones, also those that are too short to work on."""
    new = readers.with_id(documents).join(ledger.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return new.where(F.length(F.trim("text")) >= least), new.select("id")


def extract(documents: DataFrame, extractor: Extractor, longest: int = 6000) -> DataFrame:
    """Lines that an extractor finds in a document; it is a plain function of text and source, run batch by batch on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in LINE.split(", ")]
        for frame in frames:
            rows = [{"doc": d} | line for d, t, s in zip(frame["id"], frame["text"], frame["source"]) for line in extractor((t or "")[:longest], s or "")]
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    lines = documents.select("id", "text", "source").mapInPandas(run, LINE)
    fit = (F.col("kind") != "fact") | F.length("content").between(8, 400)
    return lines.where(fit)


def parse_lines(answer: DataFrame, column: str = "line") -> DataFrame:
    """Objects of an answer in JSON lines: trailing commas and backticks come off, anything else is left out."""
    clean = F.btrim(F.col(column), F.lit("`, \t\r"))
    return answer.withColumn("object", F.when(clean.startswith("{"), F.try_parse_json(clean))).where("object IS NOT NULL")


def new_facts(lines: DataFrame, facts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rows of facts by content that the store does not have, as the first document that says them says them.

    The id is a hash of the content, so a batch that is repeated gives the same rows. documents (id, source, meta) add category, tags and provenance.
    """
    said = lines.where("kind = 'fact'").groupBy("content").agg(F.min_by(F.struct("category", "doc"), "doc").alias("x")).select("content", "x.*")
    new = said.join(facts.select("content"), "content", "left_anti")
    number = F.xxhash64("content").bitwiseAND(F.lit(2**63 - 1)).alias("fact_id")
    if documents is None:
        return new.select(number, "content", "category", F.concat(F.lit("doc:"), "doc").alias("source_ref"))
    told = F.filter(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))), lambda e: e.key.isin("from", "sender", "number", "direction") & (F.coalesce(e.value, F.lit("")) != ""))
    bits = F.concat(F.array(F.coalesce("source", F.lit("note"))), F.transform(told, lambda e: F.concat(e.key, F.lit(":"), e.value)))
    by = documents.select(F.col("id").alias("doc"), F.coalesce("source", F.lit("note")).alias("source"), F.substring(F.array_join(bits, ","), 1, 120).alias("tags"))
    now = F.current_timestamp()
    return new.join(by, "doc").select(
        number, "content", F.col("source").alias("category"), "tags", F.lit(0.5).alias("trust_score"), F.lit(0).alias("retrieval_count"), F.lit(0).alias("helpful_count"),
        now.alias("created_at"), now.alias("updated_at"), F.substring(F.concat("source", F.lit(":"), "doc"), 1, 200).alias("source_ref"))


def graph_lines(lines: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, attrs) and edges (src, rel, dst, source_ref) that lines tell of."""
    nodes = lines.where("kind = 'node' AND trim(name) <> ''").select("name", "type", F.lit(None).cast("string").alias("attrs")).distinct()
    edges = lines.where("kind = 'edge' AND trim(src) <> '' AND trim(dst) <> '' AND trim(rel) <> ''")
    if documents is None:
        return nodes, edges.select("src", "rel", "dst", F.concat(F.lit("doc:"), "doc").alias("source_ref"))
    by = documents.select(F.col("id").alias("doc"), F.coalesce("source", F.lit("note")).alias("source"))
    return nodes, edges.join(by, "doc").select("src", "rel", "dst", F.substring(F.concat("source", F.lit(":"), "doc"), 1, 200).alias("source_ref"))


def take(spark: SparkSession, documents: DataFrame, root: str, part: str, extractor: Extractor, seq: int) -> None:
    """One batch into the store that ``tables`` describes: facts, nodes, edges, entity keys, and the ledger last.

    All rows go to the batch's own part, so a batch that is repeated after a crash replaces what it had written, and knows what the others wrote.
    """
    ledger = tables.load(spark, root, "ledger", without=part)
    work, ids = gate(documents.where("text IS NOT NULL OR id IS NOT NULL"), ledger)
    work = graph.cut(work)
    # the extractor may be a model that is asked over a network: each document is read once
    lines = graph.cut(extract(work, extractor))
    tables.append(new_facts(lines, tables.load(spark, root, "facts", without=part), work), root, "facts", part)
    node_rows, edge_rows, keys = maintain.write_graph(*graph_lines(lines, work), seq, index=tables.load(spark, root, "keys", without=part))
    for name, rows in (("nodes", node_rows), ("edges", edge_rows), ("keys", keys), ("ledger", ids)):
        tables.append(rows, root, name, part)


def start(spark: SparkSession, spool: str, root: str, checkpoint: str, extractor: Extractor, files_per_batch: int = 25, clock: Callable[[], float] = time.time):
    """Runs everything that waits in the spool and ends. Checkpoint and ledger together give each document once, also when a batch is repeated."""
    source = spark.readStream.schema(readers.DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(spool)

    def batch(rows: DataFrame, number: int) -> None:
        take(spark, rows, root, f"batch-{number}", extractor, int(clock() * 1e6))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; works on batch and stream alike, late rows beyond delay are dropped by streams."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
