"""Schemas of the store's tables and the settings that queries take their limits from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from recallgrid.sources import readers

SCHEMAS = {
    "facts": "fact_id long, content string, category string, tags string, trust_score double, retrieval_count long, helpful_count long, created_at timestamp, updated_at timestamp, source_ref string",
    "entities": "entity_id long, name string, entity_type string, aliases string",
    "fact_entities": "fact_id long, entity_id long",
    "edges": "src string, rel string, dst string, src_tag string, source_ref string, rel_orig string, seq long",
    "nodes": "name string, type string, attrs string, seq long",
    "vectors": "vid string, text string, source string, type string, embedding array<float>, seq long, gone boolean",
    "recall_log": "id long, ts timestamp, session_id string, turn_number long, query string, block string, fact_id long, vid string, score double",
    "trust_log": "ts timestamp, fact_id long, old_trust double, new_trust double, reason string",
    "fact_gists": "fact_id long, gist string",
    "chunk_members": "chunk_fact_id long, member_fact_id long",
    "decisions": "id long, ts timestamp, session_id string, turn_number long, kind string, proposal string, options_shown string, chosen string, outcome string, reason string, refs array<long>, trust_applied int",
    "resolutions": "session_id string, decision_id long, outcome string, chosen string, reason string, seq long",
    "keys": "key string, canonical string, type string, seq long",
    "ledger": "id string",
    "reviews": "src string, rel string, dst string, tag string, seq long",
    "merges": "loser string, winner string, seq long",
    "mined": "fact_id long, seq long",
}


@dataclass(frozen=True)
class Settings:
    """Limits of a turn; ``of`` takes overrides from a mapping, as a configuration file gives them, and ignores unknown names."""

    recall_floor: float = 0.40
    tool_floor: float = 0.25
    context_chars: int = 2000
    least_trust: float = 0.3
    situation_floor: float = 0.42
    analogy_floor: float = 0.50
    analogy_z: float = 2.0
    analogy_surface: float = 0.30
    analogy_chars: int = 40
    analogy_width: int = 256
    analogies: bool = True
    operational: tuple[str, ...] = ("operational", "scratch")

    @classmethod
    def of(cls, values: dict | None) -> Settings:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items() if k in known})


#: The part of a table that single writes go to; a batch of ingestion has one of its own, which it overwrites when it is repeated.
LIVE = "live"


def load(spark: SparkSession, root: str, name: str, without: str | None = None) -> DataFrame:
    return readers.table(spark, f"{root}/{name}", SCHEMAS[name], without)


def append(df: DataFrame, root: str, name: str, part: str = LIVE) -> None:
    """One append a batch; columns that df lacks are null. A part other than LIVE is replaced."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS[name])
    have = set(df.columns)
    df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append" if part == LIVE else "overwrite").parquet(f"{root}/{name}/part={part}")


def compact(spark: SparkSession, root: str, name: str, files: int = 1) -> None:
    """Brings the many small files of single writes into a few; run it while nothing writes to the table.

    The new files are complete before the old ones go, and go by names that readers skip until then. Run again, it ends what a broken run began.
    """
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{p}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    live, packed, old = path(f"part={LIVE}"), path("_packed"), path("_old")
    if not fs.exists(old):
        if not fs.exists(live):
            return
        spark.read.parquet(live.toString()).repartition(files).write.mode("overwrite").parquet(packed.toString())
        fs.rename(live, old)
    if fs.exists(packed) and not fs.exists(live):
        fs.rename(packed, live)
    fs.delete(old, True)
