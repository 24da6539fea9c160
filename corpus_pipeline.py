"""A training corpus from raw documents, stage by stage.

Every stage reads what the stage before has written. All but the last return the columns of documents, and any further ones, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallgrid.llm import batches, ngram_join, secrets, sentencepiece_spans, toxicity, winnowing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the model on the labelled ones among these documents and drops those that it rejects.

    Null, empty and wordless texts have no sentence and stay, as do rows without doc_id unless their text is toxic. Texts are scored whole; rows that
    repeat are kept or dropped alike. A score at the threshold is toxic. Without labels of both classes, or documents, nothing is dropped.
    """
    return toxicity.reject(docs, toxicity.train(docs, batches.read(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, and of rows that repeat one another one.

    Null, empty and wordless texts and rows without doc_id are in no group and stay. Texts are compared whole. A similarity at the threshold
    is near. Of a doc_id that has several texts each is a document. No documents give none.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark, whole texts on both sides.

    Null, empty and short texts share nothing and stay; so does everything if the benchmark is empty. Rows that repeat are kept or dropped alike,
    with or without doc_id.
    """
    return winnowing.clean(docs, batches.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials in the texts and brings n_chars up to date; no document goes, repeated or empty as it may be. A null text stays null."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with the spans of the text that they stand for, a row for every row; null lists for a null text, empty ones for an empty one."""
    return sentencepiece_spans.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_copy),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: The first stage is a fitted model and the last an encoder, which SQL has no words for.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows go once what follows is written; those of the last but one stay for the result, which is read from them."""
    batches.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, written = batches.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if written:
            _remove(spark, written)
        written = f"{folder}/{name}"
        docs = spark.read.parquet(written)
    return STAGES[-1][1](spark, docs, sf_dir)
