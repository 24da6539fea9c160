"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence has the probability sigmoid(bias + sum of the weights of its
distinct features), where a word's features are the word itself and its first 4, 5, 6 and 7 bytes, which
catch inflected stems; weights are never negative, so that no amount of clean words hides an insult. A document
has the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to
the document labels through that noisy-or, so that blame falls on the sentences that explain a label.

Defined results: a null or empty text has no sentence, score 0 and is not toxic. A null label row is
left out of training. Repeated rows are scored each by itself. Without a label of each class the model
is empty and every score is 0. A score equal to the threshold is toxic; an empty table gives no rows. Texts are scored whole, at
any length. A null doc_id stays null. Extra columns, whatever their names, are ignored by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, textvec

#: Labelled documents that the model is fitted on, at most: those whose ids hash lowest.
MAX_LABELLED = 5000
#: Sample documents that must hold a feature before it gets a weight.
MIN_DOCS = 5
PREFIXES = (4, 5, 6, 7)
SENTENCE_PROBABILITY = 0.5

SCHEMA = "doc_id long, score double, toxic boolean, sentences array<struct<begin:int,end:int,p:double>>"
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    words: np.ndarray  #: sorted feature hashes, 32 bits each
    weights: np.ndarray
    bias: float
    threshold: float


def sentences(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every sentence, and the row of each.

    A sentence ends at . ! ? or a new line that is followed by another word, or with its row.
    """
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(_END[w.buf])])
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (ends[w.start[1:]] != ends[w.end[:-1]])
    first = np.flatnonzero(new)
    return first, w.row[first]


def features(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features and the word that each belongs to, in the order of the words within each kind."""
    every = np.arange(len(w.hash))
    keys, owner = [(w.hash >> np.uint64(32)).astype(np.uint32)], [every]
    size = w.end - w.start
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        keys.append((textvec.mix(textvec.hash_spans(w.buf, w.start[at], w.start[at] + k) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32))
        owner.append(every[at])
    return np.concatenate(keys), np.concatenate(owner)


def _bag(batch: pa.RecordBatch) -> pa.RecordBatch:
    w = textvec.words(batch.column("text"))
    first, row = sentences(w)
    keys, owner = features(w)
    sentence = np.searchsorted(first, owner, side="right") - 1
    local = sentence - np.searchsorted(row, w.row[owner]) if len(row) else sentence
    order = np.argsort(w.row[owner], kind="stable")
    keys, local = keys[order].astype("<u4"), local[order].astype("<u4")
    at = np.concatenate([[0], np.cumsum(np.bincount(w.row[owner], minlength=len(w)))])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("toxic"),
            pa.array([keys[at[i] : at[i + 1]].tobytes() for i in range(len(w))], pa.binary()),
            pa.array([local[at[i] : at[i + 1]].tobytes() for i in range(len(w))], pa.binary()),
            pa.array(np.bincount(row, minlength=len(w)).astype(np.int32)),
        ],
        ["toxic", "keys", "sentence", "sentences"],
    )


def _noisy_or(z: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document probabilities and sentence probabilities; sums run over -log(1 - p) = softplus(z)."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, z), n)), p


class _Rows:
    """Which features each sentence has, gone through a block at a time, so that what is gathered for it stays small."""

    BLOCK = 1 << 18

    def __init__(self, column: np.ndarray, counts: np.ndarray, width: int):
        self.column, self.counts, self.width = column, counts, width
        self.at = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(self.at, np.arange(0, len(column) + self.BLOCK, self.BLOCK), side="right") - 1
        self.blocks = list(zip(edges[:-1].tolist(), np.append(edges[1:-1], len(counts)).tolist())) if len(counts) else []

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each sentence's features."""
        out = np.zeros(len(self.counts))
        for a, b in self.blocks:
            full = np.flatnonzero(self.counts[a:b])
            if len(full):
                out[a + full] = np.add.reduceat(weights[self.column[self.at[a] : self.at[b]]], self.at[a + full] - self.at[a])
        return out

    def spread(self, values: np.ndarray) -> np.ndarray:
        """For every feature the sum of the values of the sentences that have it."""
        out = np.zeros(self.width)
        for a, b in self.blocks:
            out += np.bincount(self.column[self.at[a] : self.at[b]], np.repeat(values[a:b], self.counts[a:b]), self.width)
        return out


def fit(labels: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 200, rate: float = 0.3, l1: float = 0.02) -> Model:
    """Proximal Adagrad on the log-likelihood of the document labels; the threshold maximises F1 on every fifth document, held out.

    bags: for every document the feature hashes, the sentence of each, and the number of sentences; the list is emptied, to spare the driver's memory.
    """
    empty = Model(np.zeros(0, np.uint32), np.zeros(0), -30.0, 1.0)
    if not len(labels) or len(np.unique(labels)) < 2:
        return empty
    known, documents = np.unique(np.concatenate([np.unique(b[0]) for b in bags]), return_counts=True)
    vocabulary = known[documents >= MIN_DOCS]
    if not len(vocabulary):
        return empty
    doc_of_sentence = np.repeat(np.arange(len(bags)), [b[2] for b in bags])
    columns, counts = [], []
    while bags:
        keys, local, many = bags.pop(0)
        at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
        hit = vocabulary[at] == keys
        cells = np.unique(local[hit].astype(np.int64) * len(vocabulary) + at[hit])
        columns.append((cells % len(vocabulary)).astype(np.int32))
        counts.append(np.bincount(cells // len(vocabulary), minlength=many))
    matrix = _Rows(np.concatenate(columns), np.concatenate(counts), len(vocabulary))
    del columns, counts
    held = np.arange(len(labels)) % 5 == 4
    if len(np.unique(labels[held])) < 2:
        held[:] = False
    train_s = ~held[doc_of_sentence]
    weights, bias = np.zeros(len(vocabulary)), -5.0
    g2, b2, y = np.full(len(vocabulary), 1e-2), 1e-2, labels.astype(float)
    used = max(1, int((~held).sum()))
    for _ in range(rounds):
        z = bias + matrix.sums(weights)
        doc_p, p = _noisy_or(z, doc_of_sentence, len(labels))
        doc_p = np.clip(doc_p, 1e-9, 1)
        # d log L / dz = p (y / P - 1) for the noisy-or
        dz = np.where(train_s, p * (y[doc_of_sentence] / doc_p[doc_of_sentence] - 1), 0) / used
        grad, db = matrix.spread(dz), dz.sum()
        g2, b2 = g2 + (grad * 100) ** 2, b2 + (db * 100) ** 2
        step = rate / np.sqrt(g2)
        weights = weights + step * grad * 100
        weights = np.maximum(weights - step * l1, 0)
        bias += rate / np.sqrt(b2) * db * 100
    doc_p, _ = _noisy_or(bias + matrix.sums(weights), doc_of_sentence, len(labels))
    at = held if held.any() else np.ones(len(labels), bool)
    order = np.argsort(-doc_p[at], kind="stable")
    hits = np.cumsum(y[at][order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + y[at].sum())
    ranked = doc_p[at][order]
    last = np.append(ranked[1:] != ranked[:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return Model(vocabulary[weights != 0], weights[weights != 0], float(bias), float((ranked[best] + below) / 2))


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits on at most max_labelled labelled documents, chosen by the hash of their ids."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = batches.map_text(sample.select("toxic", "text"), _bag, "toxic int, keys binary, sentence binary, sentences int").toPandas()
    rows = rows.sort_values(["keys", "sentence", "toxic"], kind="stable")
    known, bags = rows["toxic"].to_numpy().copy(), [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), n) for a, b, n in zip(rows["keys"], rows["sentence"], rows["sentences"])]
    del rows
    batches.trim()
    return fit(known, bags)


def score_arrays(model: Model, column: pa.Array) -> tuple[np.ndarray, textvec.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, the words, and for every sentence its first word, row and probability."""
    w = textvec.words(column)
    first, row = sentences(w)
    if not len(first) or not len(model.words):
        return np.zeros(len(w)), w, first, row, np.zeros(len(first))
    keys, owner = features(w)
    at = np.minimum(np.searchsorted(model.words, keys), len(model.words) - 1)
    known = np.flatnonzero(model.words[at] == keys)
    sentence = np.searchsorted(first, owner[known], side="right") - 1
    cells = np.unique(sentence * np.int64(len(model.words)) + at[known])
    z = model.bias + np.bincount(cells // len(model.words), model.weights[cells % len(model.words)], len(first))
    score, p = _noisy_or(z, row, len(w))
    return score, w, first, row, p


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row a document: its probability, the decision, and the offending sentences by character offsets, worst first by place."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        value, w, first, row, p = score_arrays(model, batch.column("text"))
        toxic = value >= model.threshold
        last = np.concatenate([first[1:], [len(w.hash)]]) - 1 if len(first) else first
        bad = toxic[row] & (p >= SENTENCE_PROBABILITY) if len(row) else np.zeros(0, bool)
        spans = pa.StructArray.from_arrays(
            [pa.array(w.char_at(w.start[first[bad]]).astype(np.int32)), pa.array(w.char_at(w.end[last[bad]] - 1).astype(np.int32) + 1), pa.array(np.round(p[bad], 6))],
            ["begin", "end", "p"],
        )
        lists = batches.list_array(spans, np.bincount(row[bad], minlength=len(w)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(value, 6)), pa.array(toxic), lists], ["doc_id", "score", "toxic", "sentences"])

    return batches.map_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def reject(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, with all their columns; one pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = score_arrays(shared.value, batch.column("text"))[0]
        return batch.filter(pa.array(value < shared.value.threshold))

    return batches.map_text(documents, run, documents.schema)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = batches.read(spark, sf_dir, "documents")
    return score(documents, train(documents, batches.read(spark, sf_dir, "labels")))
