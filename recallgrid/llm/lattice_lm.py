"""Language-model scores by the likelihood of a subword lattice.

A text's probability is the sum, over all ways to split it into pieces of an existing vocabulary, of the
products of the pieces' unigram probabilities. Pieces never hold a space but in front, so the sum is a
product over words; within a word a forward recursion in log space runs over the lattice of all pieces
that match. A character that is no piece takes its byte pieces.

The vocabulary file's own scores weight the pieces, by one monotone map (``worth``): a unigram file's scores are log probabilities
as they are; those of a file of merges are their ranks, negative, and a rank r is worth -log(r + SHIFT), as in Zipf's law. A piece's log probability is
its worth times an exponent, normalised. The exponent is the one number that is taken from the corpus: the one under which the best
segmentations of all words of all documents are likeliest. No piece is counted up or down, and the vocabulary itself stays as it is.

Defined results: a null or empty text has log probability 0 and null bits per byte. Repeated rows
are counted and scored each. Texts are scored whole, at any length. Ties do not arise; a null doc_id stays null. An empty table gives none, and without a
document the exponent is 1. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, textvec
from .sentencepiece_spans import MODEL

SHIFT = 2.7
SPACE = "▁".encode()
#: Words that a task counts or remembers before it writes them out or starts afresh.
MEMO = 400_000
SCHEMA = "doc_id long, words long, bytes long, logprob double, bits_per_byte double"
_CHUNK = re.compile(r" *[^ ]+| +$")


def chunks(text: str) -> list[str]:
    """A text cut before every run of spaces; the first chunk gets the space that the vocabulary expects in front."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def pieces(path: str = MODEL) -> tuple[list[bytes], np.ndarray, np.ndarray, bool]:
    """Surface bytes of all pieces (empty for control pieces), their scores, which stand for single bytes, and whether the scores are log probabilities."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type == 1 else b"" for p in model.pieces]
    return surface, np.array([p.score for p in model.pieces]), np.array([p.type == 6 for p in model.pieces]), model.trainer_spec.model_type == 1


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for batch in rows:
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(chunks(text))
                    if len(counts) > MEMO:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, path: str = MODEL) -> DataFrame:
    """(piece, n): how often each piece occurs in the best segmentation of the counted words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece as spm

        processor = spm.SentencePieceProcessor(model_file=path)
        total = np.zeros(processor.get_piece_size(), np.int64)
        for batch in rows:
            # the processor puts one space in front itself
            ids = processor.encode([w[1:] for w in batch.column("word").to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for word in ids for i in word), np.int64, int(sizes.sum()))
            np.add.at(total, flat, np.repeat(batch.column("n").to_numpy(), sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    return words.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


@dataclass
class Lattice:
    """Hashes of all pieces and of everything that begins one, with the log probability of those that are pieces."""

    keys: np.ndarray
    logp: np.ndarray
    bytes_logp: np.ndarray
    longest: int


def worth(path: str = MODEL) -> np.ndarray:
    """What the file's scores make of each piece; -inf for control pieces. Pieces for single bytes, which have no score of their own in a file of merges, come last."""
    surface, score, single, logs = pieces(path)
    value = score if logs else -np.log(np.where(single, len(surface), np.clip(-score, 0, len(surface))) + SHIFT)
    return np.where([bool(s) for s in surface], value, -np.inf)


def exponent(counts: dict[int, int], path: str = MODEL) -> float:
    """The exponent under which the counted pieces are likeliest: there the mean worth of the pieces is that of the counts."""
    value = worth(path)
    usable = np.isfinite(value)
    n = np.zeros(len(value))
    for piece, k in counts.items():
        n[piece] = k
    n = n[usable]
    value = value[usable]
    if not n.sum():
        return 1.0
    target = float((n * value).sum() / n.sum())
    low, high = 1e-3, 64.0
    for _ in range(80):
        middle = (low + high) / 2
        p = np.exp(middle * (value - value.max()))
        low, high = (middle, high) if (p * value).sum() / p.sum() < target else (low, middle)
    return (low + high) / 2


def lattice(exponent: float = 1.0, path: str = MODEL) -> Lattice:
    surface, _, single, _ = pieces(path)
    logp = exponent * worth(path)
    logp = logp - (top := logp.max()) - np.log(np.exp(logp - top).sum())
    bytes_logp = np.full(256, -50.0)
    best: dict[bytes, float] = {}
    for s, p, one in zip(surface, logp.tolist(), single.tolist()):
        if one:
            bytes_logp[s[0]] = p
        elif s:
            best[s] = p
    begins = {s[:k] for s in best for k in range(1, len(s))} - best.keys()
    texts = [*best, *begins]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    keys = textvec.hash_spans(raw, np.concatenate([[0], ends[:-1]]), ends)
    values = np.concatenate([np.array(list(best.values())), np.full(len(begins), -np.inf)])
    order = np.argsort(keys)
    return Lattice(keys[order], values[order], bytes_logp, max(map(len, best)))


def marginals(model: Lattice, words: list[str]) -> np.ndarray:
    """Log probability of every word (a chunk, spaces in front), summed over all its segmentations."""
    raws = [w.encode().replace(b" ", SPACE) for w in words]
    buf = np.frombuffer(b"".join(raws), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(raws)), size)
    limit = at[1:][owner]
    up, down = textvec.powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    lead = (buf & 0xC0) != 0x80
    live, edges, known = np.flatnonzero(lead), [], np.zeros(len(buf), bool)
    width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
    for length in range(1, model.longest + 1):
        live = live[live + length <= limit[live]]
        if not len(live):
            break
        h = textvec.mix((prefix[live + length] - prefix[live]) * down[live] + np.uint64(length))
        i = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        hit = model.keys[i] == h
        live, p = live[hit], model.logp[i[hit]]
        piece = p > -np.inf
        starts = live[piece]
        edges.append((starts, starts + length, p[piece]))
        known[starts[width[starts] == length]] = True
    odd = np.flatnonzero(lead & ~known)
    if len(odd):
        total = np.concatenate([[0.0], np.cumsum(model.bytes_logp[buf])])
        edges.append((odd, odd + width[odd], total[np.minimum(odd + width[odd], len(buf))] - total[odd]))
    start, end, p = (np.concatenate([e[k] for e in edges]) for k in range(3))
    word = owner[start]
    # forward values live at one place for each byte and one more for each word's end
    start, end = start + word, end + word
    far = end - (at[:-1] + np.arange(len(raws)))[word]
    order = np.lexsort((end, far))
    start, end, p, far = start[order], end[order], p[order], far[order]
    alpha = np.full(len(buf) + len(raws), -np.inf)
    alpha[at[:-1] + np.arange(len(raws))] = 0
    groups = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]]))
    for a, b in zip(groups, np.append(groups[1:], len(far))):
        value = alpha[start[a:b]] + p[a:b]
        to = end[a:b]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(value, first)
        spread = np.repeat(top, np.diff(np.append(first, len(to))))
        alpha[to[first]] = top + np.log(np.add.reduceat(np.exp(value - spread), first))
    return alpha[at[1:] + np.arange(len(raws))]


class Memo:
    def __init__(self, model: Lattice):
        self.model, self.known = model, {}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and log probability of each text."""
        if len(self.known) > MEMO:
            self.known = {}
        parts = [chunks(t) if t else [] for t in texts]
        flat = [w for p in parts for w in p]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self.known.update(zip(new, marginals(self.model, new).tolist()))
        value = np.fromiter(map(self.known.__getitem__, flat), float, len(flat))
        sizes = np.array([len(p) for p in parts], np.int64)
        total = np.concatenate([[0.0], np.cumsum(value)])
        ends = np.cumsum(sizes)
        return sizes, total[ends] - total[ends - sizes]


def train(documents: DataFrame, path: str = MODEL) -> Lattice:
    """Counts pieces over all documents; what comes to the driver has at most one row a piece."""
    counts = piece_counts(word_counts(documents), path)
    return lattice(exponent({r["piece"]: r["n"] for r in counts.collect()}, path), path)


def score(documents: DataFrame, model: Lattice) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)
    memo: list[Memo] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not memo:
            memo.append(Memo(shared.value))
        texts = batch.column("text").to_pylist()
        words, logp = memo[0].score(texts)
        size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
        bits = [round(-v / np.log(2) / s, 6) if s else None for v, s in zip(logp, size)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(size), pa.array(np.round(logp, 4) + 0.0), pa.array(bits, pa.float64())], ["doc_id", "words", "bytes", "logprob", "bits_per_byte"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return batches.map_text(texts, run, SCHEMA)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = batches.read(spark, sf_dir, "documents")
    return score(documents, train(documents))
