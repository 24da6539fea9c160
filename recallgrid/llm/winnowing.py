"""Benchmark decontamination by winnowing.

Each text is a sequence of words. The hashes of its k-grams are winnowed: of every window of
``WINDOW`` consecutive k-grams the smallest hash is kept (the rightmost on ties). Any two texts that
share ``GUARANTEE`` = WINDOW + K - 1 consecutive words then share a kept hash within the shared words.
Kept hashes of training and test texts are joined and each hit is extended left and right, word by
word, to the maximal shared span; spans below GUARANTEE words are dropped, so the result is exactly
all maximal shared spans of at least GUARANTEE words.

Defined results: null or empty texts and texts with fewer words than the guarantee share nothing. Equal
benchmark rows and equal documents are reported each, and so are several places of a passage. A null id stays null. With an empty table on
either side nothing is shared. Texts are read whole, at any length. Extra
columns, whatever their names, are ignored by ``spans`` and kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, textvec

K = 8
WINDOW = 6
GUARANTEE = K + WINDOW - 1
#: Benchmark bytes that one broadcast holds; a larger benchmark goes through a shuffled join of fingerprints.
BROADCAST_BYTES = 64 << 20

SCHEMA = "doc_id long, item_id long, begin_word int, end_word int, item_begin int, words int"


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Sorted positions of the minima of all windows, rightmost on ties; all of h is one window if it is shorter."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - view.argmin(axis=1))


def fingerprints(w: textvec.Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes of all rows, and the index of the first word of each."""
    count = len(w.hash)
    if count < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count - k + 1, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : count - k + 1 + i]
    g = textvec.mix(total)
    within = w.row[: count - k + 1] == w.row[k - 1 :]
    # One pass over all rows: a window lies within a row if its first and last k-gram do; k-grams across rows never win.
    kept = []
    reach = count - k + 1 - window + 1
    if reach > 0:
        best_at, best = np.arange(reach), g[:reach].copy()
        for i in range(1, window):
            better = g[i : reach + i] <= best
            best_at = np.where(better, np.arange(reach) + i, best_at)
            best = np.where(better, g[i : reach + i], best)
        whole = (w.row[:reach] == w.row[k + window - 2 : reach + k + window - 2])
        kept.append(best_at[whole])
    sizes = np.diff(w.first) - k + 1
    for r in np.flatnonzero((sizes > 0) & (sizes < window)):
        kept.append(w.first[r] + window_minima(g[w.first[r] : w.first[r] + sizes[r]], window))
    at = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    at = at[within[at]] if len(at) else at
    return g[at], at


def extend(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """The maximal run of equal words around a[i] = b[j]: words before and from there on."""
    left = min(i, j)
    x, y = a[i - left : i][::-1], b[j - left : j][::-1]
    differ = np.flatnonzero(x != y)
    back = int(differ[0]) if len(differ) else left
    right = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + right] != b[j : j + right])
    return back, int(differ[0]) if len(differ) else right


class Benchmark:
    """The test side as flat arrays: words of all items, fingerprints sorted by hash."""

    def __init__(self, ids: list, texts: pa.Array, k: int = K, window: int = WINDOW):
        w = textvec.words(texts)
        self.ids, self.hash, self.first, self.k, self.window = np.array([-1 if i is None else i for i in ids], np.int64), w.hash, w.first, k, window
        self.null = np.array([i is None for i in ids], bool)
        g, at = fingerprints(w, k, window)
        order = np.argsort(g, kind="stable")
        self.print, self.at, self.item = g[order], at[order], w.row[at[order]]

    def spans(self, w: textvec.Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word in the row, first word in the item, words) of all maximal shared spans."""
        if not len(self.print):
            return []
        g, at = fingerprints(w, self.k, self.window)
        low, high = np.searchsorted(self.print, g, "left"), np.searchsorted(self.print, g, "right")
        hit = np.flatnonzero(high > low)
        found: set = set()
        diagonals: dict = {}
        pair = batches.ragged(low[hit], (high - low)[hit])
        for p, q in zip(np.repeat(at[hit], (high - low)[hit]).tolist(), pair.tolist()):
            row, item = int(w.row[p]), int(self.item[q])
            i, j = p - int(w.first[row]), int(self.at[q] - self.first[item])
            known = (row, item, i - j)
            if any(s[0] <= i < s[0] + s[2] for s in diagonals.get(known, ())):
                continue
            a, b = w.hash[w.first[row] : w.first[row + 1]], self.hash[self.first[item] : self.first[item + 1]]
            back, on = extend(a, i, b, j)
            diagonals.setdefault(known, []).append((i - back, j - back, back + on))
            if back + on >= self.k + self.window - 1:
                found.add((row, item, i - back, j - back, back + on))
        return sorted(found)


def _emit(ids: pa.Array, bench: Benchmark, spans: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    found = np.array(spans, np.int64).reshape(-1, 5)
    columns = [
        ids.take(pa.array(found[:, 0])),
        pa.array(bench.ids[found[:, 1]], mask=bench.null[found[:, 1]]),
        pa.array(found[:, 2].astype(np.int32)),
        pa.array((found[:, 2] + found[:, 4]).astype(np.int32)),
        pa.array(found[:, 3].astype(np.int32)),
        pa.array(found[:, 4].astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "begin_word", "end_word", "item_begin", "words"])


def _sides(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return d, b.where(F.length("text") > 0)


def _load(benchmark: DataFrame, k: int, window: int) -> Benchmark | None:
    """The benchmark in memory, or None if it is too large for that."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    rows = benchmark.toArrow()
    return Benchmark(rows["item_id"].to_pylist(), rows["text"].combine_chunks().cast(pa.string()), k, window)


def spans(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """All maximal spans of at least k + window - 1 words that a document shares with a benchmark item."""
    d, b = _sides(documents, benchmark)
    loaded = _load(b, k, window)
    if loaded is None:
        return spans_shuffled(documents, benchmark, k, window)
    shared = documents.sparkSession.sparkContext.broadcast(loaded)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _emit(batch.column("doc_id"), shared.value, shared.value.spans(textvec.words(batch.column("text"))))

    return batches.map_text(d, run, SCHEMA)


def _prints(df: DataFrame, k: int, window: int) -> DataFrame:
    """(print, key) for every distinct fingerprint of a text; key stands for the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = textvec.words(batch.column("text"))
        g, at = fingerprints(w, k, window)
        # once for each text of the slice, which keeps a phrase that repeats from being sent as often
        pair = np.unique(np.stack([g.view(np.int64), w.row[at]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), batch.column("key").take(pa.array(pair[1]))], ["print", "key"])

    return batches.map_text(df, run, "print long, key long").distinct()


def _places(first: np.ndarray, second: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of two columns as one number a row, and where each stands first."""
    _, one, same = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
    return same.ravel(), one


def spans_shuffled(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The same spans for a benchmark of any size: fingerprints meet in a shuffled join, then the texts of each hit are compared.

    Only keys of texts go through the first join. Hits lie sorted by benchmark text, so that a slice indexes each of its texts once.
    """
    d, b = _sides(documents, benchmark)
    d, b = d.withColumn("key", F.xxhash64("text")), b.withColumn("key", F.xxhash64("text"))
    hits = _prints(d, k, window).withColumnRenamed("key", "d_key").join(_prints(b, k, window).withColumnRenamed("key", "b_key"), "print").select("d_key", "b_key").distinct()
    pairs = (
        hits.join(d.select(F.col("key").alias("d_key"), F.col("doc_id"), F.col("text")), "d_key")
        .join(b.select(F.col("key").alias("b_key"), F.col("item_id"), F.col("text").alias("item_text")), "b_key")
        .select("d_key", "b_key", "doc_id", "text", "item_id", "item_text")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        null = lambda name: batch.column(name).is_null().to_numpy(zero_copy_only=False)
        number = lambda name: np.where(null(name), 0, batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)) * 2 + null(name)
        doc, doc_at = _places(read("d_key"), number("doc_id"))
        item, item_at = _places(read("b_key"), number("item_id"))
        doc_rows, item_rows = pa.array(doc_at), pa.array(item_at)
        bench = Benchmark(batch.column("item_id").take(item_rows).to_pylist(), batch.column("item_text").take(item_rows), k, window)
        w = textvec.words(batch.column("text").take(doc_rows))
        # pairs of the slice that are no rows of it come from elsewhere; rows that repeat give as many spans
        times: dict[tuple[int, int], int] = {}
        for x, y in zip(doc.tolist(), item.tolist()):
            times[x, y] = times.get((x, y), 0) + 1
        found = [s for s in bench.spans(w) for _ in range(times.get((s[0], s[1]), 0))]
        return _emit(batch.column("doc_id").take(doc_rows), bench, found)

    return batches.map_text(pairs, run, SCHEMA)


def clean(documents: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The documents that share no span of at least k + window - 1 words with the benchmark, with all their columns."""
    _, b = _sides(documents, benchmark)
    loaded = _load(b, k, window)
    if loaded is None:
        (key,) = batches.unused(documents, "key")
        bad = spans_shuffled(documents.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, k, window).select(F.col("doc_id").alias(key)).distinct()
        return documents.join(bad, F.xxhash64("text") == F.col(key), "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(loaded)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        keep[[s[0] for s in shared.value.spans(textvec.words(batch.column("text")))]] = False
        return batch.filter(pa.array(keep))

    return batches.map_text(documents, run, documents.schema)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(batches.read(spark, sf_dir, "documents"), batches.read(spark, sf_dir, "benchmark"))


#: All shared runs of GUARANTEE words lie on diagonals (place in the document minus place in the item); islands on a diagonal are the spans.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{textvec.WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{textvec.WORD_SQL}') AS w FROM benchmark),
dg AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {GUARANTEE}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {GUARANTEE - 1}))) AS i FROM d)),
bg AS (SELECT item_id, j, array_to_string(w[j + 1 : j + {GUARANTEE}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - {GUARANTEE - 1}))) AS j FROM b)),
m AS (SELECT doc_id, item_id, i, j FROM dg JOIN bg USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM m)
SELECT doc_id, item_id, CAST(min(i) AS INTEGER) AS begin_word, CAST(max(i) + {GUARANTEE} AS INTEGER) AS end_word,
       CAST(min(j) AS INTEGER) AS item_begin, CAST(max(i) - min(i) + {GUARANTEE} AS INTEGER) AS words
FROM r GROUP BY doc_id, item_id, i - j, island
"""
