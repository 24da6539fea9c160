"""N-gram Jaccard self-join by grouped prefixes.

A document is the set of its word n-grams. Under one order of all n-grams, two sets with Jaccard
similarity t or more share an n-gram among their first |x| - ceil(t |x|) + 1, their prefixes; of the smaller set the first
|y| - ceil(2t / (1 + t) |y|) + 1 will do. Documents
with the same prefix and size are one cell, and so are those of a class of sizes whose prefixes, of the n-grams that many documents have, begin with the same one at the frequency that most of these have:
texts with many near copies. Cells that hold a common prefix n-gram and whose sizes
allow the threshold are candidates. Members of small cells are paired, compared by parity sketches that bound
the overlap from above, and what is left is verified on the whole sets; large cells are cut into blocks, and all members of two blocks
are compared by one product of matrices, so that nothing is sent for a pair. Any cells give the same result.

The order puts rare n-grams first. Document frequencies are counted over all documents in 2^CELL_BITS cells, to which the leading
bits of the hash assign the n-grams, and one byte a cell, the logarithm of its count, is sent to every task: as much for any input. A cell
that rare n-grams share with a frequent one counts as frequent. Any order gives the same result; a coarser one only makes more candidates.

Documents with equal sets are one variant, so that a thousand copies cost one comparison. ``classes`` has a row for every document: its class, which is the
least doc_id that links lead to, and its number of links, which are the documents at or above the threshold, copies among them. Each task adds up
the links of its blocks and names one member of each connected part, so the rows grow as the documents do. ``pairs`` expands
verified pairs of variants to their members: a row is a pair of documents, doc_id_a < doc_id_b, with its Jaccard similarity,
and copies are pairs of similarity 1. All pairs at or above the threshold are found.

Defined results: null, empty or wordless texts have no n-gram and no partner: a class of their own, without links. A text of fewer than N
words has one n-gram, all its words. Rows without doc_id take no part (``keep_one`` keeps them). A
repeated row counts once; a doc_id with several texts is paired by each, and never with itself; its links are the pairs of its texts with those of others, and its class holds what any of its texts is linked to. An empty table has no rows. Texts are read
whole, at any length. A similarity equal to the threshold is a pair. Extra columns, whatever their names, are ignored by ``classes`` and ``pairs`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import batches, textvec

N = 2
THRESHOLD = 0.7
#: Cells of the broadcast order, as a power of two.
CELL_BITS = 24
#: Keys that a task holds before it writes them out.
FLUSH = 1_500_000
#: Variants of one verifying task are split into blocks of about this many.
BLOCK = 512
#: Rows of a lookup that may be broadcast; more go through a shuffled join.
BROADCAST_ROWS = 500_000
#: An n-gram makes a cell if it is counted 2^CELL_RANK times at least, and 2^ABOVE_MEDIAN times as often as a cell of the order usually is.
CELL_RANK = 5
ABOVE_MEDIAN = 4
#: Cells of so many variants are compared as blocks, of about so many sets and n-grams.
DENSE = 32
BLOCK_SETS = 1024
BLOCK_GRAMS = 1 << 19
#: Pairs that one n-gram may add to the counts of two blocks at a time.
ADDED = 1 << 20
#: Members of a variant that are expanded together.
MEMBERS = 1024

#: A posting carries the logarithm of the size in so many steps, and in the highest bit whether it lies in the shorter prefix.
SIZE_STEPS = 1000
SHORT = 1 << 15
#: In the bit below, whether it comes from the class of sizes beneath.
VISITOR = 1 << 14
#: n-grams of cells that are counted 2^HOT_RANK times have a posting list for each class of sizes.
HOT_RANK = 16


def _buckets(spark: SparkSession) -> int:
    """Bits of the bucket number: a few buckets for each shuffle partition, so that a bucket shrinks as partitions are added."""
    return max(4, math.ceil(math.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct values in ascending order, and the offsets of the rows."""
    values = values.copy()
    for i in range(len(at) - 1):
        values[at[i] : at[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, and the offsets of the rows."""
    return _distinct(*textvec.grams(textvec.words(column), n))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def _pack(values: np.ndarray, bits: int) -> bytes:
    """Ascending numbers: their low bits as they are, the differences of the 16 bits above compressed."""
    kind = "<u2" if bits == 16 else "<u4"
    high = np.diff((values >> values.dtype.type(bits)).astype(np.int64), prepend=0).astype("<u2")
    return len(values).to_bytes(4, "little") + values.astype(kind).tobytes() + zstandard.ZstdCompressor(level=1).compress(high.tobytes())


def _unpack(raw: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    end = 4 + n * bits // 8
    high = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[end:]), "<u2").astype(np.uint64), dtype=np.uint64)
    return (high << np.uint64(bits)) | np.frombuffer(raw[4:end], "<u2" if bits == 16 else "<u4")


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_)]]))


def frequent(documents: DataFrame, n: int = N) -> np.ndarray:
    """For every cell of n-grams the binary logarithm of how often documents hold one of them; all documents are counted."""
    bits = min(CELL_BITS, _buckets(documents.sparkSession))
    width = CELL_BITS - bits

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            first, many = _runs(cells)
            cells = cells[first]
            edges = np.searchsorted(cells, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(width))
            used = np.flatnonzero(np.diff(edges))
            pack = zstandard.ZstdCompressor(level=1).compress
            steps = [np.diff(cells[edges[b] : edges[b + 1]].astype(np.int64), prepend=b << width).astype("<u4") for b in used]
            columns = [pa.array(used.astype(np.int32)), pa.array([pack(x.tobytes()) for x in steps], pa.binary()), pa.array([pack(many[edges[b] : edges[b + 1]].astype("<u4").tobytes()) for b in used], pa.binary())]
            held.clear()
            batches.trim()
            return pa.RecordBatch.from_arrays(columns, ["bucket", "cells", "counts"])

        for batch in rows:
            for part in batches.text_slices(batch, "text"):
                held.append((_sets(part.column("text"), n)[0] >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, np.int64)
        read = lambda raw: np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")
        for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist()):
            total[np.cumsum(read(cells), dtype=np.int64)] += read(counts)
        batches.trim()
        return pa.table({"bucket": table["bucket"].slice(0, 1), "ranks": pa.array([np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()], pa.binary())})

    counted = _texts(documents).select("text").mapInArrow(count, "bucket int, cells binary, counts binary")
    ranks = np.zeros(1 << CELL_BITS, np.uint8)
    # the driver gets one byte a cell, whatever the size of the input
    for row in counted.groupBy("bucket").applyInArrow(merge, "bucket int, ranks binary").toLocalIterator():
        ranks[row["bucket"] << width : (row["bucket"] + 1) << width] = np.frombuffer(row["ranks"], np.uint8)
    return ranks


def ordered(g: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """n-gram hashes as numbers whose order is the global order: frequency first, then 56 bits of the hash."""
    cell = (g >> np.uint64(64 - (len(ranks).bit_length() - 1))).astype(np.int64)
    return (ranks[cell].astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))


def slack(threshold: float) -> int:
    """How many steps the sizes of two sets may be apart."""
    return int(-math.log(threshold) * SIZE_STEPS) + 2


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def cell_rank(ranks: np.ndarray) -> int:
    """The rank from which an n-gram makes a cell: where cells of the order are full, a rare n-gram has the rank of what it shares one with."""
    return max(CELL_RANK, int(np.median(ranks)) + ABOVE_MEDIAN)


def _fold(values: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the values of each row, whose order is fixed by the values."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(textvec.mix(values + np.uint64(seed)), dtype=np.uint64)])
    return textvec.mix(total[at[1:]] - total[at[:-1]] + np.uint64(seed))


class Sets:
    """The ordered sets of a slice of documents with their cell and variant keys."""

    def __init__(self, column: pa.Array, n: int, threshold: float, hot, floor: int = CELL_RANK):
        g, at = textvec.grams(textvec.words(column), n)
        self.value, self.at = _distinct(ordered(g, hot), at)
        self.size = np.diff(self.at)
        value = self.value
        self.prefix = np.where(self.size > 0, prefix_size(self.size, threshold), 0)
        self.set = _fold(value, self.at, 11).view(np.int64)
        self.where = batches.ragged(self.at[:-1], self.prefix)
        ends = np.concatenate([[0], np.cumsum(self.prefix)])
        # 48 bits: two cells that happen to share a number are one, which changes no result
        self.cell = (textvec.mix(_fold(value[self.where], ends, 13) + self.size.astype(np.uint64)) >> np.uint64(16)).view(np.int64)
        self.steps = np.minimum(np.log(np.maximum(self.size, 1)) * SIZE_STEPS, VISITOR - 1).astype("<u2")
        # two sets near enough in size are of one class or of neighbours
        self.kind = (self.steps // (slack(threshold) + 1)).astype(np.uint64)
        # near copies share the n-grams of the rank that most of the prefix has, whatever was put into each
        rank = value[self.where] >> np.uint64(56)
        often = np.flatnonzero(rank >= floor)
        row = np.repeat(np.arange(len(self.size)), self.prefix)[often]
        first, long = _runs(row.astype(np.uint64) << np.uint64(8) | rank[often])
        order = np.lexsort((long, row[first]))
        order = order[np.append(np.diff(row[first][order]) > 0, True)] if len(order) else order
        many, key = row[first][order], value[self.where][often[first[order]]]
        self.cell[many] = (textvec.mix(key + (self.kind[many] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(16)).view(np.int64)

    def sketch(self, i: int) -> bytes:
        """Parity of how many members fall on each of about as many bits as there are members, 64 at least."""
        bits = 1 << max(6, int(self.size[i] - 1).bit_length())
        at = textvec.mix(self.value[self.at[i] : self.at[i + 1]] + np.uint64(19)) & np.uint64(bits - 1)
        return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of how many members two sets do not share, from their sketches; the longer one is folded."""
    while len(a) > len(b):
        a = (int.from_bytes(a[: len(a) // 2], "little") ^ int.from_bytes(a[len(a) // 2 :], "little")).to_bytes(len(a) // 2, "little")
    while len(b) > len(a):
        b = (int.from_bytes(b[: len(b) // 2], "little") ^ int.from_bytes(b[len(b) // 2 :], "little")).to_bytes(len(b) // 2, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _members(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
    keep = sets.size > 0
    return pa.RecordBatch.from_arrays([pa.array(sets.cell[keep]), pa.array(sets.set[keep]), pa.array(sets.size[keep].astype(np.int32)), batch.column("doc_id").filter(pa.array(keep)), pa.array([sets.sketch(i) for i in np.flatnonzero(keep)], pa.binary())], ["cell", "variant", "size", "doc_id", "sketch"])


def variants(documents: DataFrame, shared, floor: int, n: int, threshold: float) -> DataFrame:
    """(cell, variant, size, sketch, docs, rows): all documents, collapsed; written to the shared folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _members(batch, Sets(batch.column("text"), n, threshold, shared.value, floor))

    members = batches.map_text(_texts(documents), run, "cell long, variant long, size int, doc_id long, sketch binary")
    return batches.cut(members.groupBy("cell", "variant").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.sort_array(F.collect_set("doc_id")).alias("docs"), F.count("*").alias("rows")))


def _distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """The distinct columns of two rows of numbers, in order."""
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    return pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])] if pairs.shape[1] else pairs


def candidates(documents: DataFrame, shared, floor: int, n: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of cells, a < b, with members that share a prefix n-gram and pass the size filter."""
    bits = _buckets(documents.sparkSession)
    far = slack(threshold)

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(batch.column("text"), n, threshold, shared.value, floor)
        _, one = np.unique(sets.set, return_index=True)
        one = one[sets.size[one] > 0]
        length = sets.prefix[one]
        where = batches.ragged(sets.at[:-1][one], length)
        token = textvec.mix(sets.value[where] + np.uint64(17))
        before = np.concatenate([np.zeros(1, np.uint64), token[:-1]]) & np.uint64(0xFFFFFFFF) if len(token) else token
        before = np.maximum(before, np.uint64(1))
        starts = np.cumsum(length) - length
        before[starts] = 0
        group = np.repeat(sets.cell[one], length)
        size = np.repeat(sets.steps[one], length)
        short = sets.size[one] - np.ceil(2 * threshold / (1 + threshold) * sets.size[one] - 1e-9).astype(np.int64) + 1
        place = np.arange(len(token)) - np.repeat(starts, length)
        kind = np.repeat(sets.kind[one], length)
        size[place < np.repeat(short, length)] |= SHORT
        # a set near enough in size is of the same class or the next one: every hot posting lies in the lists of both
        hot = np.flatnonzero(sets.value[where] >> np.uint64(56) >= HOT_RANK)
        in_class = lambda k: textvec.mix(token[hot] + (kind[hot] + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93))
        home, next_ = in_class(1), in_class(2)
        token[hot] = home
        token, group, before, size = np.concatenate([token, next_]), np.concatenate([group, group[hot]]), np.concatenate([before, before[hot]]), np.concatenate([size, size[hot] | VISITOR])
        order = np.argsort(token)
        token, group = token[order], group[order]
        edges = np.searchsorted(token >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        low = ((token >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        parts = [(group & 0xFFFFFFFF).astype("<u4"), (group >> 32).astype("<u2"), size[order], before.astype("<u4")[order]]
        used = np.flatnonzero(np.diff(edges))
        columns = [pa.array(used.astype(np.int32)), pa.array([_pack(low[edges[b] : edges[b + 1]], 16) for b in used], pa.binary())] + [pa.array([p[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()) for p in parts]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "token", "low", "high", "size", "before"])

    def pair(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        token = np.concatenate([_unpack(x, 16) for x in table["token"].to_pylist()]).astype(np.uint32)
        group = (read("high", "<u2").astype(np.int64) << 32) | read("low", "<u4")
        size, before = read("size", "<u2").astype(np.int32), read("before", "<u4")
        short, visitor, size = size >= SHORT, size & VISITOR > 0, size & (VISITOR - 1)
        # only n-grams that several postings hold can make a pair
        order = np.argsort(token, kind="stable")
        first, many = _runs(token[order])
        order = order[np.repeat(many > 1, many)]
        token, group, size, before, short, visitor = (x[order] for x in (token, group, size, before, short, visitor))
        # the members of a cell that hold an n-gram are one posting, with the range of their sizes
        order = np.lexsort((group, token))
        token, group, size, before, short, visitor = (x[order] for x in (token, group, size, before, short, visitor))
        if len(token):
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
            low, high, short = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.logical_or.reduceat(short, first)
            before = np.where(np.minimum.reduceat(before, first) == np.maximum.reduceat(before, first), before[first], 0)
            token, group, visitor = token[first], group[first], np.logical_and.reduceat(visitor, first)
            order = np.lexsort((group, low, token))
            token, group, low, high, before, short, visitor = (x[order] for x in (token, group, low, high, before, short, visitor))
        active, step, found, held = np.arange(len(token)), 1, [], 0
        while len(active):
            active = active[active + step < len(token)]
            other = active + step
            near = (token[active] == token[other]) & (low[other] - high[active] <= far)
            active, other = active[near], other[near]
            # the pair was met at the n-gram before, if that is the same in both prefixes
            fresh = (before[active] != before[other]) | (before[active] == 0)
            # the smaller set of a pair needs only its shorter prefix; sizes that round to the same may be either way round
            fresh &= short[active] | (short[other] & (low[other] <= high[active]))
            # two visitors meet in the class beneath
            fresh &= ~(visitor[active] & visitor[other])
            a, b = group[active[fresh]], group[other[fresh]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            held += len(a)
            if held > 4_000_000:
                found, held = [_distinct_pairs(np.concatenate(found, axis=1))], 0
            step += 1
        pairs = _distinct_pairs(np.concatenate(found, axis=1)) if found else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[0] != pairs[1]]
        batches.trim()
        return pa.table({"a": pairs[0], "b": pairs[1]})

    posted = batches.map_text(_texts(documents).select("text"), post, "bucket int, token binary, low binary, high binary, size binary, before binary")
    return posted.groupBy("bucket").applyInArrow(pair, "a long, b long").distinct()


def common(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """How many members each of the sets p shares with each of the sets q.

    Members that many of both hold are columns of a product of matrices; what few hold is counted pair by pair.
    """
    total = np.zeros((len(p), len(q)), np.float32)
    flat = [np.concatenate(x) for x in (p, q)]
    shared = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    sides = []
    for x, values in zip((p, q), flat):
        row = np.repeat(np.arange(len(x)), [len(v) for v in x])
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        keep = np.flatnonzero(shared[at] == values) if len(shared) else np.zeros(0, np.int64)
        order = keep[np.argsort(at[keep], kind="stable")]
        sides.append((at[order], row[order], np.bincount(at[order], minlength=len(shared))))
    (at_p, row_p, many_p), (at_q, row_q, many_q) = sides
    heavy = many_p * many_q > max(64, total.size // 32)
    columns = np.flatnonzero(heavy)
    for low in range(0, len(columns), 2048):
        part = columns[low : low + 2048]
        place = np.full(len(shared), -1)
        place[part] = np.arange(len(part))
        dense = []
        for at, row, n in ((at_p, row_p, len(p)), (at_q, row_q, len(q))):
            m = np.zeros((n, len(part)), np.float32)
            own = place[at] >= 0
            m[row[own], place[at[own]]] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    # every occurrence in p meets those in q of the same member
    starts, light = np.cumsum(many_q) - many_q, np.flatnonzero(~heavy[at_p])
    made = np.cumsum(many_q[at_p[light]])
    while len(light):
        stop = max(1, int(np.searchsorted(made, ADDED, side="right")))
        some, light, made = light[:stop], light[stop:], made[stop:] - made[stop - 1]
        length = many_q[at_p[some]]
        cell = np.repeat(row_p[some], length) * len(q) + row_q[batches.ragged(starts[at_p[some]], length)]
        total += np.bincount(cell, minlength=total.size).reshape(total.shape)
    return total


def _parts(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the least row of their connected part; what has no link has the number of rows."""
    none = linked.shape[0]
    row = np.where(linked.any(axis=1), np.arange(none), none)
    while True:
        column = np.where(linked, row[:, None], none).min(axis=0, initial=none)
        nearer = np.minimum(row, np.where(linked, column[None, :], none).min(axis=1, initial=none))
        if (nearer == row).all():
            return row, column
        row = nearer


FOUND = {True: "va long, vb long, jaccard double", False: "v long, o long, docs long, id long"}


def _verify(threshold: float, expand: bool):
    """Compares the pairs that are asked for, or else each set of side 0 with each of side 1, or all of side 2 with one another.

    With expand a row is a pair at or above the threshold. Else a row says that variant v has so many documents as partners here and is in one class with o,
    or that a doc_id of several texts has to leave out its pairs with itself.
    """

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        _, first = np.unique(sets["variant"].to_numpy(), return_index=True)
        if len(first) < sets.num_rows:  # rows that repeat a document
            sets = sets.take(pa.array(first))
        held = [_unpack(x, 32) for x in sets["values"].to_pylist()]
        name, size = sets["variant"].to_numpy(), np.array([len(x) for x in held])
        docs, several = sets["copies"].to_numpy().astype(np.float64), sets["several"].to_pylist()
        if pairs.num_rows:
            where = {v: i for i, v in enumerate(name.tolist())}
            i, j = (np.fromiter(map(where.__getitem__, pairs[c].to_pylist()), np.int64, pairs.num_rows) for c in ("va", "vb"))
            shared = np.zeros(len(i))
            for k, (x, y) in enumerate(zip(i, j)):
                p, q = sorted((held[x], held[y]), key=len)
                at = np.searchsorted(q, p)
                at[at == len(q)] = len(q) - 1
                shared[k] = (q[at] == p).sum()
            jaccard = shared / (size[i] + size[j] - shared)
            keep = jaccard >= threshold
            i, j, jaccard = i[keep], j[keep], jaccard[keep]
            v, o = np.concatenate([i, j]), np.concatenate([j, i])
            partners = docs[o]
        else:
            side = sets["side"].to_numpy()
            own = side[0] == 2
            x, y = (np.arange(len(side)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            shared = common([held[k] for k in x], [held[k] for k in y]).astype(np.float64) if len(x) and len(y) else np.zeros((len(x), len(y)))
            similar = shared / (size[x][:, None] + size[y][None, :] - shared)
            linked = similar >= threshold
            if own:
                np.fill_diagonal(linked, False)
            if expand:
                i, j = np.nonzero(np.triu(linked) if own else linked)
                i, j, jaccard = x[i], y[j], similar[i, j]
            else:
                row, column = _parts(linked)
                a, b = np.flatnonzero(row < len(x)), np.flatnonzero(column < len(x))
                weight = linked.astype(np.float64)
                v, o, partners = x[a], x[row[a]], (weight @ docs[y])[a]
                if not own:
                    v, o, partners = np.concatenate([v, y[b]]), np.concatenate([o, x[column[b]]]), np.concatenate([partners, (docs[x] @ weight)[b]])
                # only texts of ids that have several can be of one id
                p, q = (np.flatnonzero([bool(several[k]) for k in s]) for s in (x, y))
                i, j = np.nonzero((np.triu(linked) if own else linked)[np.ix_(p, q)])
                i, j = x[p[i]], y[q[j]]
        batches.trim()
        if expand:
            return pa.table({"va": pa.array(name[i]), "vb": pa.array(name[j]), "jaccard": pa.array(jaccard)})
        same = [d for a, b in zip(i.tolist(), j.tolist()) if several[a] and several[b] for d in set(several[a]) & set(several[b])]
        none, total = [None] * len(same), len(v)
        return pa.table({
            "v": pa.array(name[v].tolist() + none, pa.int64()), "o": pa.array(name[o].tolist() + none, pa.int64()),
            "docs": pa.array(partners.astype(np.int64).tolist() + [-2] * len(same), pa.int64()), "id": pa.array([None] * total + same, pa.int64()),
        })

    return run


def _small(known: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(a_variant, a_rep, b_variant, b_rep, task) of pairs of members of small cells whose sketches allow the threshold.

    Pairs are gathered at the least variant that either side meets, so that a set is sent about once to
    each place that compares it, however many partners it has there.
    """
    side = known.select("cell", "variant", "size", "sketch", F.col("docs")[0].alias("rep"))
    left, right = (side.select(*[F.col(c).alias(f"{p}_{c}") for c in side.columns]) for p in "ab")
    across = met.join(left, F.col("a") == F.col("a_cell")).join(right, F.col("b") == F.col("b_cell"))
    within = left.join(right, (F.col("a_cell") == F.col("b_cell")) & (F.col("a_variant") < F.col("b_variant")))
    close = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-6
    picked = ["a_variant", "a_rep", "b_variant", "b_rep", "a_size", "b_size", "a_sketch", "b_sketch"]

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            total = batch.column("a_size").to_numpy().astype(np.int64) + batch.column("b_size").to_numpy()
            least = np.fromiter(map(apart, batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist()), np.int64, batch.num_rows)
            # |x and y| = (|x| + |y| - unshared) / 2 must reach t / (1 + t) (|x| + |y|)
            yield batch.select(picked[:4]).filter(pa.array(least <= total * (1 - threshold) / (1 + threshold) + 1e-6))

    pairs = across.select(*picked).union(within.select(*picked)).where(close).mapInArrow(near, "a_variant long, a_rep long, b_variant long, b_rep long")
    pairs = batches.cut(pairs)
    ends = pairs.select(F.col("a_variant").alias("v"), F.col("b_variant").alias("o")).union(pairs.select("b_variant", "a_variant"))
    least = ends.groupBy("v").agg(F.least(F.first("v"), F.min("o")).alias("home"))
    at = lambda p: least.select(F.col("v").alias(f"{p}_variant"), F.col("home").alias(f"{p}_home"))
    placed = pairs.join(at("a"), "a_variant").join(at("b"), "b_variant").withColumn("home", F.least("a_home", "b_home")).drop("a_home", "b_home")
    sizes = placed.groupBy("home").agg(F.count("*").alias("pairs"))
    # m variants have up to m^2 / 2 pairs, so the square root of the pairs tells how many blocks there are
    blocks = F.ceil(F.sqrt(2.0 * F.col("pairs")) / BLOCK).cast("long")
    placed = placed.join(sizes, "home").withColumn("blocks", blocks)
    block = lambda p: F.pmod(F.xxhash64(f"{p}_variant"), F.col("blocks"))
    return batches.cut(placed.withColumn("x", block("a")).withColumn("y", block("b")).select(
        "a_variant", "a_rep", "b_variant", "b_rep", F.xxhash64("home", F.least("x", "y"), F.greatest("x", "y")).alias("task")))


def _large(known: DataFrame, met: DataFrame, big: DataFrame) -> DataFrame:
    """(rep, variant, task, side) of blocks of large cells, which meet one another and blocks of all cells that are candidates of theirs.

    met has (host, guest), of which the host is large; a pair of cells is there once.
    """
    one = known.select("cell", "variant", F.col("docs")[0].alias("rep"), "size")
    guests = batches.cut(met.join(one, F.col("guest") == F.col("cell")).select("host", "variant", "rep", "size"))
    rows = guests.groupBy("host").agg(_blocks(F.count("*"), F.sum("size")).alias("chunks"))
    hosts = big.join(rows, F.col("cell") == F.col("host"), "left").select(F.col("cell").alias("host"), "blocks", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    # apart from the hash that places rows, which the rows of a cell would share
    at = lambda parts: F.pmod(F.xxhash64("variant", F.lit(1)), F.col(parts))
    home = one.join(hosts, F.col("cell") == F.col("host")).withColumn("at", at("blocks"))
    other = home.select("host", "rep", "variant", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    inner = other.select("rep", "variant", F.xxhash64("host", F.lit(0), F.least("at", "to"), F.greatest("at", "to")).alias("task"), F.expr("CASE WHEN at = to THEN 2 WHEN at < to THEN 0 ELSE 1 END").alias("side"))
    outer = home.where("chunks > 0").select("host", "rep", "variant", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("to"))
    outer = outer.select("rep", "variant", F.xxhash64("host", F.lit(1), "at", "to").alias("task"), F.lit(0).alias("side"))
    guest = guests.join(hosts, "host").withColumn("at", at("chunks"))
    guest = guest.select("host", "rep", "variant", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    return inner.union(outer).union(guest.select("rep", "variant", F.xxhash64("host", F.lit(1), "to", "at").alias("task"), F.lit(1).alias("side")))


def _blocks(sets, grams):
    return F.ceil(F.greatest(sets / BLOCK_SETS, grams / BLOCK_GRAMS)).cast("long")


def verified(documents: DataFrame, shared, floor: int, known: DataFrame, met: DataFrame, several: DataFrame | None, n: int, threshold: float, expand: bool) -> DataFrame:
    """What ``_verify`` finds in all pairs of variants at or above the threshold; each pair is compared in one task."""
    big = known.groupBy("cell").agg(F.count("*").alias("sets"), F.sum("size").alias("grams")).where(F.col("sets") >= DENSE)
    big = batches.cut(big.select("cell", _blocks(F.col("sets"), F.col("grams")).alias("blocks")))
    a, b = (big.select(F.col("cell").alias(p), F.col("blocks").alias(f"{p}_blocks")) for p in "ab")
    met = batches.cut(met.join(a, "a", "left").join(b, "b", "left"))
    placed = _small(known.join(big, "cell", "left_anti"), met.where("a_blocks IS NULL AND b_blocks IS NULL").select("a", "b"), threshold)
    first = F.expr("b_blocks IS NULL OR a_blocks >= b_blocks")
    hosted = met.where("a_blocks IS NOT NULL OR b_blocks IS NOT NULL").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"))
    needed = placed.select(F.col("a_rep").alias("rep"), F.col("a_variant").alias("variant"), "task", F.lit(2).alias("side")).union(placed.select("b_rep", "b_variant", "task", F.lit(2)))
    needed = needed.union(_large(known, hosted, big)).groupBy("rep", "variant").agg(F.collect_set(F.struct("task", "side")).alias("tasks"))
    needed = batches.cut(needed)
    few = batches.fits_broadcast(needed, BROADCAST_ROWS)
    # what is counted of a variant goes with its set
    told = known.select("variant", F.size("docs").alias("copies"))
    told = told.join(several, "variant", "left") if several is not None else told.withColumn("several", F.lit(None).cast("array<long>"))
    needed = needed.join(told, "variant")
    texts = _texts(documents).join(F.broadcast(needed) if few else needed, F.col("doc_id") == F.col("rep")).select("text", "variant", "tasks", "copies", "several")

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(batch.column("text"), n, threshold, shared.value, floor)
        wanted = batch.column("variant").to_numpy(zero_copy_only=False)
        row, task, side, values = [], [], [], []
        for i, tasks in enumerate(batch.column("tasks").to_pylist()):
            if sets.set[i] == wanted[i]:  # a doc_id may have several texts
                raw = _pack(np.sort(textvec.mix(sets.value[sets.at[i] : sets.at[i + 1]]) >> np.uint64(16)), 32)
                for t in tasks:
                    row.append(i), task.append(t["task"]), side.append(t["side"]), values.append(raw)
        own = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(side, pa.int32()), *(batch.column(c).take(own) for c in ("variant", "copies", "several")), pa.array(values, pa.binary())], ["task", "side", "variant", "copies", "several", "values"])

    sent = batches.map_text(texts, send, "task long, side int, variant long, copies int, several array<long>, values binary")
    ask = placed.select(F.col("a_variant").alias("va"), F.col("b_variant").alias("vb"), "task")
    return ask.groupBy("task").cogroup(sent.groupBy("task")).applyInArrow(_verify(threshold, expand), FOUND[expand])


def _joined(documents: DataFrame, n: int, threshold: float, expand: bool = False) -> tuple:
    """The broadcast order of n-grams, all variants, what is found in pairs of them that are near, and (variant, id) of doc_ids that have several variants."""
    ranks = frequent(documents, n)
    shared, floor = documents.sparkSession.sparkContext.broadcast(ranks), cell_rank(ranks)
    known = variants(documents, shared, floor, n, threshold)
    met = candidates(documents, shared, floor, n, threshold)
    owners = known.select("variant", F.explode("docs").alias("id"))
    repeated = batches.cut(owners.groupBy("id").count().where("count > 1").select("id"))
    repeated = None if repeated.isEmpty() else batches.cut(owners.join(repeated, "id").select("variant", "id"))
    several = None if repeated is None else repeated.groupBy("variant").agg(F.collect_list("id").alias("several"))
    return shared, known, batches.cut(verified(documents, shared, floor, known, met, several, n, threshold, expand)), repeated


def pairs(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all pairs of documents at or above the threshold, doc_id_a < doc_id_b.

    Variants are expanded to their members last, in blocks of ids that are spread over all tasks, so that the pairs of a large
    group do not fall to one of them.
    """
    _, known, found, _ = _joined(documents, n, threshold, True)
    steps = f"transform(sequence(0, (size(docs) - 1) div {MEMBERS}), i -> struct(i AS at, slice(docs, i * {MEMBERS} + 1, {MEMBERS}) AS docs))"
    blocks = known.select("variant", F.explode(F.expr(steps)).alias("block")).select("variant", "block.at", "block.docs")
    a, b = (blocks.select(F.col("variant").alias(f"v{p}"), F.col("at").alias(f"at_{p}"), F.col("docs").alias(f"docs_{p}")) for p in "ab")
    across = found.join(a, "va").join(b, "vb").select("docs_a", "docs_b", "jaccard", F.lit(False).alias("copies"))
    several = known.where(F.size("docs") > 1).select("variant")
    copies = several.join(a, F.col("variant") == F.col("va")).join(b, (F.col("variant") == F.col("vb")) & (F.col("at_a") <= F.col("at_b")))
    both = across.union(copies.select("docs_a", "docs_b", F.lit(1.0), F.lit(True))).repartition(F.xxhash64("docs_a", "docs_b"))
    one = both.select(F.explode("docs_a").alias("a"), "docs_b", "jaccard", "copies").select("a", F.explode("docs_b").alias("b"), "jaccard", "copies")
    one = one.where("a < b OR (a > b AND NOT copies)")
    return one.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), F.round("jaccard", 6).alias("jaccard"))


def classes(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document: the least doc_id that links lead to, and how many pairs at or above the threshold it is in."""
    _, known, found, repeated = _joined(documents, n, threshold)
    edges = found.where("v != o").select(F.col("v").alias("a"), F.col("o").alias("b"))
    if repeated is not None:
        # the texts of an id are of one class
        least = repeated.groupBy("id").agg(F.min("variant").alias("a"))
        edges = edges.union(repeated.join(least, "id").where("a != variant").select("a", "variant"))
    labels = components(edges).select(F.col("node").alias("variant"), "label")
    partners = found.where("v IS NOT NULL").groupBy(F.col("v").alias("variant")).agg(F.sum("docs").alias("partners"))
    placed = known.select("variant", "docs").join(labels, "variant", "left").join(partners, "variant", "left")
    placed = batches.cut(placed.select(F.coalesce("label", "variant").alias("label"), "docs", (F.coalesce("partners", F.lit(0)) + F.size("docs") - 1).alias("links")))
    least = placed.groupBy("label").agg(F.min(F.col("docs")[0]).alias("class_id"))
    rows = placed.join(least, "label").select(F.explode("docs").alias("doc_id"), "class_id", "links")
    no_class = F.lit(None).cast("long").alias("class_id")
    rows = rows.union(found.where("id IS NOT NULL").select("id", no_class, "docs"))
    rows = rows.union(documents.select(F.col("doc_id").cast("long").alias("doc_id"), no_class, F.lit(0).cast("long")).where("doc_id IS NOT NULL"))
    rows = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b).

    Every round a node takes the least label next to it, then the label of its label; rounds are written out.
    """
    both = batches.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = batches.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = batches.cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


def keep_one(documents: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of a connected group whose doc_id is not the least of the group; all columns stay.

    A document is a doc_id with a variant: each text of a doc_id that has several stays or goes with its own group, and one row of
    those that repeat a document stays. Texts without words are in no group.
    """
    shared, known, found, _ = _joined(documents, n, threshold)
    labels = components(found.where("v != o").select(F.col("v").alias("a"), F.col("o").alias("b")))
    placed = known.join(labels, known["variant"] == labels["node"], "left").select(F.coalesce("label", "variant").alias("label"), "variant", "docs")
    least = placed.groupBy("label").agg(F.min(F.struct(F.col("docs")[0].alias("id"), "variant")).alias("kept"))
    least = placed.select("label", "variant", F.explode("docs").alias("id")).join(least, "label")
    id_, of, text = batches.unused(documents, "id", "of", "text")
    gone = batches.cut(least.where("id != kept.id OR variant != kept.variant").select(F.col("id").alias(id_), F.col("variant").alias(of)))
    if batches.fits_broadcast(gone, 4 * BROADCAST_ROWS):
        gone = F.broadcast(gone)
    key = F.col("doc_id").cast("long")
    several = batches.cut(documents.where("doc_id IS NOT NULL").groupBy(key.alias(id_)).count().where("count > 1").select(id_))
    if several.isEmpty():
        return documents.join(gone, key == F.col(id_), "left_anti")
    if batches.fits_broadcast(several, 4 * BROADCAST_ROWS):
        several = F.broadcast(several)
    single = documents.join(several, key == F.col(id_), "left_anti").join(gone, key == F.col(id_), "left_anti")
    own = _with_variant(documents.join(several, key == F.col(id_), "left_semi"), shared, n, threshold, of, text)
    theirs = gone.withColumnRenamed(of, text)
    left = own.join(theirs, (key == F.col(id_)) & (F.col(of) == F.col(text)), "left_anti")
    once = left.where(F.col(of).isNotNull()).dropDuplicates(["doc_id", of])
    return single.union(once.union(left.where(F.col(of).isNull())).select(*[F.col(f"`{c}`") for c in documents.columns]))


def _with_variant(documents: DataFrame, shared, n: int, threshold: float, variant: str, text: str) -> DataFrame:
    """All columns and the variant, null for texts without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(batch.column(text), n, threshold, shared.value)
        columns = [batch.column(c) for c in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sets.set, mask=sets.size == 0)], [*batch.schema.names[:-1], variant])

    schema = StructType([*documents.schema.fields, StructField(variant, LongType())])
    return batches.map_text(documents.withColumn(text, F.col("text").cast("string")), run, schema, text)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(batches.read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{textvec.WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END)) AS grams FROM w WHERE len(w) > 0),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, grams, len(grams) AS n FROM s),
g AS (SELECT d, doc_id, unnest(grams) AS g FROM d),
c AS (SELECT a.d AS da, b.d AS db, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.d, b.d),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN d x ON x.d = c.da JOIN d y ON y.d = c.db WHERE common / (x.n + y.n - common) >= {THRESHOLD}),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
l AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT i.doc_id, least(i.doc_id, coalesce(m.least, i.doc_id)) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN l ON l.doc_id = i.doc_id LEFT JOIN m ON m.doc_id = i.doc_id
"""
