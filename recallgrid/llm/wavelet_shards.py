"""Token shards as wavelet matrices.

Texts are encoded by an existing byte-level vocabulary and gathered to shards. A shard is one compressed
file: its distinct tokens by falling frequency give every token a code, the code's bits from the highest
down are stored as bit planes, each plane in the order that sorts the higher bits stably, so that access, counting
and finding need one rank or select a plane. Planes are cut into blocks of BLOCK bits, each compressed by
itself with the number of ones before it, so a query opens one block a plane. Frequent tokens have small codes, hence
the upper planes are mostly zero and compress well.

Defined results: a null or empty text is a document without tokens; a null doc_id stays null in the list. Repeated
rows are stored each; texts are encoded whole, at any length. A partition without rows makes no shard, an empty table none. Of tokens of equal
frequency the smaller id gets the smaller code. Extra columns are ignored, whatever their names.

Layout: magic, length of the JSON head, head, then the parts that the head lists by name, offset and size.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

RANKS = os.environ.get("RECALLGRID_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The vocabulary's public pattern for splitting text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 4_000_000
BLOCK = 1 << 16
MEMO = 400_000
MAGIC = b"WVMX1\n"
SCHEMA = "shard long, docs int, tokens long, distinct int, bytes long, crc long, doc_ids array<long>, payload binary"


class Tokens:
    """Encodes texts; equal words are encoded once.

    The pattern always starts a new part at a single space between two other characters, so the parts between
    such spaces can be encoded by themselves. Texts with other white space beside a space are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.first, self.odd = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _learn(self, keys: list[str]) -> None:
        """Encodes new keys, words with the space before them; odd ones have white space at an end of the word, or nothing else."""
        found = list(map(self.encoding.encode_ordinary, keys))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        bare = list(map(str.strip, keys))
        odd = np.fromiter((not b or len(b) + (k[0] == " ") != len(k) for k, b in zip(keys, bare)), bool, len(keys))
        self.memo.update(zip(keys, range(len(self.odd), len(self.odd) + len(keys))))
        self.flat, self.odd = np.concatenate([self.flat, flat]), np.concatenate([self.odd, odd])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text's."""
        if len(self.memo) > MEMO:
            self.forget()
        keys, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
                counts[i] = len(words)
                keys += words
        new = [k for k in dict.fromkeys(keys) if k not in self.memo]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))
        sizes = self.first[word + 1] - self.first[word]
        ids = self.flat[batches.ragged(self.first[word], sizes)]
        at = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(sizes)])
        length = total[at[1:]] - total[at[:-1]]
        odd = np.concatenate([[0], np.cumsum(self.odd[word])]) if len(word) else np.zeros(1, np.int64)
        whole = np.flatnonzero((odd[at[1:]] > odd[at[:-1]]) & (counts > 1))
        if len(whole):
            starts = total[at[:-1]]
            parts, last = [], 0
            for i in whole:
                parts += [ids[last : starts[i]], np.array(self.encoding.encode_ordinary(texts[i]), np.uint32)]
                last = starts[i] + length[i]
                length[i] = len(parts[-1])
            ids = np.concatenate([*parts, ids[last:]])
        return ids, length


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard: flat ids and the number of tokens of every document."""
    top = int(ids.max()) + 1 if len(ids) else 1
    counts = np.bincount(ids, minlength=top)
    used = np.flatnonzero(counts)
    alphabet = used[np.lexsort((used, -counts[used]))].astype("<u4")
    code = np.zeros(top, np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    bits = max(1, int(max(len(alphabet) - 1, 1)).bit_length())
    order = code[ids].astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1).compress
    parts: dict[str, bytes] = {"alphabet": press(alphabet.tobytes()), "counts": press(counts[alphabet].astype("<u4").tobytes()), "lengths": press(lengths.astype("<u4").tobytes())}
    zeros = []
    for k in range(bits - 1, -1, -1):
        bit = ((order >> k) & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little").tobytes()
        blocks = [press(packed[a : a + BLOCK // 8]) for a in range(0, len(packed), BLOCK // 8)]
        ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
        parts[f"ones{k}"] = np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()
        parts[f"at{k}"] = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes()
        parts[f"plane{k}"] = b"".join(blocks)
        zeros.append(int(len(bit) - bit.sum()))
        order = np.concatenate([order[~bit], order[bit]])
    head: dict = {"n": len(ids), "docs": len(lengths), "bits": bits, "zeros": zeros, "parts": {}}
    offset = 0
    for name, raw in parts.items():
        head["parts"][name] = [offset, len(raw)]
        offset += len(raw)
    text = json.dumps(head).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *parts.values()])


class Shard:
    """Queries on one file, without unpacking it: a query opens the blocks it needs."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 4
        size = int.from_bytes(payload[at - 4 : at], "little")
        self.head = json.loads(payload[at : at + size])
        self.raw, self.base = payload, at + size
        self.n, self.bits = self.head["n"], self.head["bits"]
        open_ = lambda name, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(self._part(name)), kind)
        self.alphabet, self.counts = open_("alphabet", "<u4"), open_("counts", "<u4")
        self.ends = np.cumsum(open_("lengths", "<u4"), dtype=np.int64)
        self.code = {int(t): i for i, t in enumerate(self.alphabet)}
        self.ones = [np.frombuffer(self._part(f"ones{k}"), "<u8").astype(np.int64) for k in range(self.bits - 1, -1, -1)]
        self.at = [np.frombuffer(self._part(f"at{k}"), "<u8") for k in range(self.bits - 1, -1, -1)]
        self._block = lru_cache(maxsize=64)(self._load)

    def _part(self, name: str) -> bytes:
        offset, size = self.head["parts"][name]
        return self.raw[self.base + offset : self.base + offset + size]

    def _load(self, plane: int, block: int) -> np.ndarray:
        """Ones up to each bit of a block."""
        offset = self.base + self.head["parts"][f"plane{self.bits - 1 - plane}"][0]
        a, b = int(self.at[plane][block]), int(self.at[plane][block + 1])
        packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[offset + a : offset + b]), np.uint8)
        return np.concatenate([[0], np.cumsum(np.unpackbits(packed, bitorder="little"), dtype=np.int64)])

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self.ones[plane][block]) + (int(self._block(plane, block)[rest]) if rest else 0)

    def _rank(self, plane: int, bit: int, i: int) -> int:
        ones = self._rank1(plane, i)
        return ones if bit else i - ones

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th zero or one, from 0."""
        ones = self.ones[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        inner = self._block(plane, block)
        inner = inner if bit else np.arange(len(inner)) - inner
        return block * BLOCK + int(np.searchsorted(inner, k - int(before[block]) + 1)) - 1

    def access(self, i: int) -> int:
        """The token at a place."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in range(self.bits):
            ones = self._rank1(plane, i)
            bit = self._rank1(plane, i + 1) - ones
            code = code << 1 | bit
            i = self.head["zeros"][plane] + ones if bit else i - ones
        return int(self.alphabet[code])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token between two places."""
        end = self.n if end is None else min(end, self.n)
        if token not in self.code or begin >= end:
            return 0
        code = self.code[token]
        for plane in range(self.bits):
            bit = code >> (self.bits - 1 - plane) & 1
            shift = self.head["zeros"][plane] if bit else 0
            begin, end = shift + self._rank(plane, bit, begin), shift + self._rank(plane, bit, end)
        return end - begin

    def find(self, token: int, k: int) -> int | None:
        """The place of the k-th occurrence of a token, from 0, or None."""
        if token not in self.code or not 0 <= k < int(self.counts[self.code[token]]):
            return None
        code, begin = self.code[token], 0
        for plane in range(self.bits):
            bit = code >> (self.bits - 1 - plane) & 1
            begin = (self.head["zeros"][plane] if bit else 0) + self._rank(plane, bit, begin)
        i = begin + k
        for plane in range(self.bits - 1, -1, -1):
            bit = code >> (self.bits - 1 - plane) & 1
            i = self._select(plane, bit, i - (self.head["zeros"][plane] if bit else 0))
        return i

    def locate(self, place: int) -> tuple[int, int]:
        """(document, place in it) of a place in the shard."""
        doc = int(np.searchsorted(self.ends, place, side="right"))
        return doc, place - (int(self.ends[doc - 1]) if doc else 0)

    def document(self, doc: int) -> list[int]:
        return [self.access(i) for i in range(int(self.ends[doc - 1]) if doc else 0, int(self.ends[doc]))]

    def all(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest."""
        planes = []
        for plane in range(self.bits):
            blocks = [np.diff(self._load(plane, b)) for b in range(len(self.at[plane]) - 1)]
            planes.append(np.concatenate(blocks)[: self.n].astype(bool) if blocks else np.zeros(0, bool))
        order, code = np.arange(self.n), np.zeros(self.n, np.int64)
        for bit in planes:
            code[order] = code[order] << 1 | bit
            order = np.concatenate([order[~bit], order[bit]])
        return self.alphabet[code] if self.n else self.alphabet[:0]


def shards(documents: DataFrame, path: str = RANKS, size: int = SHARD_TOKENS) -> DataFrame:
    """One row a shard: the file, its check sum, its documents in order and what it holds. No shuffle."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, docs, held, number = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload = build(flat, np.concatenate(lengths))
            values = [part << 32 | number, len(docs), len(flat), len(np.unique(flat)), len(payload), zlib.crc32(payload), docs, payload]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["shard", "docs", "tokens", "distinct", "bytes", "crc", "doc_ids", "payload"])

        for batch in rows:
            for piece in batches.text_slices(batch, "text"):
                flat, length = tokens(path).encode(piece.column("text").to_pylist())
                ids.append(flat.astype(np.uint32)), lengths.append(length)
                docs += piece.column("doc_id").to_pylist()
                held += len(flat)
                if held >= size:
                    yield out()
                    ids, lengths, docs, held, number = [], [], [], 0, number + 1
        if docs:
            yield out()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_files(shard_rows: DataFrame, folder: str) -> DataFrame:
    """Writes every shard's file to a shared folder or object store (a path or a URI); one row a file with its path. A rerun of a task writes the same bytes again."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        store.create_dir(base, recursive=True)
        for batch in rows:
            paths = []
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                path = f"{base}/{shard:016x}.wvm"
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as file:
                    file.write(payload)
                store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(paths, pa.string())], ["shard", "path"])

    return shard_rows.select("shard", "payload").mapInArrow(run, "shard long, path string")


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(batches.read(spark, sf_dir, "documents"))
