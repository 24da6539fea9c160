"""Offset-preserving SentencePiece encoding, and decoding.

Normalisation goes by the compiled character map (a double-array trie over UTF-8 with its replacement
strings): at each place the longest key that matches is replaced, else one character is kept, and every
normalised byte remembers the source bytes it came from. Spaces become U+2581 and one is put in front.
The vocabulary file then splits the normalised text, and each piece is projected through that alignment
to the span of source bytes that its characters came from.

The vocabulary at hand has an empty map of its own, so ``RULE`` names one of the maps that the library
carries, NFKC; rule=None takes the model's own. No vocabulary is trained.

Pieces never cross from a character to a following space, so equal words are encoded once and their pieces
are gathered; texts where that does not hold (runs of spaces, a literal U+2581) and texts that the map
changes are encoded whole. Defined results: a null text gives null lists, an empty text empty ones, an empty table no rows; a null doc_id stays null.
Between segmentations of equal score the library's choice holds, which is the same for equal words.
Repeated rows are encoded each; texts are encoded whole. A literal U+2581 decodes as a space, as in the library, and restored
tells so. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

MODEL = os.environ.get("RECALLGRID_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RULE = "nfkc"
#: Words that a task remembers before it starts afresh; the result does not depend on it.
MEMO = 400_000
SPACE = "▁"
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, restored boolean"


class CharacterMap:
    """The compiled map: 4 bytes for the size of the trie, the trie, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.strings = b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.strings = blob[4 + size :]
        self._units = self.units.tolist()
        self.active = self._active()

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at this place."""
        units = self._units
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]

    def keys(self) -> list[bytes]:
        units, out = self.units, []
        if not len(units):
            return out
        labels = units & np.uint32(0x800000FF)
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        every = np.arange(1, 256)
        stack = [(offset(self._units[0]), b"")]
        while stack:
            base, key = stack.pop()
            at = base ^ every
            at_in = at[at < len(units)]
            for c in every[at < len(units)][labels[at_in] == every[at < len(units)]].tolist():
                unit = self._units[base ^ c]
                if unit >> 8 & 1:
                    out.append(key + bytes([c]))
                stack.append(((base ^ c) ^ offset(unit), key + bytes([c])))
        return out

    def _active(self) -> re.Pattern | None:
        """Finds any character that the map changes by itself or that only longer keys use."""
        chars = set()
        keys = self.keys()
        for key in keys:
            text = key.decode("utf-8", "ignore")
            if len(text) == 1:
                length, to = self.longest(key, 0)
                if to != key:
                    chars.add(text)
            chars.update(text[1:])
        self.ascii = any(k.isascii() for k in keys)
        chars = {c for c in chars if not c.isascii()}
        if not chars:
            return None
        codes, parts = sorted(map(ord, chars)), []
        for c in codes:
            if parts and parts[-1][1] == c - 1:
                parts[-1][1] = c
            else:
                parts.append([c, c])
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]")

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes; for each the first source byte it came from and the byte after the last."""
        raw, at = text.encode(), 0
        out, begins, ends = [], [], []
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit is None:
                first = raw[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                to = raw[at : at + size]
            else:
                size, to = hit
            out.append(to)
            begins += [at] * len(to)
            ends += [at + size] * len(to)
            at += size
        return b"".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


class Encoder:
    def __init__(self, path: str, rule: str | None):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if rule is not None:
            spec = pb.NormalizerSpec()
            spec.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        self.map = CharacterMap(spec.precompiled_charsmap)
        # the processor sees text that is normalised already
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.name = "identity"
        self.processor = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type not in (2, 3) else b"" for p in model.pieces]
        self.size = np.array([len(s) for s in surface], np.int64)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.first, self.used = np.zeros(1 << 16, np.int32), [0], 0

    def learn(self, words: list[str]) -> None:
        for word, ids in zip(words, self.processor.encode(words, num_threads=1)):
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.memo[word] = len(self.first) - 1
            self.first.append(self.used)

    def encode_whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Ids, first and last source bytes, and the normalised text, for any text."""
        normal, begins, ends = self.map.normalise(text)
        ids = np.array(self.processor.encode(normal.decode()), np.int32)
        spaces = np.frombuffer(normal, np.uint8) == 32
        width = np.where(spaces, 3, 1)
        begins = np.concatenate([[0, 0, 0], np.repeat(begins, width)]).astype(np.int64)
        ends = np.concatenate([[0, 0, 0], np.repeat(ends, width)]).astype(np.int64)
        stop = np.cumsum(self.size[ids])
        start = stop - self.size[ids]
        return ids, begins[start], np.maximum.reduceat(ends, start) if len(start) else ends[:0], normal

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Texts from flat ids: pieces joined, U+2581 to spaces, the first space dropped."""
        raw = self.surface[batches.ragged(self.surface_at[ids], self.size[ids])].tobytes()
        total = np.concatenate([[0], np.cumsum(self.size[ids])])
        cuts = total[np.concatenate([[0], np.cumsum(lengths)])]
        mark = SPACE.encode()
        return [raw[a:b].replace(mark, b" ")[1:] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Flat ids, begins and ends, the pieces of each text, and the normalised texts."""
        active = self.map.active
        chunks, counts, whole = [], np.zeros(len(texts), np.int64), {}
        normal: list[bytes] = []
        for i, text in enumerate(texts):
            if not text:
                normal.append(b"")
            elif "  " in text or text[0] == " " or text[-1] == " " or self.map.ascii or (not text.isascii() and (SPACE in text or active is not None and active.search(text))):
                whole[i] = self.encode_whole(text)
                normal.append(whole[i][3])
            else:
                words = text.split(" ")
                chunks += words
                counts[i] = len(words)
                normal.append(text.encode())
        if len(self.memo) > MEMO:
            self.forget()
        new = [w for w in dict.fromkeys(chunks) if w not in self.memo]
        if new:
            self.learn(new)
        word = np.fromiter(map(self.memo.__getitem__, chunks), np.int64, len(chunks))
        first = np.array(self.first, np.int64)
        pieces = first[word + 1] - first[word]
        ids = self.flat[batches.ragged(first[word], pieces)]
        size = self.size[ids].copy()
        lead = np.cumsum(pieces) - pieces
        size[lead] -= 2  # U+2581 stands for a space of one byte
        at = np.concatenate([[0], np.cumsum(counts)])
        heads = lead[at[:-1][counts > 0]]
        size[heads] -= 1  # or for none, in front of the text
        length = np.add.reduceat(np.concatenate([pieces, [0]]), np.minimum(at[:-1], len(pieces))) if len(texts) else np.zeros(0, np.int64)
        length = np.where(counts > 0, length, 0)
        total = np.cumsum(size)
        starts = np.cumsum(length) - length
        base = np.repeat(np.concatenate([[0], total])[np.minimum(starts, len(total))], length)
        ends = (total - base).astype(np.int32)
        begins = (ends - size).astype(np.int32)
        if whole:
            parts, lengths = [], length.copy()
            for i in range(len(texts)):
                if i in whole:
                    parts.append(whole[i][:3])
                    lengths[i] = len(whole[i][0])
                elif length[i]:
                    s = slice(starts[i], starts[i] + length[i])
                    parts.append((ids[s], begins[s], ends[s]))
            ids, begins, ends = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in range(3))
            length = lengths
        return ids, begins, ends, length, normal


@lru_cache(maxsize=2)
def encoder(path: str, rule: str | None) -> Encoder:
    return Encoder(path, rule)


def encode(documents: DataFrame, path: str = MODEL, rule: str | None = RULE) -> DataFrame:
    """One row a document: piece ids, their source spans in bytes, and whether decoding gives the normalised text back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        ids, begins, ends, length, normal = encoder(path, rule).encode(texts)
        back = encoder(path, rule).decode(ids, length)
        null = pa.array([t is None for t in texts])
        offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x), mask=null) for x in (ids, begins, ends)]
        same = pa.array([None if t is None else a == b for t, a, b in zip(texts, back, normal)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, same], ["doc_id", "ids", "begins", "ends", "restored"])

    return batches.map_text(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text that its ids stand for; null ids give null, bytes that are no UTF-8 the replacement character."""

    def run(rows):
        for batch in rows:
            lists = batch.column("ids")
            length = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
            found = encoder(path, None).decode(lists.flatten().to_numpy(zero_copy_only=False), length)
            texts = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(found, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(batches.read(spark, sf_dir, "documents"))
