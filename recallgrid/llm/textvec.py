"""Words and their 64-bit hashes for a whole column of texts, without a Python loop over characters.

A word is a maximal run of ASCII letters and digits and of other characters beyond ASCII, in lower case. Spaces, punctuation and
symbols beyond ASCII (``APART``) end a word as those of ASCII do, and every character of a script that is written without
spaces (``ALONE``: Han, kana, Thai, Lao, Tibetan, Burmese, Khmer) is a word by itself.
A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: First and last code points, beyond ASCII, of what stands between words.
APART = [
    (0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x37E, 0x37E), (0x387, 0x387), (0x55A, 0x55F), (0x589, 0x58A),
    (0x5BE, 0x5BE), (0x5C0, 0x5C0), (0x5C3, 0x5C3), (0x5C6, 0x5C6), (0x5F3, 0x5F4), (0x60C, 0x60D), (0x61B, 0x61F), (0x66A, 0x66D), (0x6D4, 0x6D4),
    (0x964, 0x965), (0x970, 0x970), (0xE2F, 0xE2F), (0xE4F, 0xE4F), (0xE5A, 0xE5B), (0xF04, 0xF14), (0x104A, 0x104F), (0x1360, 0x1368), (0x17D4, 0x17DA),
    (0x1800, 0x180A), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F),
    (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xE000, 0xF8FF), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFEFF, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFFF),
    (0x1F000, 0x1FAFF), (0xF0000, 0x10FFFF),
]
#: And of characters that are words by themselves.
ALONE = [
    (0xE00, 0xE2E), (0xE30, 0xE4E), (0xE50, 0xE59), (0xE5C, 0xEFF), (0xF00, 0xF03), (0xF15, 0x1049), (0x1050, 0x109F), (0x1780, 0x17D3), (0x17DB, 0x17FF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x303C), (0x3040, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
]
#: 0 between words, 1 in a word, 2 a word by itself; by code point.
KIND = np.ones(0x110000, np.uint8)
KIND[:128] = 0
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    KIND[_a : _b + 1] = 1
for _k, _ranges in ((0, APART), (2, ALONE)):
    for _a, _b in _ranges:
        KIND[_a : _b + 1] = _k


def _word_pattern() -> str:
    """The same words for engines with regular expressions, on lower-case text."""
    shown = lambda ranges: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    change = np.flatnonzero(np.diff(np.concatenate([[False], KIND[128:] == 1, [False]]).astype(np.int8))) + 128
    # surrogates are no characters, and some engines refuse them in a class
    inner = [(a, b) for x, y in zip(change[0::2].tolist(), (change[1::2] - 1).tolist()) for a, b in ((x, min(y, 0xD7FF)), (max(x, 0xE000), y)) if a <= b]
    return f"[a-z0-9{shown(inner)}]+|[{shown(ALONE)}]"


WORD_SQL = _word_pattern()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _B), ("down", _BINV)):
            full = np.full(max(n, 1 << 16), base, np.uint64)
            full[0] = 1
            _powers[name] = np.multiply.accumulate(full)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    buf: np.ndarray  #: bytes of the lower-case texts
    row_at: np.ndarray  #: n + 1 byte offsets of the rows
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    hash: np.ndarray
    row: np.ndarray  #: row of each word
    first: np.ndarray  #: n + 1 offsets of the rows among the words

    def __len__(self) -> int:
        return len(self.row_at) - 1

    def char_at(self, byte: np.ndarray) -> np.ndarray:
        """Characters before a byte within its row. Lower-casing keeps their number, so this holds for the original text."""
        before = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        row = np.searchsorted(self.row_at, byte, side="right") - 1
        row = np.clip(row, 0, max(0, len(self) - 1))
        return before[byte] - before[self.row_at[row]]


def _kinds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """KIND of the character that each byte belongs to; first byte of, and byte after, each character that is a word by itself."""
    kind = KIND[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead):
        return kind, lead, lead
    first = buf[lead]
    size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
    code = first.astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << 6) | (buf[lead[more] + k] & 0x3F)
    of = KIND[code]
    kind[lead] = of
    for k in range(1, 4):
        more = size > k
        kind[lead[more] + k] = of[more]
    alone = of == 2
    return kind, lead[alone], lead[alone] + size[alone]


def words(column: pa.Array) -> Words:
    buf, row_at = bytes_of(pc.utf8_lower(pc.fill_null(column, "")))
    kind, alone, behind = _kinds(buf)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = kind > 0
    change = inside[1:] != inside[:-1]
    # a word never runs on into the next row, nor into or out of a character that is one by itself
    joined = np.unique(np.concatenate([row_at[1:-1], alone, behind]))
    joined = joined[(joined > 0) & (joined < len(buf))]
    joined = joined[inside[joined] & inside[joined + 1]]
    edges = np.flatnonzero(change)
    if len(joined):
        edges = np.sort(np.concatenate([edges, joined, joined]))
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, row_at)
    row = np.repeat(np.arange(len(row_at) - 1), np.diff(first))
    return Words(buf, row_at, start, end, hash_spans(buf, start, end), row, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the n + 1 offsets of the rows among them.

    A row of one to n - 1 words has the one gram of all its words.
    """
    count = np.diff(w.first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(at[-1]), np.uint64)
    long = count >= n
    lengths = np.where(long, many, 0)
    from_ = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(int(lengths.sum()))
    to = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(int(lengths.sum()))
    total = np.zeros(len(from_), np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w.hash[from_ + k]
    out[to] = mix(total + np.uint64(n))
    for r in np.flatnonzero(~long & (count > 0)):
        total = np.zeros(1, np.uint64)
        for k in range(int(count[r])):
            total = total * np.uint64(0xD6E8FEB86659FD93) + w.hash[w.first[r] + k : w.first[r] + k + 1]
        out[at[r]] = mix(total + np.uint64(count[r]))[0]
    return out, at
