"""Language identification of mixed-language text.

Every word has a script, from the ranges that its first letter falls in. The script narrows the languages
that the word may be in: those whose labelled documents use it, or else the language that ``SCRIPTS``
names for it. Among several candidates a naive Bayes model over byte trigrams, fitted to documents with a
language label, scores the word. Viterbi then labels each text's words, paying SWITCH for each change of
language, and equal labels in a row make a span.

Most texts need no search: if no stretch of words favours another language over the best single one by
SWITCH or more, one label for all is optimal. The others go through the recursion word by word.

Defined results: a null or empty text, one without words, and one without a letter of a script in ``SCRIPTS`` (digits alone, or
runes) have a null language and no spans. Other words without such a letter fit all languages alike. Ties go to the language
first in alphabetical order, and to fewer changes. Without labelled documents only scripts decide. An empty table gives none. A
label depends on the model and its text, not on its neighbours. Repeated rows are labelled each; texts are labelled whole, at any length.
Extra columns are ignored, whatever their names; a null doc_id stays null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches, textvec

#: Labelled documents that the model is fitted on, at most: those whose ids hash lowest.
MAX_LABELLED = 4000
SWITCH = 14.0
#: A word speaks at most so strongly, in nats, for or against a language.
CLIP = 6.0
#: What a word loses in a language of another script.
FOREIGN = 30.0
BITS = 17
SCHEMA = "doc_id long, lang string, spans array<struct<begin:int,end:int,lang:string>>"

#: script: (first and last code points, the language to assume where no labelled document uses the script)
SCRIPTS = {
    "latin": ([(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)], "en"),
    "greek": ([(0x370, 0x3FF), (0x1F00, 0x1FFF)], "el"),
    "cyrillic": ([(0x400, 0x52F)], "ru"),
    "armenian": ([(0x530, 0x58F)], "hy"),
    "hebrew": ([(0x590, 0x5FF)], "he"),
    "arabic": ([(0x600, 0x6FF), (0x750, 0x77F)], "ar"),
    "syriac": ([(0x700, 0x74F)], "syr"),
    "thaana": ([(0x780, 0x7BF)], "dv"),
    "devanagari": ([(0x900, 0x97F)], "hi"),
    "bengali": ([(0x980, 0x9FF)], "bn"),
    "gurmukhi": ([(0xA00, 0xA7F)], "pa"),
    "gujarati": ([(0xA80, 0xAFF)], "gu"),
    "oriya": ([(0xB00, 0xB7F)], "or"),
    "tamil": ([(0xB80, 0xBFF)], "ta"),
    "telugu": ([(0xC00, 0xC7F)], "te"),
    "kannada": ([(0xC80, 0xCFF)], "kn"),
    "malayalam": ([(0xD00, 0xD7F)], "ml"),
    "sinhala": ([(0xD80, 0xDFF)], "si"),
    "thai": ([(0xE00, 0xE7F)], "th"),
    "lao": ([(0xE80, 0xEFF)], "lo"),
    "tibetan": ([(0xF00, 0xFFF)], "bo"),
    "burmese": ([(0x1000, 0x107F)], "my"),
    "ethiopic": ([(0x1200, 0x137F)], "am"),
    "khmer": ([(0x1780, 0x17FF)], "km"),
    "mongolian": ([(0x1800, 0x187F)], "mn"),
    "georgian": ([(0x10A0, 0x10FF)], "ka"),
    "hangul": ([(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "ko"),
    "kana": ([(0x3040, 0x30FF)], "ja"),
    "han": ([(0x3400, 0x4DBF), (0x4E00, 0x9FFF)], "zh"),
}
NAMES = list(SCRIPTS)
#: Further languages of a script that no labelled document uses, and what a word loses in them: Japanese has Han among its kana.
SHARED = {"han": ("ja", 1.0)}


def _table() -> np.ndarray:
    """Script by the first two UTF-8 bytes of a character (of three-byte characters the range is told by two), -1 for none."""
    out = np.full(1 << 16, -1, np.int8)
    for k, (ranges, _) in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            for c in range(a, b + 1) if b < 0x800 else {*range(a, b + 1, 16), b}:
                raw = chr(c).encode()
                if len(raw) == 1:
                    out[raw[0] << 8 : (raw[0] << 8) + 256] = k
                else:
                    out[raw[0] << 8 | raw[1]] = k
    return out


TABLE = _table()


def scripts(w: textvec.Words) -> np.ndarray:
    """Script of the first letter of every word, -1 if it has none."""
    buf = np.append(w.buf, [0, 0])
    code = TABLE[(buf[:-1].astype(np.int32) << 8) | buf[1:]][: len(w.buf)]
    letters = np.flatnonzero(code >= 0)
    if not len(letters):
        return np.full(len(w.hash), -1, np.int8)
    at = np.searchsorted(letters, w.start)
    inside = (at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] < w.end)
    return np.where(inside, code[letters[np.minimum(at, len(letters) - 1)]], -1)


def trigrams(w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram centred on every byte of every word, with spaces around words; first and last of each word."""
    clean = np.full(len(w.buf) + 2, 32, np.uint64)
    size = w.end - w.start
    where = batches.ragged(w.start, size)
    clean[1:-1][where] = w.buf[where]
    borders = np.cumsum(size)
    before, after = clean[where], clean[where + 2]
    before[borders - size] = 32
    after[borders - 1] = 32
    code = (before << np.uint64(16)) | (clean[where + 1] << np.uint64(8)) | after
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64), borders - size, borders


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  #: language by hashed trigram
    allowed: np.ndarray  #: script by language, for scripts in the order of NAMES
    trained: int  #: languages that logp covers, the first ones
    lean: np.ndarray  #: script by language, what a word loses there


def fit(texts: list[str], labels: list[str]) -> Model:
    trained = sorted(set(labels))
    counts = np.zeros((len(trained), 1 << BITS))
    seen = np.zeros((len(NAMES), len(trained)), np.int64)
    column = np.array([trained.index(x) for x in labels], np.int64)
    for a in range(0, len(texts), 500):
        w = textvec.words(pa.array(texts[a : a + 500], pa.string()))
        code, first, last = trigrams(w)
        lang = column[a : a + 500][w.row]
        np.add.at(counts, (np.repeat(lang, last - first), code), 1)
        s = scripts(w)
        np.add.at(seen, (s[s >= 0], lang[s >= 0]), 1)
    logp = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (1 << BITS)))
    share = seen / np.maximum(1, seen.sum(axis=0, keepdims=True))
    rest = sorted({lang for _, lang in SCRIPTS.values()} - set(trained))
    languages = trained + rest
    allowed = np.zeros((len(NAMES), len(languages)), bool)
    allowed[:, : len(trained)] = share > 0.2
    lean = np.zeros((len(NAMES), len(languages)))
    for k, (_, lang) in enumerate(SCRIPTS.values()):
        if not allowed[k].any():
            allowed[k, languages.index(lang)] = True
            if NAMES[k] in SHARED:
                other, loss = SHARED[NAMES[k]]
                allowed[k, languages.index(other)] = True
                lean[k, languages.index(other)] = loss
    return Model(languages, logp, allowed, len(trained), lean)


def train(documents: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    # only ids are sorted; the texts of the chosen ones come by a broadcast join
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = known.join(F.broadcast(chosen), "doc_id").select("text", "lang").toArrow()
    return fit(rows["text"].to_pylist(), rows["lang"].to_pylist())


def word_scores(m: Model, w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every word by language, 0 for the best; the languages that matter here, as indices."""
    s = scripts(w)
    present = np.unique(s[s >= 0])
    used = np.flatnonzero(m.allowed[present].any(axis=0)) if len(present) else np.arange(min(1, len(m.languages)))
    out = np.zeros((len(w.hash), len(used)))
    if not len(w.hash):
        return out, used
    code, first, last = trigrams(w)
    models = used[used < m.trained]
    raw = np.zeros((len(w.hash), len(used)))
    for k, lang in enumerate(models):
        total = np.concatenate([[0.0], np.cumsum(m.logp[lang][code])])
        raw[:, k] = total[last] - total[first]
    raw -= np.where((s >= 0)[:, None], m.lean[np.maximum(s, 0)][:, used], 0.0)
    allowed = np.where((s >= 0)[:, None], m.allowed[np.maximum(s, 0)][:, used], True)
    lettered = (s >= 0) & (allowed.sum(axis=1) > 1)
    best = np.where(allowed, raw, -np.inf).max(axis=1, keepdims=True)
    out = np.where(allowed, np.where(lettered[:, None], np.maximum(raw - best, -CLIP), 0.0), -FOREIGN)
    return np.round(out, 6), used


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels; on ties the path that changes less, and the earlier language."""
    n, k = scores.shape
    value = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        top = max(value)
        lead = value.index(top)
        base = top - switch
        step = []
        for l in range(k):
            if value[l] >= base:
                step.append(l)
                value[l] += row[l]
            else:
                step.append(lead)
                value[l] = base + row[l]
        back.append(step)
    at = value.index(max(value))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1], np.int64)


def label(m: Model, w: textvec.Words, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """A language index for every word, -1 in rows that no script speaks for, and whether each row needed the recursion."""
    scores, used = word_scores(m, w)
    n = len(w)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(n, bool)
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
    whole = total[w.first[1:]] - total[w.first[:-1]]
    # a tie within rounding goes to the first language
    best = (whole >= whole.max(axis=1, keepdims=True) - 1e-6).argmax(axis=1)
    gain = np.zeros(n)
    shift = (FOREIGN * 2 * (np.diff(w.first).max() + 1)) * np.arange(n)[w.row]
    for k in range(scores.shape[1]):
        d = scores[:, k] - scores[np.arange(len(w.row)), best[w.row]]
        run = np.cumsum(d)
        base = np.concatenate([[0.0], run])[w.first[:-1]][w.row]
        inner = run - base
        low = np.minimum.accumulate(inner - d - shift) + shift  # least sum before a word, within its row
        np.maximum.at(gain, w.row, inner - low)
    out = best[w.row]
    hard = gain > switch - 1e-6
    for r in np.flatnonzero(hard):
        s = slice(w.first[r], w.first[r + 1])
        out[s] = viterbi(scores[s], switch)
    told = np.bincount(w.row[scripts(w) >= 0], minlength=n) > 0
    return np.where(told[w.row], used[out], -1), hard


def identify_batch(m: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    w = textvec.words(batch.column("text"))
    lang, _ = label(m, w)
    n = len(w)
    if (lang >= 0).any():
        new = np.concatenate([[True], (w.row[1:] != w.row[:-1]) | (lang[1:] != lang[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(lang)]]) - 1
        first, last = first[lang[first] >= 0], last[lang[first] >= 0]
        names = np.array(m.languages, object)
        spans = pa.StructArray.from_arrays(
            [pa.array(w.char_at(w.start[first]).astype(np.int32)), pa.array((w.char_at(w.end[last] - 1) + _tail(w, last)).astype(np.int32)), pa.array(names[lang[first]].tolist(), pa.string())], ["begin", "end", "lang"])
        sizes = np.bincount(w.row[first], minlength=n)
        share = np.zeros((n, len(m.languages)), np.int64)
        known = lang >= 0
        np.add.at(share, (w.row[known], lang[known]), (w.end - w.start)[known])
        main = [m.languages[k] if any_ else None for k, any_ in zip(share.argmax(axis=1), share.any(axis=1))]
    else:
        spans = pa.array([], pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        sizes, main = np.zeros(n, np.int64), [None] * n
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(main, pa.string()), batches.list_array(spans, sizes)], ["doc_id", "lang", "spans"])


def _tail(w: textvec.Words, word: np.ndarray) -> np.ndarray:
    """1 where the last byte of the word starts a character, else 0: char_at of a later byte counts the character already."""
    return ((w.buf[w.end[word] - 1] & 0xC0) != 0x80).astype(np.int64)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row a document: the language of most of its letters and the spans by character offsets."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return batches.map_text(texts, lambda batch: identify_batch(shared.value, batch), SCHEMA)


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = batches.read(spark, sf_dir, "documents")
    return identify(documents, train(documents))
