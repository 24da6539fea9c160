"""Token shards, SentencePiece spans and lattice scores: exact round trips and brute force."""

import functools
import math
import os
import random

import numpy as np
import pytest

from recallgrid.llm import lattice_lm, sentencepiece_spans, wavelet_shards

DOCS = "doc_id long, text string, ids string, words string"
ODD = ["", "a  b", " lead", "trail ", "ﬁne ①", "é x", "▁a", "x\ty\nz", "日本語 テ", "ｶﾞ", "a ▁ b", "🙂 ok\0", " ", None, "tie", "tie", "long " * 9000, "it's  'll\tok b", "a\n b", "a \nb", "a  b"]

pytestmark = pytest.mark.skipif(not os.path.exists(sentencepiece_spans.MODEL), reason="no vocabulary files")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def test_pieces_and_spans(spark):
    import sentencepiece as spm

    library = spm.SentencePieceProcessor(model_file=sentencepiece_spans.MODEL)
    plain = sentencepiece_spans.Encoder(sentencepiece_spans.MODEL, None)
    assert not plain.map.keys()
    ids, begins, ends, length, _ = plain.encode(ODD)
    at = np.concatenate([[0], np.cumsum(length)])
    for i, text in enumerate(ODD):
        if text:
            raw = text.encode()
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text)
            assert b"".join(raw[a:b] for a, b in zip(begins[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])) == raw
    rows = {r["doc_id"]: r for r in sentencepiece_spans.encode(documents(spark, ODD)).collect()}
    assert rows[13]["ids"] is None and rows[0]["ids"] == [] and rows[13]["restored"] is None
    assert all(r["restored"] == ("▁" not in ODD[i]) for i, r in rows.items() if i != 13)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_spans.decode(sentencepiece_spans.encode(documents(spark, ODD), rule=None)).collect()}
    assert back == {i: t and t.replace("▁", " ") for i, t in enumerate(ODD)}
    assert sentencepiece_spans.encode(documents(spark, ODD).limit(0)).count() == 0


def test_map_equals_the_library():
    import sentencepiece as spm

    encoder = sentencepiece_spans.encoder(sentencepiece_spans.MODEL, "nfkc")
    library = spm.SentencePieceNormalizer(rule_name="nfkc")
    rng = random.Random(1)
    alphabet = "abcé①ﬁｶﾞ日ＡＢ½ ́ 한ᄒ"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
        want = library.normalize("x" + text + "x").replace("▁", " ").strip()
        got, begins, ends = encoder.map.normalise("x" + text + "x")
        assert " ".join(got.decode().split()) == " ".join(want.split())
        assert (begins[1:] >= begins[:-1]).all() and (ends > begins).all() and ends[-1] == len(("x" + text + "x").encode())


def test_spans_of_changed_text():
    encoder = sentencepiece_spans.encoder(sentencepiece_spans.MODEL, "nfkc")
    text = "ﬁne ①"
    ids, begins, ends, _, normal = encoder.encode([text])
    assert normal[0].decode() == "fine 1"
    assert [text.encode()[a:b].decode() for a, b in zip(begins, ends)] == ["ﬁne", " ", "①"]


def test_spans_equal_brute_force():
    """Every character of the normalised text looked up by itself; a piece spans the sources of its characters."""
    encoder = sentencepiece_spans.encoder(sentencepiece_spans.MODEL, "nfkc")
    known = {k: encoder.map.longest(k, 0)[1] for k in encoder.map.keys()}
    longest = max(map(len, known))
    rng = random.Random(21)
    changed = 0
    for _ in range(200):
        text = "".join(rng.choice("ab cé ①ﬁ ｶﾞ日ＡＢ½ ́ 한ᄒ㍿ 🙂the ing ") for _ in range(rng.randint(0, 25)))
        raw, at, normal = text.encode(), 0, []
        while at < len(raw):
            size = next((n for n in range(longest, 0, -1) if raw[at : at + n] in known), 0)
            to = known[raw[at : at + size]] if size else b""
            if not size:
                size = len(raw[at:].decode()[0].encode())
                to = raw[at : at + size]
            normal += [(c, at, at + size) for c in to]
            at += size
        plain = bytes(c for c, _, _ in normal)
        changed += plain != raw
        marked = [(c, 0, 0) for c in "▁".encode()] + [(x, a, b) for c, a, b in normal for x in ("▁".encode() if c == 32 else bytes([c]))]
        ids, begins, ends, _, got = encoder.encode([text])
        assert got[0] == plain
        place, want = 0, []
        for i in ids.tolist():
            part = marked[place : place + int(encoder.size[i])]
            place += int(encoder.size[i])
            want.append((part[0][1], max(b for _, _, b in part)))
        assert list(zip(begins.tolist(), ends.tolist())) == want and (not text or place == len(marked))
    assert changed > 100


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"w{i} v{i % 7} u" for i in range(50)]
    encoder = sentencepiece_spans.Encoder(sentencepiece_spans.MODEL, None)
    one = encoder.encode(texts)
    monkeypatch.setattr(sentencepiece_spans, "MEMO", 3)
    parts = [encoder.encode(texts[i : i + 5]) for i in range(0, 50, 5)]
    for k in range(4):
        assert np.concatenate([p[k] for p in parts]).tolist() == one[k].tolist()


def test_token_shards(spark):
    coder = wavelet_shards.tokens(wavelet_shards.RANKS)
    rows = wavelet_shards.shards(documents(spark, ODD).coalesce(1), size=100).collect()
    ids, length = coder.encode(ODD)
    at = np.concatenate([[0], np.cumsum(length)])
    for i, text in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == (coder.encoding.encode_ordinary(text) if text else [])
    seen = []
    for r in rows:
        shard = wavelet_shards.Shard(r["payload"])
        assert shard.n == r["tokens"] and len(shard.ends) == r["docs"] == len(r["doc_ids"])
        for d, doc in enumerate(r["doc_ids"]):
            if length[doc] < 200:
                assert shard.document(d) == ids[at[doc] : at[doc + 1]].tolist()
            seen.append(doc)
    assert seen == list(range(len(ODD)))
    assert wavelet_shards.shards(documents(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (500, 1), (3000, 2), (200_000, 700)])
def test_wavelet_queries(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds * 61).astype(np.uint32)
    shard = wavelet_shards.Shard(wavelet_shards.build(ids, np.array([n // 2, 0, n - n // 2])))
    assert (shard.all() == ids).all()
    for i in rng.integers(0, n, 30) if n else []:
        assert shard.access(int(i)) == ids[i]
        where = np.flatnonzero(ids == ids[i])
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.count(int(ids[i]), a, b) == ((where >= a) & (where < b)).sum()
        k = int(rng.integers(0, len(where)))
        assert shard.find(int(ids[i]), k) == where[k] and shard.find(int(ids[i]), len(where)) is None
    assert shard.count(999_983) == 0 and shard.find(999_983, 0) is None
    if n > 4:
        assert shard.locate(n // 2) == (2, 0)
        with pytest.raises(IndexError):
            shard.access(n)


def test_shard_files(spark, tmp_path):
    rows = wavelet_shards.shards(documents(spark, ["a b", "c d"]).coalesce(1))
    paths = [r["path"] for r in wavelet_shards.write_files(rows, str(tmp_path / "files")).collect()]
    with open(paths[0], "rb") as file:
        shard = wavelet_shards.Shard(file.read())
    assert wavelet_shards.tokens(wavelet_shards.RANKS).encoding.decode(shard.document(1)) == "c d"


def test_lattice_sums_all_segmentations():
    model = lattice_lm.lattice(1.25)
    surface, score, single, logs = lattice_lm.pieces()
    assert not logs
    weight = np.where([bool(s) for s in surface], (np.where(single, len(surface), np.clip(-score, 0, len(surface))) + 2.7) ** -1.25, 0)
    p = weight / weight.sum()
    pieces = {s: x for s, x, one in zip(surface, p, single) if s and not one}
    byte = {s[0]: x for s, x, one in zip(surface, p, single) if one}

    def brute(word):
        chars = [c.encode() for c in word.replace(" ", "▁")]

        @functools.lru_cache(None)
        def rest(i):
            if i == len(chars):
                return 1.0
            total = sum(pieces.get(b"".join(chars[i:j]), 0) * rest(j) for j in range(i + 1, len(chars) + 1))
            return total if chars[i] in pieces else total + math.prod(byte[b] for b in chars[i]) * rest(i + 1)

        return math.log(rest(0))

    words = [" hello", " thntblere", "  two", " a.\nThe", " 日本語", " ß🙂x", " ", "   ", " internationalisation"]
    assert np.allclose(lattice_lm.marginals(model, words), [brute(w) for w in words], atol=1e-8)


def test_weights_follow_the_scores_of_the_file(tmp_path):
    _, score, single, _ = lattice_lm.pieces()
    value = lattice_lm.worth()
    plain = np.flatnonzero(np.isfinite(value) & ~single)
    assert (np.argsort(-score[plain], kind="stable") == np.argsort(-value[plain], kind="stable")).all()
    # the exponent is the likeliest of a grid
    counts = {int(plain[0]): 50, int(plain[9]): 20, int(plain[400]): 7, int(plain[9000]): 1}
    best = lattice_lm.exponent(counts)
    usable = value[np.isfinite(value)]
    likely = lambda e: sum(n * (e * value[i] - np.log(np.exp(e * usable).sum())) for i, n in counts.items())
    assert all(likely(best) >= likely(best + d) for d in (-0.3, -0.01, 0.01, 0.3)) and lattice_lm.exponent({}) == 1.0
    # a unigram file's scores are its weights
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    for piece, logp in (("\u2581", math.log(0.5)), ("a", math.log(0.3)), ("aa", math.log(0.2))):
        model.pieces.add(piece=piece, score=logp, type=1)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    got = lattice_lm.marginals(lattice_lm.lattice(1.0, str(path)), [" aa", " a"])
    assert np.allclose(np.exp(got), [0.5 * (0.3 * 0.3 + 0.2), 0.5 * 0.3])


def test_scores(spark):
    docs = documents(spark, ODD)
    words = {r["word"]: r["n"] for r in lattice_lm.word_counts(docs).collect()}
    assert words[" tie"] == 2 and words[" long"] == 9000
    counts = {r["piece"]: r["n"] for r in lattice_lm.piece_counts(lattice_lm.word_counts(docs)).collect()}
    import sentencepiece as spm

    library = spm.SentencePieceProcessor(model_file=lattice_lm.MODEL)
    want = np.bincount([i for t in ODD if t for w in lattice_lm.chunks(t) for i in library.encode(w[1:])])
    assert counts == {i: int(c) for i, c in enumerate(want) if c}
    rows = {r["doc_id"]: r for r in lattice_lm.score(docs, lattice_lm.train(docs)).collect()}
    assert rows[0]["logprob"] == 0 and rows[13]["bits_per_byte"] is None and rows[14]["logprob"] == rows[15]["logprob"] < 0
    assert abs(rows[16]["logprob"] / 9000) < 10 and len(rows) == len(ODD)
    assert lattice_lm.score(docs.limit(0), lattice_lm.train(docs.limit(0))).count() == 0
