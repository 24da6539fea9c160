"""The Jaccard join, embedding tiles and the pipeline, against brute force and on hard rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from recallgrid.llm import embedding_tiles, ngram_join, textvec

WORD = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", textvec.WORD_SQL))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, variant string, label string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def grams(text, n):
    w = WORD.findall((text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def copies(seed=3, size=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))) for _ in range(size)]
    for _ in range(size):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + ["W1 w2!", "w1 w2", "w2 w1", "solo", "Solo.", "今天天气很好我们去公园散步吧", "今天天气很好我们去公园散步吧！", "今天天气很好，我们去公园走走吧"]


def brute(rows, n, threshold):
    """Pairs of documents, from (doc_id, text)."""
    sets = {(i, grams(t, n)) for i, t in rows if i is not None}
    out = []
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if i != j and s and t and len(s & t) / len(s | t) >= threshold:
            out.append((min(i, j), max(i, j), round(len(s & t) / len(s | t), 6)))
    return sorted(out)


def pairs(docs, *args):
    return sorted(tuple(r) for r in ngram_join.pairs(docs, *args).collect())


def test_pairs_equal_brute_force(spark):
    texts = copies()
    for n, threshold in ((2, 0.7), (1, 0.5), (3, 0.9)):
        assert pairs(documents(spark, texts), n, threshold) == brute(enumerate(texts), n, threshold), (n, threshold)


def in_classes(rows, n=2, threshold=0.7):
    """Classes and numbers of links, from (doc_id, text)."""
    linked = brute(rows, n, threshold)
    label = {i: i for i, _ in rows if i is not None}
    for _ in label:
        for i, j, _ in linked:
            label[i] = label[j] = min(label[i], label[j])
    return sorted((i, label[i], sum(i in p[:2] for p in linked)) for i in label)


def clusters():
    """Large groups of near copies, some of which are not near one another, beside texts of their own."""
    rng = random.Random(6)
    texts = []
    for size, words in ((70, 60), (40, 30), (12, 200)):
        base = [f"b{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, words // 10)):
                w[rng.randrange(words)] = f"x{rng.randrange(2000)}"
            texts.append(" ".join(w[: rng.randint(words * 3 // 4, words)]))
    return texts + texts[:9] + copies(9, 20) + [None, "", "..."]


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(clusters()))
    # doc_ids of several texts, some of which are near one another; a row that repeats; no doc_id
    rows += [(3, rows[4][1]), (3, rows[80][1]), (200, rows[115][1]), (200, "stands alone"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, linked = in_classes(rows), brute(rows, 2, 0.7)
    assert max(w[2] for w in want) > 30 and len(linked) > 5 * len(want)
    # cells are compared as blocks, or pair by pair
    for dense, rank, block in ((3, 2, 7), (10**9, 5, 1024)):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        monkeypatch.setattr(ngram_join, "CELL_RANK", rank)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
        assert sorted(tuple(r) for r in ngram_join.classes(docs).collect()) == want
        assert pairs(docs) == linked
    assert ngram_join.classes(docs.limit(0)).count() == 0


def test_pairs_of_a_cluster_are_not_sent(spark):
    """Rows of near copies grow as the copies do, in what the tasks find and before."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = ngram_join.frequent(docs)
    shared, floor = spark.sparkContext.broadcast(ranks), ngram_join.cell_rank(ranks)
    assert ngram_join.candidates(docs, shared, floor, 2, 0.7).count() < 200
    assert ngram_join._joined(docs, 2, 0.7)[2].count() < 3 * 200
    assert {tuple(r) for r in ngram_join.classes(docs).collect()} == {(i, 0, 199) for i in range(200)}


def test_edits_of_middling_frequency_leave_near_copies_in_one_cell():
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    ranks = np.random.default_rng(3).choice([0, 6], 1 << 16, p=[0.5, 0.5]).astype(np.uint8)
    ranks[(ngram_join._sets(pa.array([" ".join(base)]), 2)[0] >> np.uint64(48)).astype(np.int64)] = 9
    cells = ngram_join.Sets(pa.array(texts), 2, 0.7, ranks).cell
    assert np.unique(cells, return_counts=True)[1].max() > 200


def test_full_cells_of_the_order_make_no_cells():
    assert ngram_join.cell_rank(np.zeros(16, np.uint8)) == ngram_join.CELL_RANK
    assert ngram_join.cell_rank(np.full(16, 6, np.uint8)) == 6 + ngram_join.ABOVE_MEDIAN


def test_common_counts_equal_sets(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ngram_join, "ADDED", 50)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, rng.integers(1, 40)), 10**6 + rng.integers(0, 5000, rng.integers(0, 300))])).astype(np.uint64) for _ in range(90)]
    p, q = sets[:40], sets[40:]
    got = ngram_join.common(p, q)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in q] for x in p] and got.any()
    assert not ngram_join.common([np.array([1], np.uint64)], [np.array([2], np.uint64)]).any()


def test_members_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEMBERS", 2)
    long = " ".join(f"w{i}" for i in range(50))
    texts = [long] * 7 + [long + " more"] * 5 + ["alone"]
    assert pairs(documents(spark, texts)) == brute(enumerate(texts), 2, 0.7)
    assert len(brute(enumerate(texts), 2, 0.7)) == 12 * 11 // 2


def test_an_id_of_several_texts(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long + " end"), (2, long), (2, long), (3, long + " end"), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", "z") for i, t in rows], DOCS)
    assert pairs(docs) == brute(rows, 2, 0.7)


def test_blocks_and_shuffled_lookups_change_nothing(spark, monkeypatch):
    texts = copies(8, 40)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "CELL_BITS", 3)
    monkeypatch.setattr(ngram_join, "HOT_RANK", 1)
    monkeypatch.setattr(ngram_join, "FLUSH", 50)
    assert pairs(documents(spark, texts)) == brute(enumerate(texts), ngram_join.N, ngram_join.THRESHOLD)


def test_order_counts_all_documents(spark):
    texts = ["a b c"] * 9 + ["a b", None, "", "b c d"]
    ranks = ngram_join.frequent(documents(spark, texts).repartition(3))
    assert len(ranks) == 1 << ngram_join.CELL_BITS
    g = lambda text: ngram_join._sets(pa.array([text]), 2)[0]
    found = {text: int(ngram_join.ordered(g(text), ranks)[0] >> np.uint64(56)) for text in ("a b", "b c", "c d", "x y")}
    assert found == {"a b": 3, "b c": 3, "c d": 0, "x y": 0}


def test_sketches_bound_from_below():
    texts = copies(5, 30)
    order = np.zeros(16, np.uint8)
    sets = ngram_join.Sets(pa.array(texts), 2, 0.7, order)
    exact = [set(sets.value[a:b].tolist()) for a, b in zip(sets.at[:-1], sets.at[1:])]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert ngram_join.apart(sets.sketch(i), sets.sketch(j)) <= len(exact[i] ^ exact[j])


def test_join_hard_rows(spark):
    docs = documents(spark, [None, "", "...", "tie tie", "tie tie", "long " * 20_000, "long " * 20_001])
    none = docs.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "'tie tie' AS text", "lang", "source", "n_chars", "grp", "variant", "label")
    assert pairs(docs.union(none).union(docs)) == [(3, 4, 1.0), (5, 6, 1.0)]
    assert ngram_join.pairs(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one(docs.union(none).union(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 1, 2, 3, 5, None]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_keep_one_follows_chains(spark):
    w = [f"w{i}" for i in range(60)]
    chain = [" ".join(w[i : i + 40]) for i in (0, 3, 6, 9, 12)]
    kept = ngram_join.keep_one(documents(spark, ["other words entirely", *chain, "unrelated text here"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 6]


def test_keep_one_keeps_every_text_of_an_id(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, near), (2, near + " more"), (2, "a text that stands alone"), (2, "..."), (3, "a text that stands alone"), (4, "four has this"), (4, "four has this"), (4, "and that as well")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", "z") for i, t in rows], DOCS)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, near), (2, "a text that stands alone"), (2, "..."), (4, "four has this"), (4, "and that as well")])


def test_keep_one_beside_clashing_names(spark):
    rows = [(1, "one two three", 1, 2, 3, "a", "b"), (1, "one two three", 1, 2, 3, "a", "b"), (2, "one two three", 4, 5, 6, "c", "d"), (3, "alone", 7, 8, 9, "e", "f"), (None, "one two three", 0, 0, 0, "g", "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _id int, __ID int, _of int, _text string, `a.b` string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, None]
    assert pairs(docs) == [(1, 2, 1.0)]


# embeddings


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24))
    x = np.concatenate([x, x[:40] + 0.05 * rng.normal(size=(40, 24)), x[:20], -x[:5]]) * rng.uniform(0.1, 9, size=(365, 1))
    bad = [(9999, None), (None, [1.0] * 24), (9998, [0.0] * 24), (9997, [1.0] * 3), (9996, [float("nan")] * 24), (0, x[0].tolist()), (9995, [])]
    df = spark.createDataFrame([(i, v, "extra") for i, v in [*enumerate(x.tolist()), *bad]], "vec_id long, embedding array<double>, tile string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    for threshold, tile in ((0.95, 64), (0.3, 64), (0.95, 100_000)):
        want = {(int(a), int(b), round(float(cosine[a, b]), 6)) for a, b in zip(*np.nonzero(np.triu(cosine >= threshold, 1)))}
        got = {tuple(r) for r in embedding_tiles.pairs(df, threshold, tile).collect()}
        assert {g[:2] for g in got} == {w[:2] for w in want} and all(abs(g[2] - cosine[g[0], g[1]]) < 2e-6 for g in got)
    assert embedding_tiles.pairs(df.limit(0)).count() == 0


def test_classes_of_vectors_equal_brute_force(spark):
    """Chains and copies, across tiles and widths; vectors without a partner, and rows that have none to compare, are a class each."""
    rng = np.random.default_rng(7)
    angles = np.concatenate([np.arange(0, 2, 0.2), rng.uniform(2.5, 6, 12)])
    rows = [(i, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(angles)]
    x = rng.normal(size=(30, 6))
    rows += [(len(rows) + i, v) for i, v in enumerate([*x.tolist(), *(x[:9] + 0.02 * rng.normal(size=(9, 6))).tolist(), *x[:1].tolist() * 8])]
    rows += [(0, x[29].tolist()), (9998, None), (9997, [0.0] * 6), (9996, [1.0]), (None, x[0].tolist())]
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and any(v)]
    linked = [(i, j) for (i, a), (j, b) in itertools.combinations(unit, 2) if i != j and len(a) == len(b) and a @ b >= 0.95]
    label = {i: i for i, _ in rows if i is not None}
    for _ in label:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (6, 4096):
        assert {tuple(r) for r in embedding_tiles.classes(df, 0.95, tile).collect()} == set(label.items())
    assert len(set(label.values())) < len(label) - 20 and embedding_tiles.classes(df.limit(0)).count() == 0


def test_stars_connect_the_same_ids():
    p, q = (np.array(x) for x in zip(*itertools.combinations(range(10, 200), 2)))
    a, b = embedding_tiles.stars(np.concatenate([p, [1, 2, 3]]), np.concatenate([q, [2, 3, 4]]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, i) for i in (2, 3, 4)] + [(10, i) for i in range(11, 200)]
    assert [len(x) for x in embedding_tiles.stars(p[:0], q[:0])] == [0, 0]


def test_tiles_compare_every_width(spark):
    rng = np.random.default_rng(1)
    rows = []
    for width, n in ((8, 30), (5, 20), (3, 1)):
        x = rng.normal(size=(n, width))
        rows += [(len(rows) + i, v) for i, v in enumerate([*x.tolist(), *(2 * x[: n // 4]).tolist()])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {(i, j) for i, j in itertools.combinations(unit, 2) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95}
    assert {len(unit[i]) for i, _ in want} == {8, 5}
    for tile in (8, 4096):
        got = embedding_tiles.pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95, tile).collect()
        assert {(r["vec_id_a"], r["vec_id_b"]) for r in got} == want and len(got) == len(want)


def test_far_tiles_never_meet(spark):
    """Clusters apart on several axes: single and double precision, and pairs across the borders of tiles."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12)) * 3
    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 12)) for c in centres])
    for kind, v in (("double", x), ("float", x.astype(np.float32).astype(float))):
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        cosine = unit @ unit.T
        df = spark.createDataFrame(list(enumerate(v.tolist())), f"vec_id long, embedding array<{kind}>")
        got = {tuple(r)[:2] for r in embedding_tiles.pairs(df, 0.97, 20).collect()}
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cosine >= 0.97, 1)))} and got


# pipeline


def test_pipeline_against_stage_rules(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [text(30) for _ in range(3)]
    texts = [text(60) for _ in range(120)]
    toxic = {i for i in range(0, 60, 3)}
    texts = [t + " . vilestuff here" if i in toxic else t for i, t in enumerate(texts)]
    texts += [texts[61] + " more", texts[61], text(30) + " " + bench[1] + " " + text(5), f'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text(30), None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids == set(range(126)) - toxic - {120, 121, 122}
    assert all(r["restored"] in (True, None) for r in out)
    secret = current.where("doc_id = 123").first()
    assert "[SECRET]" in secret["text"] and secret["n_chars"] == len(secret["text"])
    assert len(corpus_pipeline.STAGES) == 5


HARD = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, _id long, `a.b` string, _of long"


def tables(spark, folder):
    spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "passage " + " ".join(f"p{i}" for i in range(30))), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, ties, clashing names; and empty tables."""
    tables(spark, tmp_path)
    long = "long " * 40_000
    leak = "so " + " ".join(f"p{i}" for i in range(30))
    texts = [(0, None), (1, ""), (2, "..."), (3, "tie tie"), (4, "tie tie"), (5, long), (6, leak), (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é'), (None, "no id here"), (8, "repeated row"), (8, "repeated row"), (9, "今天天气很好我们去公园散步吧")]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None if t is None else len(t), "x", "y", i, "z", i) for i, t in texts], HARD)
    want = {
        "toxicity": [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, None], "ngram_jaccard_join": [0, 1, 2, 3, 5, 6, 7, 8, 9, None], "benchmark_decontamination": [0, 1, 2, 3, 5, 7, 8, 9, None],
        "secret_scan": [0, 1, 2, 3, 5, 7, 8, 9, None], "sentencepiece": [0, 1, 2, 3, 5, 7, 8, 9, None],
    }
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        rows = current.collect()
        assert sorted((r[0] for r in rows), key=str) == sorted(want[name], key=str), name
        if name != "sentencepiece":
            assert current.columns == docs.columns and current.dtypes == docs.dtypes, name
            kept = {r[0]: r for r in rows}
            assert kept[5][1] == long and kept[0][1] is None and kept[3][2] is None
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["ids"] is None and by[1]["ids"] == [] and all(r["restored"] in (True, None) for r in rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0, name


def test_run_leaves_one_stage_behind(spark, tmp_path):
    tables(spark, tmp_path)
    spark.createDataFrame([(1, "one text", "en", "s", 8), (2, "another", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = folder.removeprefix("file:")
    import os

    newest = max((os.path.join(path, x) for x in os.listdir(path) if x.startswith("pipeline-")), key=os.path.getmtime)
    assert os.listdir(newest) == ["secret_scan"]
