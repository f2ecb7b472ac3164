"""Trained, encoding, media, chat and search operators."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann_forest, byte_bpe, char_grams, chat, language_id, media, toxicity
from strandline.llm._common import Scratch

PUBLIC = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


# -- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.load_ranks(PUBLIC.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.ByteBpe(ranks, PUBLIC.PATTERN), tiktoken.Encoding("own", pat_str=PUBLIC.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(bpe):
    own, library = bpe
    rng = random.Random(0)
    alphabet = [*map(chr, range(0x20, 0x7F)), *"àéîõüßñçÄ", "漢", "字", "の", "é", "\n", "\t", "  ", " ", "😀", "\x00", "\x85", "ا", "ب", "١"]
    texts = ["", " ", "hello world", "It's we'll", "a" * 1000, " " * 700 + "x", "ab" * 600, "1" * 500]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_bpe_merges_leftmost_of_equal_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258}
    own = byte_bpe.ByteBpe(ranks, r"\S+|\s+")
    assert own.encode("aaab") == [256, 257]
    for n in (2, 3, 9, 33, 255, 256, 257, 300, 1000):
        assert own.encode("c" + "a" * n) == np.frombuffer(own.merge_long(b"c" + b"a" * n), "<u4").tolist()


def test_bpe_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ein Satz, straße.\n" * 5, "x"), (3, "Ein Satz, straße.\n" * 5, "x"), (None, "y " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encode_texts(df, PUBLIC.path("byte_bpe_multi_50k.tiktoken"), PUBLIC.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert byte_bpe.encode_texts(df.limit(0), PUBLIC.path("byte_bpe_multi_50k.tiktoken"), PUBLIC.PATTERN).collect() == []


# -- classifiers ---------------------------------------------------------------------------------


def test_grams():
    a = char_grams.grams("Abc", (2,), 16)
    assert len(a) == 4 and (a == char_grams.grams("aBC", (2,), 16)).all()
    assert len(char_grams.grams("", (1, 2), 10)) == 0 and len(char_grams.grams(None, (1,), 10)) == 0
    long = "xyz " * 700
    whole = np.sort(char_grams.grams(long, (1, 2, 3), 15))
    old, char_grams.STRETCH = char_grams.STRETCH, 64
    try:
        assert (np.sort(char_grams.grams(long, (1, 2, 3), 15)) == whole).all()
    finally:
        char_grams.STRETCH = old


def _prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_toxicity_learns(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(900):
        text, bad = _prose(rng, words, rng.randint(20, 120)), i % 3 == 0
        if bad:
            parts = text.split()
            for w in rng.sample(["grumblefax", "vilemuck", "snarkwit"], 2):
                parts.insert(rng.randrange(len(parts)), w)
            text = " ".join(parts)
        rows.append((i, text, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score_texts(df.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in rows[600:]]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_fit_matches_plain(spark):
    """Log-count ratios and the logistic fit, from sets of n-grams and dense matrices."""
    rng = random.Random(21)
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choice(["abra", "kadabra", "simsala", "bim", "alakazam"] if bad else ["tree", "house", "river", "abra", "garden", "stone"]) for _ in range(6)), int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    held = [set(char_grams.grams(t, toxicity.ORDERS, toxicity.BITS).tolist()) for _, t, _ in rows]
    y = np.array([t for *_, t in rows])
    weigh = {}
    for f in set().union(*held):
        have = [sum(f in h for h, t in zip(held, y, strict=True) if t == c) for c in (0, 1)]
        ratio = np.log((have[1] + 1) / (y.sum() + 2)) - np.log((have[0] + 1) / ((1 - y).sum() + 2))
        if sum(have) >= toxicity.MIN_DOCS and abs(ratio) >= toxicity.MIN_RATIO:
            weigh[f] = ratio
    assert set(np.flatnonzero(model.weights).tolist()) == set(weigh)
    features = sorted(weigh)
    x = np.array([[weigh[f] * (f in h) for f in features] for h in held])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.array([model.weights[f] / weigh[f] for f in features], float), model.bias
    # the gradient of the penalised loss is small at the fit, against its size at the start
    p = 1 / (1 + np.exp(-(x @ w + b)))
    grad = x.T @ ((p - y) * weight) + toxicity.L2 * w
    assert np.abs(grad).max() < 0.02 * np.abs(x.T @ ((0.5 - y) * weight)).max()
    for (_, text, _), score in zip(rows, p, strict=True):
        assert abs(model.score(text) - score) < 1e-4


def test_toxicity_learns_repeats_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_DOCS", 30)
    seen = []
    plain = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda starts, f, v, y, size: seen.append((int(y.sum()), len(y))) or plain(starts, f, v, y, size))
    rows = [(1, "bad words here", 1)] * 50 + [(i, f"good words number {i} there", 0) for i in range(100, 300)] + [(1, "bad words here", 0)] * 20 + [(2, "worse words", 1), (2, "other worse words", 1)]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert seen == [(3, 33)]


def test_columns_that_clash(spark):
    """Kept columns may have any name; what an operator makes replaces columns of its names."""
    df = spark.createDataFrame([(7, "some words", "mine", "k", 3, "v")], "doc_id long, text string, score string, __text string, `a.b` int, ids string")
    tox = toxicity.fit(df.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))
    got = toxicity.score_texts(df, tox, keep=tuple(df.columns))
    assert got.columns == ["doc_id", "text", "__text", "a.b", "ids", "score", "predicted"] and [tuple(r)[:5] for r in got.collect()] == [(7, "some words", "k", 3, "v")]
    lang = language_id.fit(df.select("doc_id", "text", F.lit("en").alias("lang")))
    got = language_id.predict(df, lang, keep=tuple(df.columns))
    assert [tuple(r) for r in got.collect()] == [(7, "some words", "k", 3, "v", "en", 1.0)]
    got = byte_bpe.encode_texts(df, PUBLIC.path("byte_bpe_multi_50k.tiktoken"), PUBLIC.PATTERN, keep=tuple(df.columns))
    assert got.columns == ["doc_id", "text", "score", "__text", "a.b", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and got.first()["ids"] != "v"


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (2, "", 0, "b"), (2, "", 0, "b"), (None, "x", 1, "c"), (4, "w " * 100_000, None, "d")], "doc_id long, text string, toxic int, score string")
    model = toxicity.fit(df)
    rows = toxicity.score_texts(df.select("doc_id", "text"), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(df.limit(0))
    assert {r.predicted for r in toxicity.score_texts(df, none).collect()} == {0}


def test_language_learns(spark):
    rng = random.Random(2)
    tongues = {"aa": "th er on an re he in ed nd ha", "bb": "sch ei ung der ie ch ge be ver zu", "cc": "ción os as ue ar el la do mi ó"}
    words = {k: ["".join(rng.choice(v.split()) for _ in range(rng.randint(1, 3))) for _ in range(200)] for k, v in tongues.items()}
    rows = []
    for i in range(450):
        lang = rng.choice(list(words))
        rows.append((i, _prose(rng, words[lang], rng.randint(8, 60)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 300"))
    got = {r.doc_id: r for r in language_id.predict(df.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[300:]]) > 0.97
    assert (model.weights == 0).mean() > 0.5 and 0.01 < model.temperature < 25


def plain_tf_idf(text, df, n):
    got = char_grams.grams(text, language_id.ORDERS, language_id.BITS).tolist()
    x = {b: (1 + np.log(got.count(b))) * (np.log((1 + n) / (1 + df.get(b, 0))) + 1) for b in set(got)}
    size = sum(v * v for v in x.values()) ** 0.5
    return {b: v / size for b, v in x.items()}


def test_tf_idf_matches_plain():
    texts = ["ein haus", "ein baum am haus", "a house", "a tree by the house", ""]
    df = {}
    for t in texts:
        for b in set(char_grams.grams(t, language_id.ORDERS, language_id.BITS).tolist()):
            df[b] = df.get(b, 0) + 1
    idf = np.log((1 + len(texts)) / (1 + np.array([df.get(b, 0) for b in range(1 << language_id.BITS)]))) + 1
    for t in texts:
        at, x = language_id.tf_idf(t, idf)
        want = plain_tf_idf(t, df, len(texts)) if t else {}
        assert at.tolist() == sorted(want) and np.allclose(x, [want[b] for b in at.tolist()])


def test_ftrl_matches_plain():
    """Each coordinate by the textbook update, one at a time."""
    rng = np.random.default_rng(7)
    size, classes, rows, y = 12, 3, [], rng.integers(0, 3, 40)
    for c in y.tolist():
        at = np.unique(np.r_[rng.integers(0, size, 4), c])
        rows.append((at, rng.random(len(at))))
    z, n = {}, {}

    def weight(i, c):
        zz = z.get((i, c), 0.0)
        l1, l2 = (language_id.L1, language_id.L2) if i >= 0 else (0.0, 0.0)
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((language_id.BETA + n.get((i, c), 0.0) ** 0.5) / language_id.ALPHA + l2)

    order = np.random.default_rng(0)
    for _ in range(language_id.PASSES):
        for r in order.permutation(len(y)).tolist():
            at, x = [*rows[r][0].tolist(), -1], [*rows[r][1].tolist(), 1.0]
            old = {(i, c): weight(i, c) for i in at for c in range(classes)}
            logit = np.array([sum(old[i, c] * v for i, v in zip(at, x, strict=True)) for c in range(classes)])
            p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
            for c in range(classes):
                for i, v in zip(at, x, strict=True):
                    g = (p[c] - (c == y[r])) * v
                    was = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / language_id.ALPHA * old[i, c]
                    n[i, c] = was + g * g
    w, b = language_id.ftrl(rows, y, classes, size)
    assert np.allclose(w, [[weight(i, c) for c in range(classes)] for i in range(size)]) and np.allclose(b, [weight(-1, c) for c in range(classes)])


def test_language_samples(spark, monkeypatch):
    """Repeats are in the sample once, an id's languages each, and many languages share the bound."""
    seen = []
    plain = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda rows, y, classes, size: seen.append((np.bincount(y, minlength=classes).tolist())) or plain(rows, y, classes, size))
    monkeypatch.setattr(language_id, "FIT_ALL", 12)
    rows = [(1, "guten tag", "de")] * 40 + [(1, "guten tag", "nl"), (2, "goede dag", "nl")] + [(i, f"hello number {i}", "en") for i in range(10, 60)] + [(1000 + i, "x y z", f"l{i}") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "l0", "l1", "l2", "nl"] and seen == [[1, 2, 1, 1, 1, 2]]
    many = [(i, f"text {i}", f"tongue{i:04d}") for i in range(600)]
    assert len(language_id.fit(spark.createDataFrame(many, "doc_id long, text string, lang string")).langs) == 600


def test_language_of_very_long_texts(spark):
    rng = random.Random(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts.split()) for _ in range(2)) for _ in range(n))
    rows = [(i, make("th er on he in", 20), "aa") for i in range(40)] + [(100 + i, make("sch ei ung der", 20), "bb") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = spark.createDataFrame([(1, make("th er on he in", 200_000)), (1, make("sch ei ung der", 200_000))], "doc_id long, text string")
    assert sorted(r.lang_pred for r in language_id.predict(long, model).collect()) == ["aa", "bb"]


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "Hallo", "de"), (2, None, "de"), (3, "123 !!", None), (None, "x", "fr"), (4, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert got[1] == ("de", 1.0) and got[2] == got[3] == got[4] == ("und", 0.0)
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(df.limit(0), none).collect() == []


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (4000, 4))
    y = np.array([rng.choice(4, p=p) for p in language_id.softmax(logits)])
    assert abs(language_id.calibrate(logits * 3, y) - 3) < 0.4


# -- nearest neighbours --------------------------------------------------------------------------


def _exact(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted((-float((q * v).sum()), j) for j, v in good if j != i)[:k]
    return out


def test_nearest_is_exact_when_all_leaves_are_taken(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "TARGET_RECALL", 1.1)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1 + i % 3, 8).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [2.0] * 6), (2060, [float("nan")] * 8), (2080, [1.0] * 7), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in {r[0]: r for r in rows}.values()]
    want = _exact(rows32, 20)
    got = {}
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [v for _, v in found] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in found], [-s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_nearest_recall(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (3000, 8)))]
    want = _exact([(i, np.float32(v).astype(float).tolist()) for i, v in rows], 20)
    got = {}
    for r in ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {j for _, j in w}) / 20 for q, w in want.items()]) >= 0.9


def test_nearest_of_many_ties(spark, monkeypatch):
    """Hundreds of distinct vectors with equal scores: the smallest ids of all that tie."""
    monkeypatch.setattr(ann_forest, "TARGET_RECALL", 1.1)
    monkeypatch.setattr(ann_forest, "LEAF", 64)
    rng = random.Random(5)
    rows = [(0, [1.0] + [0.0] * 7, "x", 1)]
    ids = list(range(1, 900))
    rng.shuffle(ids)
    rows += [(i, [1.0 if n % 3 else -1.0, *[float(rng.randrange(-50, 50)) for _ in range(7)]], "y", n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query string, ids int")
    want = _exact([r[:2] for r in rows], 20)
    got = {}
    for r in ann_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for _, j in w] for q, w in want.items()}
    assert got[0] == sorted(i for n, i in enumerate(ids) if n % 3)[:20]


def _clustered(n, rng):
    """64-dimensional vectors around one centre for every 40."""
    centres = rng.normal(0, 1, (max(1, n // 40), 64))
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.25, (n, 64))).astype(np.float32)


def _nearest(x, queries, k):
    out = []
    for i in queries:
        score = x @ x[i]
        score[i] = -np.inf
        out.append(np.argpartition(-score, k)[:k])
    return out


def test_forest_at_two_sizes():
    """Recall holds, the share of the vectors that a query is compared with falls with their number, and the forest stays small."""
    rng, compared = np.random.default_rng(9), []
    for n in (8_000, 64_000):
        x = _clustered(n, rng).astype(float)
        forest = ann_forest.grow(x[:4_000], float(np.sqrt((x * x).sum(axis=1).max())), n)
        assert forest.depth == int(np.ceil(np.log2(n / ann_forest.LEAF))) and forest.planes.nbytes + forest.cuts.nbytes + forest.deep.nbytes < 2_000_000
        forest.leaves = ann_forest.calibrated(forest, x[:256], [x[near] for near in _nearest(x, range(256), 20)])
        where, hits, work = forest.leaf_of(x), [], []
        for i, near in zip(range(5_000, 5_100), _nearest(x, range(5_000, 5_100), 20), strict=True):
            taken = np.zeros(n, bool)
            for t, leaf in forest.search(x[i], forest.leaves):
                taken |= where[:, t] == leaf
            hits.append(taken[near].mean())
            work.append(taken.sum())
        assert np.mean(hits) >= 0.9
        compared.append(np.mean(work))
    assert compared[1] / 64_000 < 0.6 * compared[0] / 8_000, compared


def test_nearest_of_probes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 8))
    df = spark.createDataFrame([(v.tobytes(),) for v in x], "vec binary").repartition(3)
    for got, want in zip(ann_forest.nearest_of(df, x[:7], 5), _nearest(x, range(7), 5), strict=True):
        assert sorted(map(tuple, got)) == sorted(map(tuple, x[want]))
    assert [len(v) for v in ann_forest.nearest_of(df.limit(2), x[:1], 5)] in ([1], [2])


def test_deep_nodes_split_evenly():
    """Beyond the levels that the sample can fit, leaves stay near their size."""
    rng = np.random.default_rng(2)
    x = _clustered(60_000, rng).astype(float)
    forest = ann_forest.grow(x[:600], float(np.sqrt((x * x).sum(axis=1).max())), len(x))
    assert forest.depth > forest.upper > 0
    where = forest.leaf_of(x)
    for t in range(ann_forest.TREES):
        assert np.bincount(where[:, t]).max() < 20 * len(x) / forest.first_leaf
    walked = forest.search(x[0], ann_forest.TREES * forest.first_leaf)
    assert len(walked) == len(set(walked)) == ann_forest.TREES * forest.first_leaf


@pytest.mark.parametrize("repeats", [1, 12])
def test_ties_in_a_block_go_to_the_smaller_id(repeats):
    rng = np.random.default_rng(11)
    x = np.unique(rng.integers(0, 2, (600, 12)), axis=0).astype(float)
    x = rng.permutation(x[x.any(axis=1)])
    own = np.arange(len(x)) // repeats  # an id may have several vectors
    batch = [(0, 0, None, v.tobytes(), [int(i)]) for v, i in zip(x, own, strict=True)] + [(0, 1, int(i), v.tobytes(), None) for v, i in zip(x[:40], own, strict=False)]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), types, strict=True)], names=["bucket", "kind", "query", "vec", "ids"])
    for out in ann_forest._rank(5)(iter([made])):
        assert out.num_rows == 40
        for n, (query, ids, scores) in enumerate(zip(*(c.to_pylist() for c in out.columns), strict=True)):
            best = {}
            for s, i in zip((x @ x[n]).tolist(), own.tolist(), strict=True):
                best[i] = max(s, best.get(i, s))
            want = sorted((-s, i) for i, s in best.items() if i != query)[:5]
            assert list(zip((-np.frombuffer(scores)).tolist(), np.frombuffer(ids, np.int64).tolist(), strict=True)) == want


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = ann_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# -- media ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_stored_payloads_come_back(n):
    raw = bytes(random.Random(n).randrange(256) for _ in range(n))
    payload = media.payload_of(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == raw and not any(payload[n:])
    assert media.read_back(media.store(payload)) == payload and len(media.feature(payload)) == 16


def test_damaged_media_are_refused():
    stored = bytearray(media.store(media.payload_of(b"abc")))
    stored[50] ^= 1
    with pytest.raises(ValueError):
        media.read_back(bytes(stored))


def test_sequences_keep_order_and_captions():
    html = "<title>T</title><script>var x='<p>';</script><p>one &amp; two</p><figure><img src='sha256:aa' alt='a'><figcaption>cap <b>x</b></figcaption></figure><p>three<br>four<img src=b.png alt=' alt  text '>five<video src='v.mp4'></video>"
    got = [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in media.parse_sequence(html)]
    assert got == [(0, "text", "T", None, None), (1, "text", "one & two", None, None), (2, "img", None, "sha256:aa", "cap x"), (3, "text", "three", None, None), (4, "text", "four", None, None), (5, "img", None, "b.png", "alt text"), (6, "text", "five", None, None), (7, "video", None, "v.mp4", None)]
    assert media.parse_sequence(None) == [] and media.parse_sequence("<p") is not None


def test_media_resolve(spark):
    text = "Grüße"
    digest = hashlib.sha256(text.encode()).hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{digest}' alt='c'><img src='sha256:00'>"), (2, None), (3, f"<video src='sha256:{digest}'></video>")], "page_id long, html string")
    stored = media.store_texts(spark.createDataFrame([(text,), (text,), (None,), ("",)], "text string"), Scratch(spark, "t"))
    assert stored.select("digest").distinct().count() == 2
    refs = media.references(media.interleave(pages), "page_id")
    found = media.payloads_of(refs, stored)
    assert found.count() == 1 and media.read_back(bytes(found.first().media)) == media.payload_of(text.encode())
    rows = sorted(media.resolve(refs, media.describe(found)).collect(), key=lambda r: (r.page_id, r.pos))
    assert [(r.page_id, r.pos, r.kind, r.caption, r.n_bytes) for r in rows] == [(1, 1, "img", "c", 7), (1, 2, "img", None, None), (3, 0, "video", None, 7)]
    back = media.payload_of(text.encode())
    assert rows[0].payload_sha256 == hashlib.sha256(back).hexdigest() and rows[0].tail_crc32 == zlib.crc32(back[-64:])
    assert media.resolve(refs, found).where("media is not null").count() == 2


def test_sequences_of_real_pages(spark):
    """Blocks of the given pages in order: what is left of the source when tags go, blanks aside."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.sequence for r in media.interleave(pages.withColumn("sequence", F.lit(1))).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<!DOCTYPE[^>]*>", " ", r.html)
        said = entities.unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        assert " ".join(x.text for x in got[r.page_id] if x.text).split() == said
        assert [x.pos for x in got[r.page_id]] == list(range(len(got[r.page_id])))


def test_op9_matches_plain(spark, tmp_path):
    """The whole query: nulls, empty, very long, repeated texts, repeated ids, clashing columns."""
    rng = random.Random(14)
    texts = [None, "", "\0", "a\0", "x" * 63, "y" * 64, "z" * 65, "Grüße", "Grüße", "hot", "hot", "hot", "".join(chr(rng.randrange(32, 1000)) for _ in range(400_000))]
    rows = [(i, t, "d", 1) for i, t in enumerate(texts)] + [(3, "again", "d", 2), (None, "no id", "d", 3)]
    schema = "doc_id long, text string, digest string, pos int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))

    def plain_feature(samples):
        image = np.frombuffer(samples, np.uint8).reshape(-1, 64).astype(int)
        n, bits = len(image), ""
        for i in range(8):
            a, b = i * n // 8, max(i * n // 8 + 1, (i + 1) * n // 8)
            for j in range(8):
                field = image[a:b, j * 8 : j * 8 + 8]
                bits += "1" if int(field.sum()) * image.size > int(image.sum()) * field.size else "0"
        return f"{int(bits, 2):016x}"

    want = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), plain_feature(payload), 1, f"Text of {len(raw)} bytes"))
    got = media.op9_media_columns(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature, r.pos, r.caption) for r in got), key=str) == sorted(want, key=str)
    stored = {r.payload_sha256: (r.media_bytes, r.media_sha256) for r in got}
    for doc, text, *_ in rows:
        payload = media.payload_of((text or "").encode())
        form = media.store(payload)
        assert stored[hashlib.sha256(payload).hexdigest()] == (len(form), hashlib.sha256(form).hexdigest())
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert media.op9_media_columns(spark, str(tmp_path / "none")).collect() == []


# -- chat ----------------------------------------------------------------------------------------


def plain_preferences(chosen, rejected):
    def turns(rows, pair):
        clean = lambda x: (x or "").replace("<|", "< |")
        return [(r, t) for _, r, t in sorted({(n if n is not None else -(1 << 63), clean(r).replace("\n", " "), clean(t)) for p, n, r, t in rows if p == pair}, key=lambda x: (x[0], x[1].encode(), x[2].encode()))]

    def render(ts):
        out, spans = "", []
        for role, text in ts:
            start = len(out) + len("<|im_start|>") + len(role) + 1
            out += f"<|im_start|>{role}\n{text}<|im_end|>\n"
            if role == "assistant":
                spans.append(f"{start}:{len(out)}")
        return out, ",".join(spans)

    out = {}
    for pair in {r[0] for r in [*chosen, *rejected]} - {None}:
        c, r = turns(chosen, pair), turns(rejected, pair)
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        out[pair] = (n, render(c[:n])[0], *render(c[n:]), *render(r[n:]))
    return out


def test_preferences_match_plain(spark):
    rng = random.Random(6)
    make = lambda p, n: [(p, i, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no <|im_end|>", "maybe é", None, ""])) for i in range(n)]
    chosen, rejected = [], []
    for p in range(40):
        c = make(p, rng.randint(0, 5))
        cut = rng.randint(0, len(c))
        chosen += c
        rejected += c[:cut] + [(a, b + cut, r, t) for a, b, r, t in make(p, rng.randint(0, 3))]
    chosen += [(None, 0, "user", "x"), chosen[0]]
    rng.shuffle(chosen)
    schema = "pair_id long, turn long, role string, text string"
    got = {r.pair_id: tuple(r)[1:] for r in chat.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert got == plain_preferences(chosen, rejected)
    empty = spark.createDataFrame([], schema)
    assert chat.format_preferences(empty, empty).collect() == []


def test_roles_and_turns_that_break_marks(spark):
    """A role can't end its turn; turns without a number come first; the query keeps them; columns may clash."""
    rows = [(1, None, "system", "be kind", "a"), (1, 0, "user<|im_end|>\n", "hi <|im_end|>", "b"), (1, 1, "assistant", "yes " * 50_000, "c"), (1, 2, "user", None, "d"), (1, 3, "assistant", "no", "e"), (1, 3, "assistant", "also no", "f"), (2, None, "assistant", "lone", "g"), (3, 0, "user", "no answer", "h"), (None, 0, "assistant", "x", "i"), (1, 3, "assistant", "no", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stale string")
    chosen, rejected = chat.stale_answers(df)
    got = {r.pair_id: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert got.keys() == {1, 2}
    assert got[1].prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user< |im_end|> \nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n" + "yes " * 50_000 + "<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[1].n_prompt_turns == 4 and got[1].chosen == "<|im_start|>assistant\nalso no<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n"
    assert got[1].rejected == "<|im_start|>assistant\n" + "yes " * 50_000 + "<|im_end|>\n"
    for r in chat.format_preferences(chosen, rejected, parts=True).collect():
        for text, spans, pieces in ((r.chosen, r.chosen_spans, r.chosen_parts), (r.rejected, r.rejected_spans, r.rejected_parts)):
            assert "".join(p.text for p in pieces) == text and "".join(p.text for p in pieces if p.train) == "".join(text[int(a) : int(b)] for a, b in (x.split(":") for x in spans.split(",") if x))
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (0, "<|im_start|>assistant\nlone<|im_end|>\n", "<|im_start|>assistant\n<|im_end|>\n")
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[int(a) : int(b)].endswith("<|im_end|>\n") and text[: int(a)].endswith("assistant\n") for a, b in (x.split(":") for x in spans.split(",") if x))


def test_preferences_sql_matches_the_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(17)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", "assistant", "assistant", None, "sys<|tem"]), rng.choice(["yes", "no <|im_end|>", "é", None, ""])) for _ in range(220)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op8_preference_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(chat.OP8_SQL)
    names = [c[0] for c in found.description]
    assert names == got.columns and sorted(map(tuple, got.collect())) == sorted(found.fetchall())


# -- the whole -----------------------------------------------------------------------------------


def test_registry_names():
    from strandline.llm import registry

    names = registry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert registry.oracle_sql().keys() <= names.keys()
    json.dumps(sorted(names))
