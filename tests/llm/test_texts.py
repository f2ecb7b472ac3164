"""Operators on texts against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import components, jaccard_join, line_dedup, packing, substring_dedup
from strandline.llm._common import Scratch, WordHasher, words_of
from strandline.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=120, vocabulary=60):
    """Random texts with copies, near-copies, shared passages, shared lines, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    words = [word() for _ in range(vocabulary)] + ["Zed", "x1", "ünï", "é"]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", "", "\n", "\t", " \n"]) for _ in range(k))
    shared = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(3)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.35 and texts:
            old = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(1, 3)):
                if old:
                    old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        elif kind < 0.55:
            texts.append(f"{text(rng.randint(0, 30))}\n{rng.choice(shared)}\n{text(rng.randint(0, 30))}")
        else:
            texts.append(rng.choice([None, "", " \n ", text(rng.randint(1, 5)), text(rng.randint(5, 80)), text(60)]))
    return [(i * 3, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


# -- substring dedup -----------------------------------------------------------------------------


def plain_substrings(rows, window=13):
    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [13, 5, 2])
def test_substrings_match_plain(spark, window):
    rows = corpus(window, 90, vocabulary=25)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOC), window).collect()}
    assert got == plain_substrings(rows, window)


def test_cover_has_every_difference():
    for period, residues in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def test_substrings_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "a"), (1, long, "a"), (None, long, "b"), (2, f"x {long}\n\ty", "c"), (3, None, None), (4, "", "d"), (5, "z " * 20_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(df).collect()), key=str)
    assert got == sorted([(1, 30, 0, long), (1, 30, 0, long), (None, 30, 0, long), (2, 32, 30, "x y"), (3, 0, 0, None), (4, 0, 0, ""), (5, 20_000, 0, "z " * 20_000)], key=str)
    assert substring_dedup.dedup_substrings(df.limit(0)).collect() == []


def test_substrings_of_hot_windows(spark, monkeypatch):
    """A passage that all documents hold, in stretches and buckets of a few entries."""
    monkeypatch.setattr(substring_dedup, "FLUSH", 40)
    monkeypatch.setattr(substring_dedup, "HELD", 25)
    monkeypatch.setattr(substring_dedup, "PER_BUCKET", 60)
    rng = random.Random(8)
    hot = " ".join(f"h{i}" for i in range(18))
    rows = [(i * 2, " ".join([*[f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 9))], hot, *[f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 20))], *([hot] if i % 5 == 0 else [])])) for i in range(150)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_substrings(rows)


def test_settle_keeps_the_least_document():
    h, doc, pos = np.array([5, 5, 7, 5, 9, 9], np.uint64), np.array([3, 1, 2, 1, 4, 4]), np.array([0, 2, 4, 6, 8, 9], np.int32)
    (d, p), on = substring_dedup.settle(h, doc, pos, False)
    assert list(zip(d, p, strict=True)) == [(3, 0)] and sorted(zip(*map(np.ndarray.tolist, on), strict=True)) == [(5, 1, 2), (5, 1, 6), (7, 2, 4), (9, 4, 8), (9, 4, 9)]
    (d, p), on = substring_dedup.settle(h, doc, pos, True)
    assert sorted(zip(d.tolist(), p.tolist(), strict=True)) == [(1, 2), (1, 6), (3, 0)] and sorted(zip(*map(np.ndarray.tolist, on), strict=True)) == [(5, 1, -1), (7, 2, 4), (9, 4, 8), (9, 4, 9)]
    (d, p), _ = substring_dedup.settle(np.array([5, 5], np.uint64), np.array([1, 1]), np.array([-1, 3], np.int32), True)
    assert (d.tolist(), p.tolist()) == ([1], [3])
    assert all(len(x) == 0 for part in substring_dedup.settle(h[:0], doc[:0], pos[:0], True) for x in part)


def test_substrings_pass_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(1, text, "k1", 5, "b1", "x"), (2, text, "k2", 6, "b2", "y")], "doc_id long, text string, kind string, n_words int, bucket string, __x0 string")
    got = sorted(substring_dedup.dedup_substrings(df, 13, ("kind", "n_words", "bucket", "__x0")).drop("kept_sha256").collect())
    assert [r.asDict() for r in got] == [{"doc_id": 1, "text": text, "n_words": 15, "n_removed": 0, "kind": "k1", "bucket": "b1", "__x0": "x"}, {"doc_id": 2, "text": "", "n_words": 15, "n_removed": 15, "kind": "k2", "bucket": "b2", "__x0": "y"}]


def test_cut_text_keeps_layout():
    assert substring_dedup.cut_text(" a  b\nc d ", np.array([False, True, True, False])) == " a  d "


# -- Jaccard join --------------------------------------------------------------------------------


def plain_sets(rows, k):
    out = {}
    for d, t, *_ in rows:
        w = words_of(t, lower=True)
        out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def plain_components(rows, k, num, den):
    sets = plain_sets(rows, k)
    at = {d: d for d in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("k", "num", "den", "tile"), [(4, 85, 100, 2048), (5, 80, 100, 3), (2, 50, 100, 2)])
def test_jaccard_matches_plain(spark, monkeypatch, k, num, den, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = corpus(k, 140, vocabulary=300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(spark.createDataFrame(rows, DOC), k, num, den).collect()}
    assert got == plain_components(rows, k, num, den)


def test_jaccard_large_group_of_near_copies(spark, monkeypatch):
    """Members differ from each other more than from the base: links come only through others."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(spark.createDataFrame(rows, DOC), 4, 85, 100).collect()}
    assert got == plain_components(rows, 4, 85, 100)


def test_jaccard_edges(spark):
    rows = [(7, "a b", 1), (3, "A  B", 1), (3, "A  B", 1), (9, None, 1), (8, " ", 1), (None, "a b", 1), (2, "q", 1)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string, component long"), 4, 85, 100).collect()), key=str)
    assert got == sorted([(7, 1, 3), (3, 1, 3), (3, 1, 3), (9, 0, 9), (8, 0, 8), (None, 1, None), (2, 1, 2)], key=str)
    assert jaccard_join.similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_jaccard_runs_dealt_to_several_tasks(spark, monkeypatch):
    """Shingles that many documents hold, in pieces of a few members, with pivots of pieces compared."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "PER_BUCKET", 300)
    rng = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(50)]
        for i in range(60):
            w = list(base[: rng.choice([50, 50, 40, 30])])
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
            rows.append((g * 100 + i, " ".join(w), "en", "s", 0))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOC)
    _, counts, _ = jaccard_join.frequent_shingles(docs, 4, Scratch(spark, "t"))
    assert (counts > 8).sum() > 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(docs, 4, 85, 100).collect()}
    assert got == plain_components(rows, 4, 85, 100)


def test_jaccard_very_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    near = list(long)
    for _ in range(500):
        near[rng.randrange(len(near))] = "changed"
    rows = [(5, " ".join(long), "x"), (2, " ".join(near), "y"), (9, " ".join(long[:60_000]), "z")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), 4, 85, 100).collect()}
    assert got == plain_components(rows, 4, 85, 100) and got[5][1] == got[2][1] == 2 and got[9][1] == 9


def test_bitmap_bounds_overlap_from_above():
    rng, words = random.Random(1), WordHasher()
    for _ in range(300):
        pool = [str(rng.randrange(400)) for _ in range(rng.randint(5, 300))]
        a = jaccard_join.shingles(" ".join(pool), 2, words)
        b = jaccard_join.shingles(" ".join(pool[: rng.randint(1, len(pool))] + [str(rng.randrange(900)) for _ in range(rng.randint(0, 60))]), 2, words)
        real = len(np.intersect1d(a, b))
        assert jaccard_join.shared_size(a, b) == real
        assert jaccard_join.overlap_bound(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b)) >= real


@pytest.mark.parametrize("part", [500_000, 20])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(1, 1), (None, 3)]
    at = {x: x for link in links for x in link if x is not None}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            at[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


# -- line dedup ----------------------------------------------------------------------------------


def plain_lines(rows, depth=3, min_docs=3, min_tokens=4, num=7, den=10):
    shape_docs, first, held = defaultdict(set), {}, []
    for d, t, *_ in rows:
        for i, raw in enumerate((t or "").split("\n") if t is not None else []):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in raw.replace("\t", " ").split(" ") if w)
            if len(tokens) >= min_tokens and d is not None:
                shape_docs[tokens].add(d)
                held.append((d, i, tokens))
    leaves = defaultdict(list)
    for s in shape_docs:
        leaves[(len(s), s[:depth])].append(s)
    template = {}
    for shapes in leaves.values():
        total = sum(len(shape_docs[s]) for s in shapes)
        have = Counter()
        for s in shapes:
            for p, w in enumerate(s):
                have[(p, w)] += len(shape_docs[s])
        for s in shapes:
            template[s] = ("line", s)
            if len(shapes) > 1 and total >= min_docs:
                const = tuple(w if w != "<*>" and have[(p, w)] >= min_docs else None for p, w in enumerate(s))
                if den * sum(c is not None for c in const) >= num * len(s):
                    template[s] = ("template", const)
    docs = defaultdict(set)
    for d, _, s in held:
        docs[template[s]].add(d)
    first = {t: min(ds) for t, ds in docs.items() if len(ds) >= min_docs}
    gone = {(d, i) for d, i, s in held if template[s] in first and d > first[template[s]]}
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone), sum(a == d for a, _ in gone)) for d, t, *_ in rows}


def test_lines_match_plain(spark):
    rng = random.Random(4)
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines.append(rng.choice([f"Copyright {rng.randrange(99)} by the firm {rng.choice('ABC')} and friends", "All rights are reserved here", " ".join(rng.choice("pqrst") for _ in range(rng.randint(1, 7))), "", f"page {rng.randrange(9)} of all {rng.randrange(9)}", "  user\tbob logged in from home again today "]))
        rows.append((d, "\n".join(lines)))
    rows.append((500, None))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows)


def test_lines_edges(spark):
    line = "one two three four"
    rows = [(1, line, 5), (1, line, 5), (2, f"{line}\nkept", 6), (None, line, 7), (3, "", 8), (4, None, 9), (6, line, 1), (7, "x" * 300_000 + " " + line, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect() if r.doc_id != 7), key=str)
    assert found == sorted([(1, line, 0), (1, line, 0), (2, "kept", 1), (None, line, 0), (3, "", 0), (4, None, 0), (6, "", 1)], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_lines_cut_from_a_long_text(spark):
    """Many lines of one text go; columns named like what the operator makes are kept or replaced."""
    lines = [f"this is line of words {''.join(chr(97 + int(c)) for c in str(i))} and so on" for i in range(3000)]
    rows = [(d, "\n".join(lines if d else [*lines[:10], "own words only here once", *lines[10:]]), "g", "v", 7) for d in (3, 0, 5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone string, version string, N_Lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {d: (r.n_lines, r.n_dropped, r["__gone"], r.version) for d, r in got.items()} == {0: (3001, 0, "g", "v"), 3: (3000, 3000, "g", "v"), 5: (3000, 3000, "g", "v"), 9: (3000, 3000, "g", "v")}
    assert {d: (r.text, r.n_dropped) for d, r in got.items()} == plain_lines([r[:2] for r in rows])


def test_lines_short_of_the_depth(spark):
    rows = [(d, "a b\nc d e\nx y 1\nx y 2\nq") for d in range(4)] + [(9, "x z 1")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=2).collect()}
    assert got == plain_lines(rows, min_tokens=2)


def test_lines_stay_in_the_jvm(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame(corpus(), DOC))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- packing -------------------------------------------------------------------------------------


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


@pytest.mark.parametrize("sources", [3, 200])
def test_best_fit_matches_plain(sources):
    rng = random.Random(sources)
    n = 700
    lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
    src = [rng.choice([None, rng.randrange(sources)]) for _ in range(n)]
    clu = [rng.randrange(150) for _ in range(n)]
    bins, offsets = packing.best_fit(lengths, src, clu, 100)
    assert list(zip(bins, offsets, strict=True)) == plain_best_fit(lengths, src, clu, 100)


def test_packing_is_whole_and_without_conflicts(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([0, None, rng.randint(1, 40), 100, 257]), rng.choice([None, "hot", f"s{rng.randrange(9)}"]), rng.randrange(200)) for i in range(900)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, source string, cluster long")
    rows = packing.pack_documents(df, 100, shard_docs=250).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for d, n, _, _ in items:
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        at = 0
        for r in pieces:
            assert r.start == at
            at += r.length
        assert at == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 100))
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.length
        assert at <= 100
        sources = [items[r.doc_id][2] for r in pieces if items[r.doc_id][2]]
        clusters = [items[r.doc_id][3] for r in pieces]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert packing.pack_documents(df.limit(0)).collect() == []


def plain_shard(rows, capacity):
    """Pieces without their shard's bins: (doc, piece, start, length), and who shares a bin with whom."""
    items, pieces, own = [], [], []
    for doc, length, source, cluster in rows:
        full, rest = divmod(length or 0, capacity)
        own += [[(doc, i, i * capacity, capacity)] for i in range(full)]
        if rest:
            items.append((rest, (doc is None, doc or 0), length, source is not None, source or "", cluster, (doc, full, full * capacity, rest), source))
        elif not full:
            pieces.append((doc, 0, 0, 0))
    items.sort(key=lambda r: (-r[0], r[1], r[2], not r[3], r[4], r[5] is None, r[5] or 0))
    bins = defaultdict(list)
    for (bin_no, _), item in zip(plain_best_fit([r[0] for r in items], [r[7] for r in items], [r[5] for r in items], capacity), items, strict=True):
        bins[bin_no].append(item[6])
    return pieces, sorted([*own, *bins.values()], key=str)


def test_pack_texts_matches_plain(spark, monkeypatch):
    """All rows, with null and repeated ids, repeated rows, copies and clashing columns, shard by shard."""
    rng = random.Random(31)
    rows = []
    for i in range(400):
        text = rng.choice([None, "", "one two", "One  two", "a\tb c", " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 120)))])
        rows.append((rng.choice([None, i, i, i // 2]), text, rng.choice([None, "hot", "hot", f"s{i % 7}"]), i % 3, "bin"))
    rows += [rows[-1]] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, bin_id string")
    made = packing.pack_documents(df.select("doc_id", packing.word_count(F.col("text")).alias("n_tokens"), "source", packing.copy_cluster(F.col("text")).alias("cluster")), 50, shard_docs=100).collect()
    shards = defaultdict(list)
    keyed = df.select("doc_id", packing.word_count(F.col("text")).alias("n_tokens"), "source", packing.copy_cluster(F.col("text")).alias("cluster"))
    count = Counter()
    for r in keyed.collect():
        count[tuple(r)] += 1
    flat = [(*k, c) for k, n in count.items() for c in range(n)]
    n_shards = 1 + len(rows) // 100
    dealt = spark.createDataFrame(flat, "doc_id long, n_tokens long, source string, cluster long, copy long").select("*", F.pmod(F.xxhash64("doc_id", "n_tokens", "source", "cluster", "copy"), F.lit(n_shards)).alias("shard")).collect()
    for r in dealt:
        shards[r.shard].append(tuple(r)[:4])
    assert len(shards) == n_shards and max(map(len, shards.values())) < 2 * len(rows) / n_shards
    want_bins, want_empty = [], []
    for shard in shards.values():
        empty, bins = plain_shard(shard, 50)
        want_bins += bins
        want_empty += empty
    got = defaultdict(list)
    for r in sorted(made, key=lambda r: (r.bin_id is None, r.bin_id or 0, r.bin_start or 0)):
        got[r.bin_id].append((r.doc_id, r.piece, r.start, r.length))
    assert sorted(got.pop(None), key=str) == sorted(want_empty, key=str)
    assert sorted(got.values(), key=str) == sorted(want_bins, key=str)
    whole = packing.pack_texts(df)
    assert whole.columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_start"] and whole.agg(F.sum("length")).first()[0] == sum(len(words_of(r[1])) for r in rows)


def test_copy_cluster(spark):
    texts = [None, "", "A  b", "a\nB", "ab"]
    a = [r.c for r in spark.createDataFrame([(t,) for t in texts], "text string").select(packing.copy_cluster(F.col("text")).alias("c")).collect()]
    assert a[0] is None and a[2] == a[3] and len(set(a)) == 4


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a\tb\n\x0bc ", "é ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(packing.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [len(words_of(t)) for t in texts]
