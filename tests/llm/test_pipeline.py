"""The pipeline on a small corpus, stage by stage against plain Python."""

import random

import corpus_pipeline
from tests.llm.test_texts import plain_components, plain_lines, plain_substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    parts = {"en": "th er on an re he in ed nd ha", "de": "sch ei ung der ie ch ge be ver zu"}
    words = {k: ["".join(rng.choice(v.split()) for _ in range(rng.randint(1, 3))) for _ in range(400)] for k, v in parts.items()}
    rows, shared = [], {k: " ".join(rng.choice(w) for _ in range(30)) for k, w in words.items()}
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = "\n".join(" ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 4)))
        kind = rng.random()
        if kind < 0.15 and rows:
            text, lang = rows[-1][1], rows[-1][2]
        elif kind < 0.3:
            text = f"{text} {shared[lang]} {text[:50]}"
        elif kind < 0.45:
            text += "\nAll rights reserved by us 2024"
        elif kind < 0.5:
            text = rng.choice(["", "123 456", None])
        rows.append((i, text, lang, f"s{i % 5}", len(text or "")))
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOC)
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(n == len(t or "") for _, t, _, _, n in after)
        texts = {r[0]: r[1] for r in after}
        if name == "language":
            assert set(texts) == {r[0] for r in before if any(c.isalpha() for c in r[1] or "")}
        elif name == "lines":
            want = {d: t for d, (t, n) in plain_lines(before).items() if not n or (t or "").split()}
            assert texts == want
        elif name == "similar":
            assert set(texts) == {d for d, (_, c) in plain_components(before, 5, 80, 100).items() if c == d}
        elif name == "passages":
            want = plain_substrings(before)
            assert {d: len((t or "").split()) for d, t in texts.items()} == {d: n - gone for d, (n, gone, _) in want.items() if gone < n or not gone}
            assert any(gone for _, gone, _ in want.values())
        kept[name] = after
    pieces = kept["packing"]
    assert {p[0] for p in pieces} == {r[0] for r in kept["passages"]}
    assert sum(p[3] for p in pieces) == sum(len((r[1] or "").encode().split()) for r in kept["passages"])
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(pieces, key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.collect() == []


def test_pipeline_with_clashing_columns(spark, tmp_path):
    """Further columns named like what the operators make pass through all stages."""
    names = ["kind", "n_words", "score", "lang_pred", "n_dropped", "N_Lines", "component_id", "bucket", "md", "__gone", "__text", "version", "key", "n_removed", "kept_sha256", "__c0", "doc", "run", "h"]
    rows = corpus()
    plain = spark.createDataFrame(rows, DOC)
    wide = spark.createDataFrame([(*r, *[f"{n} {r[0]}" for n in names]) for r in rows], DOC + "".join(f", `{n}` string" for n in names))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, plain, "").write.parquet(str(tmp_path / f"plain{i}"))
        stage(spark, wide, "").write.parquet(str(tmp_path / f"wide{i}"))
        plain, wide = spark.read.parquet(str(tmp_path / f"plain{i}")), spark.read.parquet(str(tmp_path / f"wide{i}"))
        if name != "packing":
            assert wide.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
            assert all(list(r)[5:] == [f"{n} {r[0]}" for n in names] for r in wide.collect())
        assert sorted(map(str, plain.collect())) == sorted(str(r) for r in wide.select(plain.columns).collect())


def test_pipeline_edges(spark, tmp_path):
    """Null, repeated and very long rows: whole, in order, and without a crash."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, long, "en", "a", len(long)), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "words of some text here", "en", "a", 5), (4, "words of some text here", "en", "a", 5), (None, "words of no id at all", "en", None, 9)]
    docs = spark.createDataFrame(rows, DOC)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert sorted((r.doc_id or 0 for r in docs.collect())) == [0, 1, 4, 4]
    by_doc = {}
    for r in docs.collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {1: 60_000, 4: 10, None: 6}
