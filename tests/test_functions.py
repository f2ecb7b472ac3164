"""Functions and operators of the engine against fixed cases and plain Python."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import addresses, media, times, vision
from strandline.functions import text as txt
from strandline.operators import clustering, filters, folds, glossary, intervals, rates, secrets
from strandline.plans import keyframes, transcript


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(col.alias("v")).first()["v"]


def test_time_forms(spark):
    for said, want in (("90", 90), ("1:30", 90), ("0:01:30.5", 90.5), (" 7.25 ", 7.25)):
        assert one(spark, times.parse_time(F.col("t")), t=said) == want
    for bad in ("1::30", "1: 30", "abc", "1:2:3:4", "-1", "90\n\n:1"):
        assert one(spark, times.parse_time(F.col("t"), strict=False), t=bad) is None
    with pytest.raises(Exception, match="invalid time"):
        one(spark, times.parse_time(F.col("t")), t="1::30")
    for sec, want in ((90.5, "1:30.5"), (3661.0, "1:01:01.0"), (-3.0, "0:00.0"), (59.96, "0:60.0")):
        assert one(spark, times.format_time(F.col("s")), s=sec) == want
    assert one(spark, times.srt_time(F.col("s")), s=3725.25) == "01:02:05,250"


def test_text_forms(spark):
    assert one(spark, txt.search_tokens(F.col("t")), t="Então a Ação do n8n, straße!") == ["entao", "acao", "n8n", "stra"]
    assert one(spark, txt.plain(F.col("t")), t=" É isso, aí! ") == "é isso aí"
    assert one(spark, txt.mask(F.col("t")), t="sk-abcdefghijklmnopqrstuvwxyz1234567890") == "sk-a…890"
    assert one(spark, txt.guess_language(F.col("t")), t="the cat and the dog with you") == "en"
    assert one(spark, txt.guess_language(F.col("t")), t="nothing much") == "auto"


def test_hashes(spark):
    up, down = [(i % 9) * 28 for i in range(72)], [255 - (i % 9) * 28 for i in range(72)]
    df = spark.createDataFrame([(up, down)], "a array<int>, b array<int>")
    r = df.select(vision.hamming(vision.dhash(F.col("a")), vision.dhash(F.col("a"))).alias("same"), vision.hamming(vision.dhash(F.col("a")), vision.dhash(F.col("b"))).alias("far"), vision.hash_hex(vision.dhash(F.col("b"))).alias("hex")).first()
    assert (r.same, r.far, r.hex) == (0, 64, "ffffffffffffffff")


def test_hash_dedup_keeps_what_differs_from_the_last_kept(spark):
    rows = [("m", i, float(i), h) for i, h in enumerate([0, 0, 0, -1, -1])]
    got = sorted((r.idx, r.distance) for r in folds.dedup_hashes(spark.createDataFrame(rows, "media_id string, idx int, pts double, dhash bigint")).collect())
    assert got == [(0, 64), (3, 64)]


def test_aspects(spark):
    def a(w, h):
        return one(spark, media.aspect(F.col("w"), F.col("h")), w=w, h=h)

    assert (a(1920, 1080).ratio, a(1920, 1080).in16x9, a(1920, 1080).fits) == ("16:9", "fits", ["youtube", "linkedin"])
    assert (a(1890, 1080).ratio, a(1890, 1080).in16x9, a(1890, 1080).fits) == ("7:4", "pillarbox", [])
    assert "tiktok" in a(1080, 1920).fits


@pytest.mark.parametrize(
    ("ip", "private"),
    [(x, True) for x in ("127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.1.1", "::1", "fd00::1", "fe80::1", "::ffff:10.0.0.1", "100.64.0.1", "64:ff9b::7f00:1", "2002:7f00:1::", "not an ip", "0:0:0:0:0:ffff:a00:1", "2001:db8::1", "ff02::1", None)]
    + [(x, False) for x in ("8.8.8.8", "1.1.1.1", "2606:4700:4700::1111", "172.32.0.1", "64:ff9b::808:808", "[2606:4700::1]")],
)
def test_addresses(ip, private):
    assert addresses.is_private(ip) is private


def test_filters(spark):
    rows = [(1, "Obrigado.", 2.0, 0.9), (2, "Thanks for watching!", 2.0, 0.9), (3, "hoje eu vou mostrar como se faz isso", 3.0, 0.9), (4, "qualquer coisa dita", 3.0, 0.05), (5, "agora clico nesse botão " * 4 + "pronto", 9.0, 0.9), (6, "  ", 1.0, 1.0), (7, "a b c d e f g h i", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "seg_id int, text string, duration double, ratio double")
    got = {r.seg_id: (r.keep, r.flags, r.text) for r in filters.filter_segments(df, filters.blocklist(spark)).collect()}
    assert got[1][:2] == (False, ["blocklist"]) and got[2][:2] == (False, ["blocklist"]) and got[3][:2] == (True, [])
    assert got[4][:2] == (False, ["no_speech"])
    assert got[5] == (True, ["repetition_loop"], "agora clico nesse botão pronto")
    assert got[6] == (False, ["empty"], "") and got[7][:2] == (True, ["too_fast"])
    assert filters.blocklist(spark).count() == 39


def test_glossary():
    assert glossary.correct("open the Graph Anna, then VS Panel", ["Grafana"]) == ("open the Graph Anna, then VS Panel", 0)
    assert glossary.correct("with Post Grass, and Posgres too", ["Postgres"]) == ("with Post Grass, and Postgres too", 1)
    assert glossary.correct("inside Cube Flaw, we", ["Kube Flow"]) == ("inside Kube Flow, we", 1)
    assert glossary.correct("the climate was fine", ["Calibre"]) == ("the climate was fine", 0)
    assert glossary.correct("x", []) == ("x", 0) and glossary.correct(None, ["a"]) == (None, 0)


def test_glossary_edits_match_plain():
    def plain(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert glossary.edits(a, b, 20) == plain(a, b)
        s, d, i = rates.alignment(list(a), list(b))
        assert s + d + i == plain(a, b) and len(a) - d + i == len(b)


def test_windows(spark):
    df = spark.createDataFrame([("m", 0, 0.0, 10.0), ("m", 1, 10.3, 20.0), ("m", 2, 40.0, 100.0)], "media_id string, region_id int, start_sec double, end_sec double")
    w = sorted((r.start_sec, r.end_sec) for r in transcript.plan_windows(df).collect())
    assert w[0] == (0.0, 20.0) and w[1][0] == 40.0 and len(w) > 2 and all(e - s <= 28 for s, e in w)


def test_overlap_join_matches_nested_loop(spark):
    rng = random.Random(3)
    make = lambda: sorted((f"m{rng.randrange(2)}", i, a := rng.randrange(0, 800) / 8, a + rng.randrange(0, 900) / 8) for i in range(60))  # noqa: E731, F841
    left, right = make(), make()
    a = spark.createDataFrame(left, "media_id string, i int, start_sec double, end_sec double")
    b = spark.createDataFrame(right, "media_id string, j int, r_start double, r_end double")
    got = sorted((r.media_id, r.i, r.j) for r in intervals.overlap_join(a, b, "media_id", 7.0).collect())
    assert got == sorted((m, i, j) for m, i, s, e in left for n, j, rs, re in right if m == n and s < re and rs < e)


def _plain_merge(cands, tol=0.75):
    out = []
    for pts, sources, h, dist in cands:
        if out and pts - out[-1][0] <= tol:
            c = out[-1]
            moves = "cut" in sources and "cut" not in c[1]
            c[1] |= set(sources)
            if moves:
                c[0] = pts
            if h is not None and c[2] is None:
                c[2], c[3] = h, dist
            if dist is not None and c[3] is not None:
                c[3] = max(c[3], dist)
        else:
            out.append([pts, set(sources), h, dist])
    return out


def test_candidate_merge_matches_plain(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for m in range(25):
        cands = sorted((rng.randrange(0, 120) / 8, rng.choice(["hash", "cut", "anchor"])) for _ in range(rng.randint(1, 14)))
        cands = [(p, [k], 5 if k == "hash" else None, rng.randrange(60) if k == "hash" else None) for p, k in cands]
        rows += [(f"m{m}", i, p, s, h, d) for i, (p, s, h, d) in enumerate(cands)]
        want[f"m{m}"] = [(p, sorted(s), h, d) for p, s, h, d in _plain_merge(cands)]
    df = spark.createDataFrame(rows, "media_id string, ord int, pts double, sources array<string>, dhash bigint, distance int")
    got = {}
    for r in folds.merge_candidates(df).orderBy("media_id", "ord").collect():
        got.setdefault(r.media_id, []).append((r.pts, sorted(r.sources), r.dhash, r.distance))
    assert got == want


@pytest.mark.parametrize(("preserve", "want"), [(False, [0.0, 32.0, 36.0]), (True, [4.0, 16.0, 28.0])])
def test_key_frames_of_a_still_picture(spark, preserve, want):
    """Forty seconds of one picture, a frame every four, at most three frames."""
    frames = spark.createDataFrame([("m", i, float(i), 0) for i in range(40)], "media_id string, idx int, pts double, dhash bigint")
    cuts = frames.limit(0).select("media_id", "pts")
    ends = spark.createDataFrame([("m", 40.0)], "media_id string, to_sec double")
    got = keyframes.select_frames(frames, cuts, ends, max_frames=3, floor_sec=4.0, preserve_floor=preserve)
    assert sorted(r.pts for r in got.collect()) == want


def test_clusters():
    import numpy as np

    rng = np.random.default_rng(0)
    centers = np.eye(3, 8)
    v = np.concatenate([c + rng.normal(0, 0.05, (6, 8)) for c in centers])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = clustering.cluster(v, np.ones(len(v)) * 5)
    assert labels == [0] * 6 + [1] * 6 + [2] * 6
    assert clustering.cluster(v[:0], np.ones(0)) == []
    assert len(set(clustering.cluster(v, np.ones(len(v)), threshold=2.0, most=2))) == 2
    tiny = np.array([1.0] * 6 + [30.0] * 6 + [0.1] * 6)
    assert len(set(clustering.cluster(v[[0, *range(6, 12), 12]], tiny[[0, *range(6, 12), 12]]))) == 1


def _scan(spark, text):
    df = spark.createDataFrame([("m", 0, 1.0, text)], "media_id string, frame_idx int, pts double, text string")
    return sorted(secrets.scan(df).collect(), key=lambda r: r.ord)


def _token(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("ABCDEFGHJKMNPQRSTVWXYZabcdefghjkmnpqrstvwxyz23456789") for _ in range(n))


def _jwt(head="eyJ"):
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    made = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone', 'n': 7})}.{_token(43)}"
    return head + made.removeprefix("eyJ")


def test_secrets_found(spark):
    key = "sk-" + "abcdefghijklmnopqrstuvwxyz1234567890"
    f = _scan(spark, f"key: {key}")
    assert f[0].confidence == "high" and f[0].masked == "sk-a…890" and f[0].length == len(key)
    assert _scan(spark, "AKIA" + "QWERTYUIOPASDFGH")[0].confidence == "high"
    for head in ("eyJ", "eyl"):
        f = _scan(spark, f"Settings\n{_jwt(head)}\nCopy your key now")
        assert (f[0].kind, f[0].confidence) == ("jwt", "high")
    assert any(x.kind == "private_url" for x in _scan(spark, "see https://my-own-app-12ab.up. railway .app/hook/new"))
    token = _token(60)
    with_cue = _scan(spark, f"Your API key:\n{token}\nshown once")
    assert [x.confidence for x in with_cue if x.kind == "high_entropy_token"] == ["medium"] and "context" in with_cue[0].signals
    assert [x.confidence for x in _scan(spark, token) if x.kind == "high_entropy_token"] == ["low"]


@pytest.mark.parametrize(
    "text",
    [
        "Hoje eu mostro como se muda a cor do texto dentro do editor.",
        "Ifyouwantto join the workspace, keep reading and write every day",
        "changed 3 weeks ago · last release 2 days ago · v4.1.9 · 312 stars",
        "Important update Please move to version 2.30.1 or later More about it",
        "state: public · order: newest · 12 items · 004 pages",
    ],
)
def test_prose_is_no_secret(spark, text):
    assert [f for f in _scan(spark, text) if f.confidence != "low"] == []


def test_personal_data_is_low(spark):
    assert {f.confidence for f in _scan(spark, "write to someone@example.com — secret")} == {"low"}
    assert _scan(spark, "CPF 987.654.321-00")[0].confidence == "low"


def test_redaction(spark):
    key = "sk-" + "Zy9" * 12
    text = f"first line\nuse {key} here\nlast line"
    df = spark.createDataFrame([("m", 0, 1.0, text)], "media_id string, frame_idx int, pts double, text string")
    clean = secrets.redacted(df, secrets.scan(df), ("media_id", "frame_idx", "pts")).first().text
    assert key not in clean and "first line" in clean and "last line" in clean and "…" in clean


def test_job_ids(spark):
    ids = ["j_0123456789ab", "j_0123456789AB", "j_0123456789a", "j_0123456789abc", "x_0123456789ab", "j_0123456789ab\n", "../j_0123456789ab", "", "j_"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(media.valid_job_id(F.col("id")).alias("v")).collect()
    assert [r.v for r in rows] == [True] + [False] * 8
