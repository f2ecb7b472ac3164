"""Composite calls with stand-in models, jobs that outlive their process, trimming, downloads, tools, models, pools."""

import json
import os
import random
import sys
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.config import Config
from strandline.errors import EngineError
from strandline.operators import filters, jobs, rates
from strandline.operators.pool import Pool
from strandline.plans import pipelines, review, trim
from strandline.sources import download, media, models, state, tools

# -- jobs ------------------------------------------------------------------------------------------


def _engine(spark, root, **config):
    e = jobs.Engine(Config(**config), store=state.JobStore(spark, str(root)))
    e.register(jobs.Kind("double", lambda p, pre, tell: p["n"] * 2, estimate=lambda p, pre: 1.0))
    e.register(jobs.Kind("bad", lambda p, pre, tell: 1 / 0))
    return e


def test_jobs_outlive_their_process(spark, tmp_path):
    first = _engine(spark, tmp_path)
    done, bad = first.submit("double", {"n": 4}), first.submit("bad", {}, inline=True)
    other = _engine(spark, tmp_path)
    assert other.result(done.id) == 8 and other.get(bad.id).error.code == "INTERNAL" and {j.id for j in other.list()} == {done.id, bad.id}
    assert other.cancel(done.id).status == "completed"
    rows = {r.id: r for r in other.store.jobs().collect()}
    assert rows[done.id].status == "completed" and rows[done.id].fraction == 1.0 and json.loads(rows[done.id].params) == {"n": 4} and rows[bad.id].error_code == "INTERNAL"
    assert sorted((r.job_id, r.event) for r in other.store.events().collect()) == sorted([(done.id, "start"), (done.id, "end"), (bad.id, "start"), (bad.id, "error")])
    other.remove(done.id)
    assert _engine(spark, tmp_path).store.ids() == [bad.id]
    with pytest.raises(EngineError):
        other.get("no id")


def _record(job_id, status, beat):
    return jobs.Job(job_id, "double", {"n": 1}, status, created_at=beat, heartbeat_at=beat).record()


def test_records_of_other_processes(spark, tmp_path):
    store, now = state.JobStore(spark, str(tmp_path)), datetime.now(timezone.utc)
    store.save(_record("j_00000000000a", "running", now - timedelta(minutes=2)))
    store.save(_record("j_00000000000b", "running", now))
    store.save(_record("j_00000000000c", "queued", now))
    e = _engine(spark, tmp_path)
    assert e.get("j_00000000000a").status == "interrupted" and e.get("j_00000000000a").error.code == "INTERRUPTED" and store.load("j_00000000000a")["status"] == "interrupted"
    assert e.get("j_00000000000b").status == "running" and e.cancel("j_00000000000c").status == "cancelled"
    with pytest.raises(EngineError, match="another process"):
        e.cancel("j_00000000000b")
    store.save(_record("j_00000000000b", "running", now - timedelta(minutes=2)))
    assert {j.id: j.status for j in e.list()} == {"j_00000000000a": "interrupted", "j_00000000000b": "interrupted", "j_00000000000c": "cancelled"}


def test_heartbeats_need_no_progress(spark, tmp_path):
    e = _engine(spark, tmp_path, heartbeat_ms=50, debug_memory=True)
    e.register(jobs.Kind("quiet", lambda p, pre, tell: time.sleep(1.0)))
    j = e.submit("quiet", {}, inline=False)
    beats = set()
    while e.get(j.id).status != "completed":
        beats.add(e.store.load(j.id)["heartbeat_at"])
        time.sleep(0.05)
    assert len(beats) > 3
    assert all(json.loads(r.data)["memory_mb"] > 10 for r in e.store.events().collect())


def test_five_kinds_are_registered():
    e = jobs.Engine()
    pipelines.register(e, {k: (lambda p, pre, tell, k=k: k) for k in pipelines.KINDS}, lambda p: {"duration_sec": 100.0})
    assert sorted(e.kinds) == sorted(pipelines.KINDS) and e.kinds["review"].resource({}) == "ocr" and e.kinds["review"].resource({"checks": ["aspect"]}) == "light" and e.kinds["diarize"].resource == "asr"
    assert e.estimate("transcribe", {}) == 68.0 and e.estimate("transcribe", {"model": "fast", "from_sec": 90}) == 10.0 and e.estimate("review", {"checks": ["aspect"]}) == 10.0
    assert e.estimate("keyframes", {"max_frames": 10}) == 13.0 and e.estimate("read_screen", {}) == pytest.approx(14 + 100 / 6 * 3.2) and e.estimate("diarize", {"to_sec": 50}) == 16.0
    assert e.submit("review", {"checks": ["aspect"], "to_sec": 10}, inline=True).result == "review"
    with pytest.raises(EngineError):
        pipelines.register(e, {}, lambda p: {})


# -- composite calls -------------------------------------------------------------------------------


def _ext(spark, **more):
    ext = media.Externals()
    quiet, loud = [0.0] * 512, [0.5, -0.5] * 256
    pattern = {"a": [quiet] * 20 + [loud] * 60 + [quiet] * 40, "b": [quiet] * 100, "short": [loud] * 3}

    def decode(rows):
        return spark.createDataFrame([(r.media_id, n, c) for r in rows.collect() for n, c in enumerate(pattern[r.media_id])], schemas.PCM)

    def heard(pcm, windows):
        return windows.select("media_id", "window_no", F.lit(-5.0).alias("start_sec"), (F.col("end_sec") + 1).alias("end_sec"), F.lit(" we use kubeflo every day here ").alias("text"))

    ext.plug("decode", decode)
    ext.plug("transcribe_window", heard)
    ext.plug("embed_text", lambda t: t.select("doc_id", F.array(F.length("text").cast("float"), F.when(F.col("text").startswith("passage: "), 1.0).otherwise(0.0).cast("float")).alias("embedding")))
    for name, run in more.items():
        ext.plug(name, run)
    return ext


def test_transcribe(spark, tmp_path):
    found = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("short", "/s")], "media_id string, path string")
    ext, phrases = _ext(spark), filters.blocklist(spark)
    made = pipelines.transcribe(found, ext, phrases, terms=["Kubeflow"])
    assert made.speech.engine == "energy" and "nothing is plugged in" in made.speech.fallback
    rows = made.segments.collect()
    assert [r.media_id for r in rows] == ["a"] and rows[0].text == "we use Kubeflow every day here" and rows[0].replacements == 1
    region = made.speech.regions.where("media_id = 'a'").first()
    assert 0.4 < region.start_sec < 0.7 and rows[0].start_sec == round(region.start_sec, 2) and rows[0].end_sec == round(region.end_sec, 2)
    assert sorted(r.media_id for r in made.empty.collect()) == ["b", "short"]
    made.write(str(tmp_path / "out"))
    assert "Kubeflow" in spark.read.text(str(tmp_path / "out/srt")).agg(F.array_join(F.collect_list("value"), " ")).first()[0]
    docs = pipelines.index(made, ext).collect()
    assert docs[0].doc_id == "a:s1" and sum(x * x for x in docs[0].embedding) == pytest.approx(1.0)
    again = pipelines.transcribe(found.where("media_id = 'a'"), ext, phrases, cached=made.segments)
    assert [r.text for r in again.segments.collect()] == ["we use Kubeflow every day here"]
    for name, said in (("short", "half a second"), ("b", "no speech")):
        with pytest.raises(EngineError, match=said) as e:
            pipelines.transcribe(found.where(F.col("media_id") == name), ext, phrases)
        assert e.value.code == "PIPELINE_EMPTY_OUTPUT"
    ext.plug("transcribe_window", lambda pcm, w: w.select("media_id", "window_no", "start_sec", "end_sec", F.lit("Thanks for watching!").alias("text")))
    with pytest.raises(EngineError, match="filtered out"):
        pipelines.transcribe(found.where("media_id = 'a'"), ext, phrases)


def test_probe(spark):
    ext = media.Externals()
    ext.plug("probe", lambda rows: rows.select("media_id", F.lit('{"format":{"duration":"5"},"streams":[{"codec_type":"audio","channels":1}]}').alias("probe")))
    got = {r.media_id: r for r in pipelines.probe(spark.createDataFrame([("x", "/tmp/a.mp3"), ("y", "http://127.0.0.1/b")], "media_id string, input string"), ext).collect()}
    assert got["x"].info.kind == "audio" and got["x"].info.duration_sec == 5.0 and not got["x"].refused and got["y"].refused and got["y"].info is None


def test_diarize(spark):
    local = [("m", i, i * 4.0, i * 4.0 + 3.5, i % 2, 0.9) for i in range(8)]
    voice = {0: [1.0, 0.0], 1: [0.0, 1.0]}
    ext = media.Externals()
    ext.plug("decode", lambda rows: spark.createDataFrame([], schemas.PCM))
    ext.plug("segment_speakers", lambda pcm: spark.createDataFrame(local, media.EXTERNAL["segment_speakers"]))
    ext.plug("speaker_embeddings", lambda t: spark.createDataFrame([(r.media_id, int(r.turn_no), voice[r.local]) for r in t.collect()], media.EXTERNAL["speaker_embeddings"]))
    segs = spark.createDataFrame([("m", 1, 0.0, 3.0, "a"), ("m", 2, 4.5, 7.0, "b")], "media_id string, seg_id int, start_sec double, end_sec double, text string")
    turns, speakers, told = pipelines.diarize(spark.createDataFrame([("m", "/m")], "media_id string, path string"), ext, segs)
    assert turns.count() == 8 and pipelines.speaker_counts(turns).first().speakers == 2 and speakers.count() == 2
    names = {r.seg_id: r.speaker for r in told.collect()}
    assert names[1] != names[2] and None not in names.values()
    tracks = spark.createDataFrame([("m", "Ann", 0.0, 2.0)], "media_id string, participant string, start_sec double, end_sec double")
    assert pipelines.diarize(None, ext, tracks=tracks)[0].first().speaker == "Ann"
    with pytest.raises(EngineError, match="nobody"):
        pipelines.diarize(None, ext, tracks=tracks.limit(0))


KEY = "AKIA" + "Q2ERT5UIOPA7DFGH"


def _screens(spark):
    ext = media.Externals()
    pixels = lambda i: [(x * (3 if i % 2 else -3)) % 256 for x in range(72)]
    ext.plug("thumbnails", lambda rows: spark.createDataFrame([(r.media_id, i, float(i), pixels(i // 10)) for r in rows.collect() for i in range(40)], media.EXTERNAL["thumbnails"]))
    ext.plug("scene_scores", lambda rows: spark.createDataFrame([(r.media_id, 10.0, 0.9) for r in rows.collect()], media.EXTERNAL["scene_scores"]))
    ext.plug("ocr", lambda rows: rows.select("media_id", "frame_idx", F.lit(0).alias("tile"), F.concat(F.lit(f"key {KEY} at "), F.col("pts").cast("string")).alias("text"), F.lit(90).alias("confidence"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h")).alias("bbox")))
    ext.plug("loudness", lambda rows: rows.select("media_id", F.lit(-20.0).alias("integrated_lufs"), F.lit(0.0).alias("true_peak_dbtp"), F.lit(5.0).alias("loudness_range"), F.lit(-30.0).alias("threshold")))
    ext.plug("silence_log", lambda rows: rows.select("media_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("silence_start: 3").alias("l")), F.struct(F.lit(2).alias("n"), F.lit("silence_end: 9.5 | silence_duration: 6.5").alias("l")))).alias("x")).select("media_id", F.col("x.n").alias("line_no"), F.col("x.l").alias("line")))
    return ext


def test_read_screen_and_review(spark):
    ext = _screens(spark)
    found = spark.createDataFrame([("v", "/v", "video", 40.0, 1920, 1080, True), ("i", "/i", "image", 0.0, 1000, 1000, False), ("s", "/s", "audio", 9.0, None, None, True)], "media_id string, path string, kind string, to_sec double, width int, height int, has_audio boolean")
    clean, secrets, figures = pipelines.read_screen(found.where("kind <> 'audio'"), ext)
    texts = [r.text for r in clean.collect()]
    assert texts and all(KEY not in t and "AKIA…FGH" in t for t in texts) and {r.media_id: r.frames for r in figures.collect()}["i"] == 1
    assert {(r.media_id, r.kind, r.masked) for r in secrets.collect()} == {("v", "aws_key", "AKIA…FGH"), ("i", "aws_key", "AKIA…FGH")}
    findings, verdicts = pipelines.reviewed(found, ext, "youtube")
    assert {r.media_id: r.verdict for r in verdicts.collect()} == {"v": "block", "i": "block", "s": "warn"}
    titles = {(r.media_id, r.check, r.title) for r in findings.collect()}
    assert {("i", "loudness", "No audio stream, loudness check skipped"), ("s", "secrets", "Audio only, on-screen check skipped"), ("v", "silences", "1 silence gap of 2 s or more, 7 s in all"), ("v", "secrets", "1 probable secret visible on screen"), ("s", "aspect", "No video stream, aspect check skipped")} <= titles
    only, _ = pipelines.reviewed(found, ext, checks=("aspect",))
    assert {r.check for r in only.collect()} == {"aspect"}
    with pytest.raises(EngineError):
        review.review(found, review.preset(spark, None), ("colour",))
    with pytest.raises(EngineError, match="no measurements"):
        review.review(found, review.preset(spark, None), ("loudness",))


def test_secrets_are_listed_up_to_a_number(spark):
    rows = [("m", f"kind{i:03d}", "abcd…xyz", 20, 1, i, float(i), 1, "low" if i % 2 else "high", ["pattern"], None) for i in range(60)]
    found = spark.createDataFrame(rows, "media_id string, kind string, masked string, length int, frames long, frame_idx int, pts double, ord int, confidence string, signals array<string>, context string")
    read = spark.createDataFrame([("m", 60, 240.0, 0)], "media_id string, frames int, window_sec double, pruned int")
    got = {r.severity: r for r in review.secret_findings(read, found).collect()}
    assert got["block"].title == "30 probable secrets visible on screen" and got["block"].detail.count("kind") == 8 and "; and 22 more" in got["block"].detail and got["block"].at_sec == 0.0
    assert got["info"].detail.count("kind") == 5 and "; and 25 more" in got["info"].detail


# -- responses -------------------------------------------------------------------------------------


def test_trimming(spark):
    blocks = [{"text": f"line {i}"} for i in range(40)]
    frames = [("big", i, "x" * 500, [b["text"] for b in blocks]) for i in range(80)] + [("small", 1, "hello", [])]
    got = trim.screen(spark.createDataFrame(frames, "job_id string, index int, text string, blocks array<string>"), 4000).collect()
    big, small = [r for r in got if r.job_id == "big"], [r for r in got if r.job_id == "small"]
    assert len(big) == 80 and all(r.blocks is None and len(r.text) == 181 and "strand://jobs/big/ocr" in r.note for r in big) and (small[0].blocks, small[0].note) == ([], None)
    keys = trim.key_frames(spark.createDataFrame([("j", i, "ab" * 200) for i in range(120)], "job_id string, index int, dhash string"), 4000).collect()
    assert len(keys) == 120 and all(r.dhash is None and r.note for r in keys)
    segs = [("long", i, "word " * 30) for i in range(500)] + [("one", 0, "word " * 30_000), ("one", 1, "x"), ("few", 0, "x"), ("few", 1, "y")]
    kept = trim.segments(spark.createDataFrame(segs, "job_id string, seg_id int, text string"), 4000).collect()
    n = {j: [r.seg_id for r in sorted(kept, key=lambda r: r.seg_id) if r.job_id == j] for j in ("long", "one", "few")}
    assert 0 < len(n["long"]) < 500 and n["long"] == list(range(len(n["long"]))) and n["one"] == [0] and n["few"] == [0, 1]
    notes = {r.job_id: r.note for r in kept}
    assert notes["few"] is None and notes["one"].startswith("1 of 2 segment(s) omitted") and f"{500 - len(n['long'])} of 500" in notes["long"]


# -- sources ---------------------------------------------------------------------------------------


def _web(pages):
    def opened(address):
        status, headers, body = pages[address]
        return download.Response(status, headers, iter(body))

    return opened


def test_downloads(tmp_path):
    public = lambda host: ["8.8.8.8"] if host != "inside.example" else ["10.0.0.1"]
    pages = {
        "http://a.example/x": (302, {"location": "/y.bin?q"}, []),
        "http://a.example/y.bin?q": (200, {"content-type": "video/MP4"}, [b"ab", b"cd"]),
        "http://a.example/loop": (301, {"location": "http://a.example/loop"}, []),
        "http://a.example/in": (302, {"location": "http://inside.example/"}, []),
        "http://a.example/file": (302, {"location": "file:///etc/passwd"}, []),
        "http://a.example/big": (200, {"content-length": "11"}, [b"x"]),
        "http://a.example/flood.gif": (200, {}, [b"x" * 6, b"x" * 6]),
        "http://a.example/gone": (404, {}, []),
        "http://a.example/raw": (200, {}, [b"z"]),
    }
    get = lambda a, **more: download.download(a, str(tmp_path), _web(pages), public, 10, **more)
    path = get("http://a.example/x")
    assert path.endswith("media.mp4") and open(path, "rb").read() == b"abcd"
    pages["http://a.example/x"] = (500, {}, [])
    assert get("http://a.example/x") == path and get("http://a.example/raw").endswith("media.bin")
    for address, code in (("loop", "DOWNLOAD_FAILED"), ("in", "SOURCE_BLOCKED"), ("file", "DOWNLOAD_FAILED"), ("big", "SOURCE_TOO_LARGE"), ("flood.gif", "SOURCE_TOO_LARGE"), ("gone", "DOWNLOAD_FAILED")):
        with pytest.raises(EngineError) as e:
            get(f"http://a.example/{address}")
        assert e.value.code == code
    for address in ("http://localhost/x", "http://127.0.0.1/", "http://printer.local/", "http://[::1]/"):
        with pytest.raises(EngineError):
            get(address)
    left = [n for _, _, names in os.walk(tmp_path) for n in names]
    assert sorted(left) == ["media.bin", "media.mp4"]


def test_tools(tmp_path):
    assert tools.find_tool("sh").endswith("sh") and tools.find_tool("none-such", setting="/x/y") == "/x/y" and tools.find_tool("none-such", bundled=__file__) == __file__
    with pytest.raises(EngineError) as e:
        tools.find_tool("none-such")
    assert e.value.code == "TOOL_MISSING"
    run = lambda code, **more: tools.run_tool(sys.executable, ["-c", code], **more)
    heard = []
    out = run("import sys; sys.stdout.write('x' * 300000); sys.stderr.write('e' * 100000)", told=heard.append)
    assert out.stdout == b"x" * 300_000 and len(out.stderr) == tools.TAIL and sum(map(len, heard)) == 100_000
    stop = threading.Event()
    threading.Timer(0.2, stop.set).start()
    for more, code in (({"timeout": 0.2}, "TIMEOUT"), ({"stop": stop}, "CANCELLED")):
        with pytest.raises(EngineError) as e:
            run("import time; time.sleep(30)", **more)
        assert e.value.code == code
    with pytest.raises(EngineError, match="code 3: oh"):
        run("import sys; sys.stderr.write('oh'); sys.exit(3)")
    with pytest.raises(EngineError, match="could not start"):
        tools.run_tool(str(tmp_path / "none"), [])


def test_models(spark, tmp_path):
    rows = models.catalogue(spark).collect()
    assert len(rows) == 6 and {r.role for r in rows} == {"asr", "vad", "segmentation", "speaker", "embedding"}
    path = models.cached_path(str(tmp_path), "https://hub.example/org/model/resolve/main/onnx/../model.onnx")
    assert path == str(tmp_path / "org/model/onnx/model.onnx") and models.cached_path("/r", "https://h.co/a/../b/./c.onnx") == "/r/h.co/a/b/c.onnx"
    calls = []
    fetch = lambda a: iter(calls.append(a) or [b"12", b"3"])
    with pytest.raises(EngineError) as e:
        models.ensure_file("https://x", path, fetch, offline=True)
    assert e.value.code == "OFFLINE" and not models.is_cached(str(tmp_path), "org/model")
    assert open(models.ensure_file("https://x", path, fetch), "rb").read() == b"123" and models.is_cached(str(tmp_path), "org/model")
    assert models.ensure_file("https://x", path, fetch, offline=True) == path and calls == ["https://x"]
    with pytest.raises(EngineError):
        models.ensure_file("https://y", path + "2", lambda a: iter(()))
    assert os.listdir(os.path.dirname(path)) == ["model.onnx"]


def test_pool():
    made, closed = [], []
    p = Pool(2, lambda: made.append(len(made)) or len(made), closed.append)
    a, b = p.acquire(), p.acquire()
    stop = threading.Event()
    threading.Timer(0.1, stop.set).start()
    with pytest.raises(EngineError, match="cancelled"):
        p.acquire(stop)
    threading.Timer(0.1, lambda: p.release(a)).start()
    assert p.acquire() == a and len(made) == 2
    p.release(a)
    p.release(b)
    with p.worker() as w:
        assert w in (a, b)
    p.terminate()
    assert sorted(closed) == [a, b] and p.made == 0
    tries = []

    def broken():
        tries.append(1)
        time.sleep(0.1)
        raise OSError("no data")

    bad = Pool(1, broken)
    errors = []

    def ask():
        try:
            bad.acquire()
        except OSError as e:
            errors.append(str(e))

    asking = [threading.Thread(target=ask) for _ in range(3)]
    for t in asking:
        t.start()
    for t in asking:
        t.join(5)
    assert errors == ["no data"] * 3 and bad.made == 0


# -- words -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("near", [1, 2, 64])
def test_alignment_in_two_rows_is_that_of_the_whole_table(monkeypatch, near):
    monkeypatch.setattr(rates, "NEAR", near)
    rng = random.Random(near)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        i, j, s, d, n = len(a), len(b), 0, 0, 0
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                d, i = d + 1, i - 1
            else:
                n, j = n + 1, j - 1
        assert rates.alignment(a, b) == (s, d, n)


def test_distance_matches_the_built_in(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randrange(n)))
    pairs = [(text(12), text(12)) for _ in range(150)] + [((t := text(300)), t[:100] + text(5) + t[110:]) for _ in range(20)]
    want = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b")).collect()]
    for near in (1, 4, 64):
        monkeypatch.setattr(rates, "NEAR", near)
        assert [rates.distance(a, b) for a, b in pairs] == want


def test_error_rates_of_long_texts(spark):
    said = " ".join(f"word{i}" for i in range(20_000))
    got = rates.error_rates(spark.createDataFrame([(said, said + " more"), (None, "x"), ("Só, [noise] isto!", "so isto")], "reference string, hypothesis string")).collect()
    assert {r.hypothesis[-8:]: (r.substitutions, r.deletions, r.insertions, r.char_errors, r.reference_words) for r in got} == {"999 more": (0, 0, 1, 4, 20_000), "x": (0, 0, 1, 1, 0), "so isto": (0, 0, 0, 0, 2)}


def test_compatibility_forms_are_those_of_the_phrase_list(spark):
    from strandline.functions import text as txt

    texts = ["Ｔｈａｎｋ　ｙｏｕ", "ﬁne ½ … №5 été ™", "ça été “q”", "x² ① ｱ", "plain, text!", None, "été Ångström"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(txt.plain(F.col("t")).alias("p")).collect()]
    assert got == [None if t is None else filters.normalised(t) for t in texts]


def test_files_are_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.mp4", b"one"), ("b.txt", b"two"), ("in/c.mp4", b"one")):
        (tmp_path / name).write_bytes(body)
    rows = {os.path.basename(r.path): r for r in media.scan_files(spark, str(tmp_path), "*.mp4").collect()}
    assert set(rows) == {"a.mp4", "c.mp4"} and rows["a.mp4"].identity == rows["c.mp4"].identity and rows["a.mp4"].length == 3


def test_scope_of_a_search():
    from strandline.operators import search

    assert search.scope(["a", "b"]) == (["a", "b"], None) and search.scope(["a", "b"], job_id="b") == (["b"], ["b"])
    assert search.scope(["a"], "all", "a") == (["a"], None) and search.scope(["a"], "job") == ([], None)


def test_manifest(spark):
    from strandline.plans import keyframes

    rows = [("m", i, i / 2, ["hash"], i, 6) for i in range(1, 12)]
    got = keyframes.manifest(spark.createDataFrame(rows, "media_id string, index int, pts double, sources array<string>, dhash long, distance int")).first()
    frames = json.loads(got.json)
    assert [f["index"] for f in frames] == list(range(1, 12)) and frames[9]["file"] == "frames/010.jpg" and frames[9]["sheet_file"] == "sheets/02.jpg"
