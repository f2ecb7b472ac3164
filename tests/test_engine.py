"""The job engine, sources, sinks, state and streaming."""

import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strandline import config, errors, schemas, streaming
from strandline.operators import folds, jobs, search
from strandline.plans import review
from strandline.sources import media, sinks, state


def engine(**more):
    e = jobs.Engine()
    e.register(jobs.Kind("double", lambda p, pre, tell: p["n"] * 2, estimate=lambda p, pre: 1.0))
    e.register(jobs.Kind("slow", lambda p, pre, tell: p["n"], estimate=lambda p, pre: 100.0, **more))
    return e


def test_short_jobs_run_at_once():
    e = engine()
    j = e.submit("double", {"n": 21})
    assert j.status == "completed" and e.result(j.id) == 42 and e.estimate("slow", {}) == 100.0
    assert jobs.Engine(config.Config(inline_seconds=0)).config.inline_seconds == 0
    with pytest.raises(errors.EngineError, match="unknown job kind"):
        e.submit("none", {})


def test_long_jobs_run_behind():
    e = engine()
    j = e.submit("slow", {"n": 5})
    assert e.wait(j.id, 5).status == "completed" and e.result(j.id) == 5
    assert [x["event"] for x in e.events] == ["start", "end"]


def test_one_job_of_a_class_at_a_time():
    running, peak, lock = [0], [0], threading.Lock()

    def run(p, pre, tell):
        with lock:
            running[0] += 1
            peak[0] = max(peak[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1

    e = jobs.Engine()
    e.register(jobs.Kind("asr", run, resource="asr"))
    for j in [e.submit("asr", {}) for _ in range(4)]:
        e.wait(j.id, 5)
    assert peak[0] == 1


def test_failures_and_cancelling():
    e = jobs.Engine()
    e.register(jobs.Kind("bad", lambda p, pre, tell: 1 / 0))
    e.register(jobs.Kind("unready", lambda p, pre, tell: 1, prepare=lambda p: 1 / 0))

    def loop(p, pre, tell):
        for i in range(1000):
            time.sleep(0.01)
            tell("work", i / 1000)

    e.register(jobs.Kind("loop", loop))
    assert e.wait(e.submit("bad", {}).id, 5).error.code == "INTERNAL"
    assert e.submit("unready", {}).status == "failed"
    j = e.submit("loop", {})
    time.sleep(0.05)
    e.cancel(j.id)
    assert e.wait(j.id, 5).status == "cancelled" and e.cancel(j.id).status == "cancelled"
    with pytest.raises(errors.EngineError):
        e.result(j.id)
    with pytest.raises(errors.EngineError):
        e.get("j_000000000000")
    e.remove(j.id)
    assert j.id not in [x.id for x in e.list()]


def test_settings_are_read_strictly(monkeypatch):
    monkeypatch.setenv("STRANDLINE_MAX_FRAMES", "12")
    monkeypatch.setenv("STRANDLINE_OFFLINE", "yes")
    c = config.Config.from_env()
    assert c.max_frames == 12 and c.offline is True
    monkeypatch.setenv("STRANDLINE_MAX_FRAMES", "1.5")
    with pytest.raises(errors.EngineError):
        config.Config.from_env()


def test_sources(spark):
    rows = [("data:text/plain,x", "data"), ("https://www.youtube.com/watch?v=1", "site"), ("https://youtube.com/a.mp4", "url"), ("http://example.com/x", "url"), ("file:///tmp/a%20b.mp4", "local"), ("/tmp/x.mp4", "local"), ("s3://b/x", "unsupported")]
    df = spark.createDataFrame(rows, "input string, want string")
    got = media.resolve(df).collect()
    assert all(r.origin == r.want for r in got) and [r.path for r in got if r.input.startswith("file")] == ["/tmp/a b.mp4"]
    hosts = spark.createDataFrame([(u,) for u in ("http://localhost/x", "http://a.internal/", "http://127.0.0.1:8/", "http://8.8.8.8/", "http://example.com/")], "u string")
    assert [r[0] for r in hosts.select(media.refused(F.col("u"))).collect()] == [True, True, True, False, False]
    args = spark.createDataFrame([(["--format", "best", "--exec", "rm", "--quiet", "x"],)], "a array<string>")
    assert args.select(media.allowed_args(F.col("a"), ["--quiet"], ["--format"]).alias("a")).first().a == ["--format", "best", "--quiet"]
    uri = spark.createDataFrame([("data:image/png;base64,AAEC",), ("data:,a%20b+c",), ("nope",)], "u string").select(media.data_uri(F.col("u")).alias("d")).collect()
    assert bytes(uri[0].d.content) == b"\x00\x01\x02" and bytes(uri[1].d.content) == b"a b+c" and uri[2].d is None
    paths = spark.createDataFrame([("https://h.co/a/../b/./c.onnx",)], "u string").select(media.model_path(F.col("u")).alias("p")).first().p
    assert paths == "h.co/a/b/c.onnx"


def test_externals_check_their_schema(spark):
    ext = media.Externals()
    with pytest.raises(errors.EngineError, match="nothing is plugged in"):
        ext.call("ocr")
    ext.plug("scene_scores", lambda: spark.createDataFrame([("m", 1.0, 0.5)], "media_id string, pts double, score double"))
    assert ext.call("scene_scores").count() == 1
    ext.plug("loudness", lambda: spark.range(1))
    with pytest.raises(errors.EngineError, match="other columns"):
        ext.call("loudness")
    log = 'x\n{\n"input_i" : "-20.5",\n"input_tp" : "-1.2",\n"input_lra" : "3.0",\n"input_thresh" : "-30.1"\n}\n'
    r = spark.createDataFrame([(log,), ("none",)], "l string").select(media.loudness_of_log(F.col("l")).alias("x")).collect()
    assert r[0].x.integrated_lufs == -20.5 and r[1].x is None


def test_state(spark, tmp_path):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = spark.createDataFrame([("j_1", t, "asr", "start", None, None, None)], schemas.JOB_EVENTS)
    state.append_events(events, str(tmp_path / "e"))
    state.append_events(events, str(tmp_path / "e"))
    assert state.read_events(spark, str(tmp_path / "e")).count() == 2
    cached = spark.createDataFrame([("a", ["/x/1", "/x/2"]), ("b", ["/x/1"])], "key string, artifacts array<string>")
    files = spark.createDataFrame([("/x/1",)], "path string")
    assert [r.key for r in state.usable(cached, files).collect()] == ["b"]
    assert state.adopted(cached, "j", "/r").first().artifacts[0] == "/r/j/artifacts/1"
    docs = spark.createDataFrame([("j1:s1", "j1", "speech", "hello there", 0.0, 1.0, None, "a", 0, 0, [1.0, 0.0]), ("j2:s1", "j2", "screen", "other words", 0.0, 1.0, None, "b", 1, 0, [0.0, 1.0])], schemas.DOCS)
    search.write_index(docs, str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    jobs_seen = spark.createDataFrame([("j1",), ("j3",)], "job_id string")
    assert [r.job_id for r in search.not_indexed(jobs_seen, index).collect()] == ["j3"]
    hits = search.search(index, "hello", [0.0, 1.0], k=5).collect()
    assert {h.doc_id: h.bm25_rank for h in hits} == {"j1:s1": 1, "j2:s1": None}
    assert search.search(index, "hello", [0.0, 1.0], kind="screen").first().doc_id == "j2:s1"
    with pytest.raises(ValueError):
        search.search(index, "h", [0.0, 1.0])


def test_fused_top_shows_a_passage_once(spark):
    rows = [(i, "s", 0.0, f"t{i // 3}", float(i % 5), float(-i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_ord long, source string, start_sec double, text string, bm25 double, vector double")
    rb = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[4], r[0])))}
    rv = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[5], r[0])))}
    fused = sorted(((round((1 / (60 + rb[r[0]]) if r[4] > 0 else 0) + 1 / (60 + rv[r[0]]), 5), r) for r in rows), key=lambda x: (-x[0], x[1][0]))
    want, seen = [], set()
    for s, r in fused:
        if r[3] not in seen:
            seen.add(r[3])
            want.append((r[0], s))
    assert [(r.doc_ord, r.score) for r in search.fused_top(df, 9, "doc_ord").collect()] == want[:9]


def test_review_texts(spark):
    info = spark.createDataFrame([("a", 1890, 1080, "video"), ("b", None, None, "audio")], "media_id string, width int, height int, kind string")
    rows = {r.media_id: r for r in review.aspect_findings(info, review.preset(spark, "youtube")).collect()}
    assert rows["a"].severity == "warn" and "7:4" in rows["a"].title and "pillarbox" in rows["a"].detail and rows["b"].severity == "info"
    found = review.ordered(review.aspect_findings(info, review.preset(spark, "podcast")))
    assert {r.media_id: r.verdict for r in review.verdict(found).collect()} == {"a": "ok", "b": "info"}
    assert "✅" in sinks.report(found).where("media_id = 'a'").first().md


def _stream(spark, df, path, make):
    df.write.json(str(path))
    out = make(spark.readStream.schema(df.schema).json(str(path)))
    q = out.writeStream.format("memory").queryName("out_" + path.name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table("out_" + path.name)


def test_streaming_dedup_agrees_with_batch(spark, tmp_path):
    rows = [(f"m{i % 3}", i // 3, float(i // 3), (i * 2654435761 >> 7) & 4095) for i in range(150)]
    df = spark.createDataFrame(rows, "media_id string, idx int, pts double, dhash bigint")
    got = _stream(spark, df, tmp_path / "dedup", lambda s: streaming.dedup_hashes(s, 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.dedup_hashes(df, 6).collect()))


def test_streaming_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t + timedelta(minutes=m), 1.0) for m in (0, 10, 50, 200, 900)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value double")
    got = _stream(spark, df, tmp_path / "sessions", lambda s: streaming.sessions(s))
    batch = streaming.sessions(df)
    done = {(r.start, r.n_events) for r in got.collect()}
    assert done and done <= {(r.start, r.n_events) for r in batch.collect()}


def test_streaming_heartbeats(spark, tmp_path):
    """Event time passes by the beats of another job; the quiet one is reported once."""
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    folder = tmp_path / "beats"
    schema = "job_id string, ts timestamp"
    for n, rows in enumerate([[("a", t), ("b", t)], [("b", t + timedelta(seconds=100))], [("b", t + timedelta(seconds=110))], [("b", t + timedelta(seconds=120))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        if n == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
            q = streaming.interrupted(stream, 30_000).writeStream.format("memory").queryName("out_beats").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    got = spark.table("out_beats").collect()
    assert [(r.job_id, r.last_ms) for r in got if r.job_id == "a"] == [("a", int(t.timestamp() * 1000))]
