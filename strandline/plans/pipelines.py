"""The composite calls: each chains the external operators that are plugged in with the engine's own.

They take tables of media, so one call covers any number.  A result that is empty as a whole is an error;
media that gave nothing among others that did are listed by ``without``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.errors import EngineError
from strandline.functions import media as facts
from strandline.functions import vision
from strandline.operators import filters, folds, intervals, jobs, search
from strandline.plans import diarize as speaking
from strandline.plans import keyframes, review, screen, transcript
from strandline.sources import media as src
from strandline.sources import sinks

RATE, FRAME = 16_000, 512
#: Samples under which audio is too short: half a second.
SHORTEST = RATE // 2


def require(rows: DataFrame, message: str, hint: str | None = None) -> DataFrame:
    """The rows; an error if there are none."""
    if rows.isEmpty():
        raise EngineError("PIPELINE_EMPTY_OUTPUT", message, hint)
    return rows


def without(media: DataFrame, made: DataFrame, message: str) -> DataFrame:
    """Media that nothing came of: media_id, error_code, message."""
    gone = media.select("media_id").distinct().join(made.select("media_id"), "media_id", "left_anti")
    return gone.select("media_id", F.lit("PIPELINE_EMPTY_OUTPUT").alias("error_code"), F.lit(message).alias("message"))


def limits(inputs: DataFrame, max_seconds: float, max_bytes: int) -> DataFrame:
    """Resolved inputs (refused, duration_sec, length) with ``error_code``: what keeps each from being read, whatever its origin."""
    code = F.when(F.col("refused"), "SOURCE_BLOCKED").when(F.col("origin") == "unsupported", "SOURCE_UNSUPPORTED").when(src.too_large(F.col("length"), max_bytes), "SOURCE_TOO_LARGE").when(F.col("duration_sec") > max_seconds, "SOURCE_TOO_LONG")
    return inputs.withColumn("error_code", code)


def probe(inputs: DataFrame, ext: src.Externals) -> DataFrame:
    """What media are: origin, path and refusal of each input, and the facts of those that may be read."""
    seen = src.resolve(inputs)
    read = src.probed(ext.call("probe", seen.where(~F.col("refused")).select("media_id", "path"))).select("media_id", "info")
    return seen.join(read, "media_id", "left")


# -- speech ----------------------------------------------------------------------------------------


def levels(pcm: DataFrame) -> DataFrame:
    """Loudness (root mean square) of each frame of samples; chunks hold whole frames."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("samples") / FRAME).cast("int") - 1)), lambda i: F.slice("samples", i * FRAME + 1, F.lit(FRAME)))
    rms = lambda f: F.sqrt(F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) / F.greatest(F.lit(1), F.size(f)))
    rows = pcm.where(F.size("samples") >= FRAME).select("media_id", "chunk_no", F.posexplode(cut).alias("at", "frame"))
    idx = F.row_number().over(Window.partitionBy("media_id").orderBy("chunk_no", "at")) - 1
    return rows.select("media_id", idx.alias("idx"), rms(F.col("frame")).alias("rms"))


@dataclass
class Speech:
    regions: DataFrame
    engine: str
    fallback: str | None = None


def detect_speech(pcm: DataFrame, ext: src.Externals, threshold: float = 0.5) -> Speech:
    """Speech regions by the plugged model, or by loudness when there is none, with the reason."""
    try:
        probabilities, engine, reason = ext.call("speech_probabilities", pcm), "model", None
    except EngineError as e:
        probabilities, engine, reason = folds.energy_probabilities(levels(pcm)), "energy", e.message
    return Speech(folds.speech_regions(probabilities, FRAME / RATE, threshold), engine, reason)


@dataclass
class Transcript:
    segments: DataFrame
    languages: DataFrame
    stats: DataFrame
    speech: Speech
    empty: DataFrame

    def write(self, root: str) -> None:
        """Text, subtitles and JSON, a folder per medium."""
        sinks.write_text(sinks.transcript_text(self.segments), "txt", f"{root}/txt")
        sinks.write_text(sinks.subtitles(self.segments), "srt", f"{root}/srt")
        sinks.write_json(self.segments, f"{root}/json")


def transcribe(media: DataFrame, ext: src.Externals, phrases: DataFrame, terms: list[str] | None = None, threshold: float = 0.5, cached: DataFrame | None = None, language: str | None = None) -> Transcript:
    """media: media_id, path, and what the decoder wants -> finished segments, language and figures of each.

    ``cached`` holds finished segments of media that need not be recognised again.
    """
    new = media if cached is None else media.join(cached.select("media_id").distinct(), "media_id", "left_anti")
    pcm = ext.call("decode", new)
    enough = pcm.groupBy("media_id").agg(F.sum(F.size("samples")).alias("n")).where(F.col("n") >= SHORTEST)
    if cached is None:
        require(enough, "the decoded audio is shorter than half a second", "look at the window, or whether there is an audio stream")
    speech = detect_speech(pcm.join(enough.select("media_id"), "media_id", "left_semi"), ext, threshold)
    windows = transcript.plan_windows(speech.regions).withColumn("window_no", F.row_number().over(Window.partitionBy("media_id").orderBy("start_sec", "region_id", "piece")).cast("int"))
    if cached is None:
        require(windows, "no speech was found", "the audio may be music or silent; a lower threshold finds fainter speech")
    heard = ext.call("transcribe_window", pcm, windows)
    inside = heard.join(windows.select("media_id", "window_no", F.col("start_sec").alias("__s"), F.col("end_sec").alias("__e")), ["media_id", "window_no"])
    clamp = lambda c: F.least(F.greatest(F.col(c), F.col("__s")), F.col("__e"))
    order = Window.partitionBy("media_id").orderBy("window_no", "start_sec", "end_sec", "text")
    chunks = filters.drop_empty(inside.withColumns({"start_sec": clamp("start_sec"), "end_sec": clamp("end_sec")})).withColumn("seg_id", F.row_number().over(order)).select("media_id", "seg_id", "start_sec", "end_sec", "text", F.lit(None).cast("string").alias("speaker"))
    made = transcript.finish_segments(chunks, speech.regions, phrases, terms)
    figures = transcript.stats(chunks, made)
    if cached is not None:
        made = made.unionByName(cached, allowMissingColumns=True)
    else:
        require(made, "all that was heard was filtered out", "very short or noisy audio; see the flags of the chunks")
    said = transcript.languages(made) if language is None else made.select("media_id", F.lit(language).alias("language")).distinct()
    return Transcript(made, said, figures, speech, without(media, made, "no speech was kept"))


def embed(texts: DataFrame, ext: src.Externals, role: str = "passage") -> DataFrame:
    """(doc_id, text) -> (doc_id, embedding of length 1); the model is told whether it reads queries or passages."""
    if role not in ("query", "passage"):
        raise EngineError("INVALID_ARGUMENT", "a text is a query or a passage")
    found = ext.call("embed_text", texts.withColumn("text", F.concat(F.lit(f"{role}: "), "text")))
    return found.withColumn("embedding", vision.unit(F.transform("embedding", lambda x: x.cast("double"))).cast("array<float>"))


def index(made: Transcript, ext: src.Externals, source: str = "media") -> DataFrame:
    """Search documents of a transcript with their vectors."""
    docs = search.docs_from_segments(made.segments, F.lit(source)).drop("embedding")
    return docs.join(embed(docs.select("doc_id", "text"), ext), "doc_id", "left")


def diarize(media: DataFrame, ext: src.Externals, segments: DataFrame | None = None, tracks: DataFrame | None = None, threshold: float = 0.35, most: int = 8, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Turns, speakers, and transcript segments with their speaker.

    ``tracks``: speech of recordings with a track per person (media_id, participant, start_sec, end_sec),
    whose turns need no model.
    """
    if tracks is not None:
        turns = speaking.track_turns(tracks)
    else:
        local = ext.call("segment_speakers", ext.call("decode", media))
        made = intervals.embeddable(intervals.to_turns(intervals.slabs(local)))
        voices = ext.call("speaker_embeddings", intervals.embedding_crop(made.where("embed")))
        turns = speaking.speaker_turns(local, voices, threshold, most, least)
    require(turns, "nobody was heard speaking")
    told = None if segments is None else segments.drop("speaker").join(intervals.best_speaker(segments, turns), ["media_id", "seg_id"], "left")
    return turns, speaking.speakers(turns), told


# -- pictures --------------------------------------------------------------------------------------


def key_frames(media: DataFrame, ext: src.Externals, **options: object) -> DataFrame:
    """media: media_id, path, to_sec -> key frames; ``options`` are those of ``select_frames``."""
    thumbs = ext.call("thumbnails", media)
    hashes = require(thumbs.select("media_id", "idx", "pts", vision.dhash(F.col("pixels")).alias("dhash")), "no frame could be sampled")
    cuts = src.scene_cuts(ext.call("scene_scores", media))
    return require(keyframes.select_frames(hashes, cuts, media.select("media_id", "to_sec"), **options), "no frame was left to show")


def read_screen(media: DataFrame, ext: src.Externals, frames: DataFrame | None = None, max_frames: int = 80, **options: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Redacted texts of frames, secrets once per medium, and figures.

    media: media_id, path, kind, to_sec.  An image is read as its one frame; of a video the key frames are
    read, chosen here unless given.
    """
    images = media.where("kind = 'image'").select("media_id", F.lit(1).alias("index"), F.lit(0.0).alias("pts"))
    videos = media.where("kind <> 'image'")
    if frames is None:
        frames = images if videos.isEmpty() else key_frames(videos, ext, max_frames=max_frames, **options).select("media_id", "index", "pts").unionByName(images)
    else:
        frames = frames.select("media_id", "index", "pts")
    wanted = frames.withColumn("frame_idx", F.col("index").cast("int"))
    blocks = ext.call("ocr", media.join(wanted, "media_id"))
    texts = wanted.join(screen.frame_texts(blocks.withColumn("block_no", F.row_number().over(Window.partitionBy("media_id", "frame_idx").orderBy("tile", "bbox.y", "bbox.x", "text")))), ["media_id", "frame_idx"], "left")
    shown = require(texts, "no frame was read").withColumns({"text": F.coalesce("text", F.lit("")), "mean_confidence": F.coalesce("mean_confidence", F.lit(0))}).drop("index")
    clean, found = screen.read_screen(shown)
    return clean, found, screen.stats(clean)


def reviewed(media: DataFrame, ext: src.Externals, platform: str | None = None, checks: tuple[str, ...] = review.CHECKS, max_frames_cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """Findings and verdicts of media (media_id, path, kind, width, height, has_audio, to_sec), measured by what the checks need."""
    spark = media.sparkSession
    audible, seen = media.where("has_audio"), media.where("kind in ('video', 'image')")
    loud = ext.call("loudness", audible) if "loudness" in checks else None
    quiet = folds.silences(ext.call("silence_log", audible)).where("duration_sec >= 2") if "silences" in checks else None
    read = secrets = None
    if "secrets" in checks:
        cadence, window = review.CADENCE, F.greatest(F.lit(1.0), F.col("to_sec"))
        needed = seen.select("media_id", window.alias("window_sec"), F.ceil(window / cadence).alias("needed"))
        every = needed.select("media_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("needed"), F.lit(max_frames_cap)))).alias("index"))
        _, secrets, _ = read_screen(seen, ext, every.select("media_id", "index", ((F.col("index") - 1) * cadence).alias("pts")))
        read = needed.select("media_id", "window_sec", F.least(F.col("needed"), F.lit(max_frames_cap)).alias("frames"), F.lit(0).alias("pruned"))
    findings = review.review(media, review.preset(spark, platform), checks, loud, quiet, read, secrets, max_frames_cap)
    return findings, review.verdict(findings)


# -- jobs ------------------------------------------------------------------------------------------

KINDS = ("transcribe", "keyframes", "read_screen", "review", "diarize")


def window_seconds(params: dict, pre: dict | None) -> float:
    total = float((pre or {}).get("duration_sec") or 600)
    to, since = params.get("to_sec"), params.get("from_sec")
    return max(1.0, min(total, (total if to is None else to) - (since or 0)))


def register(engine: jobs.Engine, run: dict[str, Callable], prepare: Callable[[dict], dict], max_frames: int = 500) -> None:
    """The five kinds of jobs with their resource classes and estimates; ``run`` has a function for each."""
    if missing := [k for k in KINDS if k not in run]:
        raise EngineError("INVALID_ARGUMENT", f"nothing runs {missing}")

    def checks(params: dict) -> tuple[str, ...]:
        return tuple(params.get("checks") or review.CHECKS)

    def seconds(task: str) -> Callable[[dict, dict], float]:
        def estimate(params: dict, pre: dict | None) -> float:
            most = params.get("max_frames") or {"keyframes": 120, "read_screen": 80, "review": max_frames}.get(task, 120)
            return facts.estimated(task, window_seconds(params, pre), most, params.get("model") == "fast", "secrets" in checks(params))

        return estimate

    lanes = {"transcribe": "asr", "keyframes": "vision", "read_screen": "ocr", "review": lambda p: "ocr" if "secrets" in checks(p) else "light", "diarize": "asr"}
    for kind in KINDS:
        engine.register(jobs.Kind(kind, run[kind], lanes[kind], seconds(kind), prepare))


def speaker_counts(turns: DataFrame) -> DataFrame:
    """How many speak in each medium."""
    return turns.groupBy("media_id").agg(F.count_distinct("speaker").alias("speakers"))

