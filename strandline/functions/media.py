"""Functions on media facts: aspect, rates, costs, confidence, identities, addresses."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name and value of each known ratio; the first wins a tie.
RATIOS = (("16:9", 16 / 9), ("9:16", 9 / 16), ("4:3", 4 / 3), ("1:1", 1.0), ("4:5", 4 / 5), ("21:9", 21 / 9), ("7:4", 7 / 4))
#: Id, label, target loudness, most true peak, accepted ratios.
PLATFORMS = (
    ("youtube", "YouTube", -14.0, -1.0, ["16:9"]),
    ("youtube-shorts", "YouTube Shorts", -14.0, -1.0, ["9:16"]),
    ("instagram", "Instagram Reels", -14.0, -1.0, ["9:16", "4:5", "1:1"]),
    ("tiktok", "TikTok", -14.0, -1.0, ["9:16"]),
    ("podcast", "Podcast", -16.0, -1.0, []),
    ("linkedin", "LinkedIn", -14.0, -1.0, ["16:9", "1:1", "4:5"]),
)
WIDE = 16 / 9


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p,) for p in PLATFORMS], "id string, label string, target_lufs double, max_true_peak double, aspects array<string>")


def aspect(width: Column, height: Column) -> Column:
    """ratio, decimal, fits (platforms), in16x9 of a picture."""
    decimal = width / height
    known = F.array(*[F.struct(F.abs(F.lit(v) - decimal).alias("off"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(RATIOS)])
    best = F.array_min(known)
    exact = best["off"] < 0.005
    fits = F.array(*[F.struct(F.lit(p[0]).alias("id"), F.array(*map(F.lit, p[4])).cast("array<string>").alias("aspects")) for p in PLATFORMS])
    chosen = F.transform(F.filter(fits, lambda p: F.array_contains(p["aspects"], best["name"])), lambda p: p["id"])
    return F.struct(
        F.when(exact, best["name"]).otherwise(F.concat_ws(":", width.cast("string"), height.cast("string"))).alias("ratio"),
        F.round(decimal, 4).alias("decimal"),
        F.when(exact, chosen).otherwise(F.array().cast("array<string>")).alias("fits"),
        F.when(F.abs(decimal - WIDE) < 0.005, "fits").when(decimal < WIDE, "pillarbox").otherwise("letterbox").alias("in16x9"),
    )


def frame_rate(text: Column) -> Column:
    """``a/b`` to three places; a plain number stays; anything else is 0."""
    a, b = F.try_element_at(F.split(text, "/"), F.lit(1)).try_cast("double"), F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when((a != 0) & (b != 0), F.round(a / b, 3)).when(a != 0, a), F.lit(0.0))


def media_info(probe: Column) -> Column:
    """A probe's JSON (parsed) as the engine's facts: kind, container, duration, sizes, video, audio, aspect."""
    videos = F.filter(probe["streams"], lambda s: (s["codec_type"] == "video") & ~F.coalesce(s["disposition"]["attached_pic"] == 1, F.lit(False)))
    audios = F.filter(probe["streams"], lambda s: s["codec_type"] == "audio")
    v, a = F.get(videos, 0), F.get(audios, 0)
    container = F.coalesce(probe["format"]["format_name"], F.lit("unknown"))
    duration = F.coalesce(F.coalesce(probe["format"]["duration"], v["duration"], a["duration"]).try_cast("double"), F.lit(0.0))
    still = (duration == 0) | container.rlike("image2|png_pipe|mjpeg|webp|gif")
    kind = F.when(v.isNotNull() & still & a.isNull(), "image").when(v.isNotNull(), "video").when(a.isNotNull(), "audio")
    seen = v.isNotNull() & (v["width"] > 0) & (v["height"] > 0)
    return F.struct(
        kind.alias("kind"),
        container.alias("container"),
        duration.alias("duration_sec"),
        F.coalesce(probe["format"]["size"].try_cast("long"), F.lit(0).cast("long")).alias("size_bytes"),
        probe["format"]["bit_rate"].try_cast("long").alias("bitrate"),
        F.when(seen, F.struct(F.coalesce(v["codec_name"], F.lit("unknown")).alias("codec"), v["width"].alias("width"), v["height"].alias("height"), frame_rate(F.coalesce(v["avg_frame_rate"], v["r_frame_rate"])).alias("fps"), v["pix_fmt"].alias("pix_fmt"))).alias("video"),
        F.when(seen, aspect(v["width"], v["height"])).alias("aspect"),
        F.when(a.isNotNull(), F.struct(F.coalesce(a["codec_name"], F.lit("unknown")).alias("codec"), F.coalesce(a["channels"], F.lit(0)).alias("channels"), a["sample_rate"].try_cast("int").alias("sample_rate"))).alias("audio"),
        F.greatest(F.size(audios), F.lit(0)).alias("audio_tracks"),
    )


def supports(info: Column, task: str) -> Column:
    """Whether a task can run on the medium."""
    return info["video"].isNotNull() if task in ("keyframes",) else info["audio"].isNotNull() if task in ("transcribe", "diarize") else F.lit(True)


def normalised_video(width: Column, height: Column, rate: Column) -> Column:
    """Even sizes and a whole frame rate from 1 to 60 (30 if unknown)."""
    fps = F.floor(F.when(F.coalesce(rate, F.lit(0.0)) == 0, 30.0).otherwise(rate) + 0.5)
    return F.struct((F.floor(width / 2) * 2).alias("width"), (F.floor(height / 2) * 2).alias("height"), F.greatest(F.lit(1), F.least(F.lit(60), fps)).alias("fps"))


def confidence(speech: Column, words: Column, dur: Column, n_flags: Column) -> Column:
    """How far a segment is believed: speech under it, a plausible rate, and flags."""
    rate = words / dur
    plausible = F.when((rate >= 0.8) & (rate <= 5), 1.0).when(rate < 0.8, 0.75).otherwise(0.5)
    return F.round(F.lit(0.55) * F.least(F.lit(1.0), speech / 0.6) + F.lit(0.3) * plausible + F.lit(0.15) * F.when(n_flags > 0, 0.4).otherwise(1.0), 2)


def _estimate(task: str, duration: object, cap: object, fast: bool, secrets: bool, least: Callable, greatest: Callable, up: Callable) -> object:
    if task == "transcribe":
        return 8.0 + duration * (0.2 if fast else 0.6)
    if task == "keyframes":
        return 6.0 + duration * 0.04 + least(cap, duration / 5) * 0.3
    if task == "read_screen":
        return 10.0 + duration * 0.04 + least(cap, greatest(6.0, duration / 6)) * 3.2
    if task == "review":
        base = 4.0 + duration * 0.06
        return base + 10 + duration * 0.04 + least(cap, up(duration / 4)) * 3.2 if secrets else base
    if task == "diarize":
        return 12.0 + duration * 0.08
    raise ValueError(f"unknown task {task}")


def estimate_seconds(task: str, duration: Column, max_frames: Column | int = 120, fast: bool = False, secrets: bool = True) -> Column:
    """Expected seconds of work of a task."""
    cap = F.lit(max_frames) if isinstance(max_frames, int) else max_frames
    return _estimate(task, duration, cap, fast, secrets, F.least, lambda a, b: F.greatest(F.lit(a), b), F.ceil)


def estimated(task: str, duration: float, max_frames: int = 120, fast: bool = False, secrets: bool = True) -> float:
    """The same of one medium, for the job engine."""
    return _estimate(task, duration, max_frames, fast, secrets, min, max, math.ceil)


def speaker_name(i: Column) -> Column:
    return F.format_string("SPEAKER_%02d", i)


def cache_key(*parts: Column) -> Column:
    """20 hex digits of the SHA-1 of the parts as JSON; every parameter that changes the output belongs in."""
    return F.left(F.sha1(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})), F.lit(20))


SMALL_FILE = 64 * 1024 * 1024


def file_identity(path: Column, size: Column, modified: Column, content: Column) -> Column:
    """By content up to 64 MiB, else by path, size and time of change."""
    by_facts = F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string")))
    return F.when(size <= SMALL_FILE, F.concat(F.lit("c_"), F.left(F.sha2(content, 256), F.lit(24)))).otherwise(F.concat(F.lit("f_"), F.left(by_facts, F.lit(24))))


def valid_job_id(job_id: Column) -> Column:
    return job_id.rlike(r"\Aj_[0-9a-f]{12}\z")


def ipv4(text: Column) -> Column:
    """The four numbers of a dotted quad, or null."""
    return F.when(text.rlike(r"\A((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!\z)|\z)){4}"), F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def is_private_ipv4(quad: Column) -> Column:
    """Loopback, private, link-local, shared, documentation, multicast and reserved ranges; null is private."""
    a, b = F.get(quad, 0), F.get(quad, 1)
    hit = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19, 51)) | ((a == 203) & (b == 0)) | (a >= 224)
    return F.coalesce(hit, F.lit(True))


def refused_host(host: Column) -> Column:
    """Names that never leave the machine or its network."""
    bare = F.regexp_replace(F.lower(host), r"\.\z", "")
    return (bare == "localhost") | bare.rlike(r"\.(localhost|local|internal|home\.arpa)\z")
