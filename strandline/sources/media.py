"""Sources: where media come from, and the pluggable operators that read them.

Classification and limits are column rules over a table of inputs.  What needs a codec, a model or a
network is an external operator: a function from DataFrame to DataFrame with a fixed schema, which is
checked on the way out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schemas
from strandline.errors import EngineError
from strandline.functions import media

#: Hosts that need a downloader, and extensions that are media.
SITE_HOSTS = r"(?i)(^|\.)(youtube\.com|youtu\.be|instagram\.com|tiktok\.com|vimeo\.com|twitter\.com|x\.com|facebook\.com|twitch\.tv|loom\.com|grain\.com)\z"
MEDIA_EXT = r"(?i)\.(mp4|mkv|mov|webm|m4v|avi|mp3|m4a|wav|flac|ogg|opus|aac|png|jpg|jpeg|webp|gif)\z"
DATA_URI = r"(?is)\Adata:([^;,]*)((?:;[^,]*)?),(.*)\z"


def origin(source: Column) -> Column:
    """data, site, url, unsupported or local."""
    host = F.try_parse_url(source, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(source, F.lit("PATH")), F.lit(""))
    web = source.rlike(r"(?i)\Ahttps?://")
    return (
        F.when(source.rlike(r"(?i)\Adata:"), "data")
        .when(web & host.rlike(SITE_HOSTS) & ~path.rlike(MEDIA_EXT), "site")
        .when(web, "url")
        .when(source.rlike(r"(?i)\Afile://"), "local")
        .when(source.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), "unsupported")
        .otherwise("local")
    )


def local_path(source: Column) -> Column:
    return F.when(source.rlike(r"(?i)\Afile://"), F.url_decode(F.replace(F.regexp_replace(source, r"(?i)\Afile://", ""), F.lit("+"), F.lit("%2B")))).otherwise(source)


def data_uri(source: Column) -> Column:
    """struct(mime, content) of a data URI, or null."""
    part = lambda i: F.regexp_extract(source, DATA_URI, i)
    body = F.when(part(2).rlike(r"(?i);base64\z"), F.try_to_binary(part(3), F.lit("base64"))).otherwise(F.url_decode(F.replace(part(3), F.lit("+"), F.lit("%2B"))).cast("binary"))
    return F.when(source.rlike(DATA_URI), F.struct(F.lower(part(1)).alias("mime"), body.alias("content")))


def refused(source: Column) -> Column:
    """Whether a web source names a host that must not be fetched from (names and IPv4 literals)."""
    host = F.coalesce(F.try_parse_url(source, F.lit("HOST")), F.lit(""))
    quad = media.ipv4(host)
    return media.refused_host(host) | F.when(quad.isNotNull(), media.is_private_ipv4(quad)).otherwise(F.lit(False))


def hops_allowed(hops: Column, most: int = 5) -> Column:
    """Whether a chain of redirects (an array of URLs) may be followed: few hops, web only, each host allowed."""
    return (F.size(hops) <= most + 1) & F.forall(hops, lambda u: u.rlike(r"(?i)\Ahttps?://") & ~refused(u))


def allowed_args(args: Column, flags: list[str], with_value: list[str]) -> Column:
    """Downloader arguments that are allowed: known flags, and whatever follows a known flag that takes a value."""
    return F.filter(args, lambda a, i: a.isin(*flags, *with_value) | (F.when(i > 0, F.get(args, i - 1)).isin(*with_value)))


def too_large(length: Column, most: int) -> Column:
    return F.coalesce(length > most, F.lit(False))


def resolve(inputs: DataFrame, col: str = "input") -> DataFrame:
    """Inputs with origin, path, and whether the source is refused."""
    c = F.col(col)
    return inputs.withColumns({"origin": origin(c), "path": local_path(c), "refused": F.when(origin(c).isin("url", "site"), refused(c)).otherwise(F.lit(False))})


def participant(name: Column) -> Column:
    """A participant's name from the file name of their track."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\Aaudio", ""), r"(?i)\d+\.(m4a|mp3|wav)\z", "")
    said = F.btrim(F.regexp_replace(bare, "[_-]+", " "))
    return F.when(said == "", F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(said)


def folder_tracks(files: DataFrame) -> DataFrame:
    """Recordings with a track per person: files (folder, path, length) -> folder, mixed, tracks.

    Tracks are the audio files under ``Audio Record``; the mixed recording is the largest at the top.
    """
    base = F.regexp_replace("path", r"\A.*/", "")
    track = F.col("path").rlike(r"(?i)/audio record/[^/]+\.(m4a|mp3|wav)\z")
    mixed = F.col("path").rlike(r"(?i)\.(mp4|m4a)\z") & ~F.col("path").rlike(r"(?i)/audio record/")
    pair = F.struct(participant(base).alias("participant"), F.col("path").alias("file"))
    out = files.groupBy("folder").agg(F.max_by(F.when(mixed, F.col("path")), F.when(mixed, F.col("length"))).alias("mixed"), F.array_sort(F.collect_list(F.when(track, pair))).alias("tracks"))
    return out.where("mixed is not null and size(tracks) > 0")


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as rows with their identity: path, length, modification time, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.withColumn("identity", media.file_identity(F.col("path"), F.col("length"), F.col("modificationTime"), F.col("content")))


def probed(rows: DataFrame, json_col: str = "probe") -> DataFrame:
    """Probe outputs (JSON) as media facts in ``info``."""
    return rows.withColumn("info", media.media_info(F.from_json(json_col, schemas.PROBE)))


# -- external operators ---------------------------------------------------------------------------

#: The schema that each external operator must return.
EXTERNAL = {
    "decode": schemas.PCM,
    "speech_probabilities": "media_id string, idx int, p double",
    "transcribe_window": "media_id string, window_no int, start_sec double, end_sec double, text string",
    "segment_speakers": "media_id string, seg_no int, start_sec double, end_sec double, local int, confidence double",
    "speaker_embeddings": "media_id string, turn_no int, embedding array<float>",
    "embed_text": "doc_id string, embedding array<float>",
    "thumbnails": "media_id string, idx int, pts double, pixels array<int>",
    "scene_scores": "media_id string, pts double, score double",
    "ocr": schemas.BLOCKS,
    "loudness": "media_id string, integrated_lufs double, true_peak_dbtp double, loudness_range double, threshold double",
    "silence_log": "media_id string, line_no int, line string",
    "probe": "media_id string, probe string",
}


class Externals:
    """What is plugged in for the operators that need a codec, a model or a network."""

    def __init__(self) -> None:
        self._found: dict[str, Callable[..., DataFrame]] = {}

    def plug(self, name: str, run: Callable[..., DataFrame]) -> None:
        if name not in EXTERNAL:
            raise EngineError("INVALID_ARGUMENT", f"no external operator {name}")
        self._found[name] = run

    def call(self, name: str, *args: object, **more: object) -> DataFrame:
        if name not in self._found:
            raise EngineError("TOOL_MISSING", f"nothing is plugged in for {name}", "plug in a function that returns its schema")
        out, want = self._found[name](*args, **more), T.StructType.fromDDL(EXTERNAL[name])
        got = {f.name: f.dataType.simpleString() for f in out.schema}
        if missing := [f.name for f in want if got.get(f.name) != f.dataType.simpleString()]:
            raise EngineError("TOOL_FAILED", f"{name} returned other columns than {missing}")
        return out.select(*want.fieldNames())


def sample_times(media: DataFrame, rate: float, from_sec: float = 0.0) -> DataFrame:
    """(media_id, to_sec) -> (media_id, idx, pts): when frames are sampled at so many a second, up to the end."""
    n = F.greatest(F.lit(0), F.ceil(F.round((F.col("to_sec") - from_sec) * rate, 6))).cast("int")
    return media.where(n > 0).select("media_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).select("media_id", "idx", (F.lit(float(from_sec)) + F.col("idx") / rate).alias("pts"))


def scene_cuts(scores: DataFrame, threshold: float = 0.3, from_sec: float = 0.0) -> DataFrame:
    """Cuts in source time from scores in window time."""
    return scores.where(F.col("score") > threshold).select("media_id", (F.col("pts") + from_sec).alias("pts"))


def loudness_of_log(log: Column) -> Column:
    """The four figures of a loudness analysis, from the JSON in its log."""
    body = F.regexp_extract(log, r"(\{[^{}]*\"input_i\"[^{}]*\})", 1)
    j = F.from_json(body, "input_i string, input_tp string, input_lra string, input_thresh string")
    return F.when(body != "", F.struct(*[j[a].try_cast("double").alias(b) for a, b in (("input_i", "integrated_lufs"), ("input_tp", "true_peak_dbtp"), ("input_lra", "loudness_range"), ("input_thresh", "threshold"))]))


def model_path(url: Column) -> Column:
    """Where a model file is kept: host and path, without parts that climb."""
    bare = F.regexp_replace(url, r"\A[a-z]+://", "")
    return F.array_join(F.filter(F.split(bare, "/"), lambda p: ~p.isin("", ".", "..")), "/")
