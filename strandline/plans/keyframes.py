"""Key frames: what changed, hard cuts, requested instants, and a floor of one frame every so often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import vision
from strandline.operators import folds, intervals

_COLS = ("media_id", "pts", "kind", "sources", "dhash", "distance")


def _tagged(points: DataFrame, kind: int, tag: str) -> DataFrame:
    return points.select("media_id", "pts", F.lit(kind).alias("kind"), F.array(F.lit(tag)).alias("sources"), F.lit(None).cast("bigint").alias("dhash"), F.lit(None).cast("int").alias("distance"))


def _numbered(candidates: DataFrame) -> DataFrame:
    """An explicit order for candidates of one time: by kind, as they were gathered."""
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy("media_id").orderBy("pts", "kind")))


def select_frames(hashes: DataFrame, cuts: DataFrame, media: DataFrame, anchors: DataFrame | None = None, sensitivity: str = "normal", max_frames: int = 120, floor_sec: float = 20.0, preserve_floor: bool = False, from_sec: float = 0.0) -> DataFrame:
    """Frames per medium: index, pts, sources, dhash, distance, sheet and tile.

    ``media`` has media_id and to_sec.  A cut is taken 0.4 s later, once the picture has settled, and never
    after the last quarter of a second.
    """
    kept = folds.dedup_hashes(hashes, sensitivity).select("media_id", "pts", F.lit(0).alias("kind"), F.array(F.lit("hash")).alias("sources"), "dhash", "distance")
    settled = cuts.join(media, "media_id").select("media_id", F.least(F.col("pts") + 0.4, F.col("to_sec") - 0.25).alias("pts"))
    every = kept.select(*_COLS).unionByName(_tagged(settled, 1, "cut"))
    if anchors is not None:
        wanted = anchors.join(media, "media_id").where((F.col("pts") >= from_sec) & (F.col("pts") <= F.col("to_sec")))
        every = every.unionByName(_tagged(wanted, 2, "anchor"))
    merged = folds.merge_candidates(_numbered(every))
    if floor_sec > 0:
        floor = intervals.floor_points(merged.join(media, "media_id"), from_sec, floor_sec)
        again = merged.withColumn("kind", F.col("ord")).select(*_COLS).unionByName(_tagged(floor, 1 << 30, "floor"))
        merged = folds.merge_candidates(_numbered(again))
    left = folds.prune(merged, max_frames, preserve_floor)
    index = F.row_number().over(Window.partitionBy("media_id").orderBy("pts", "ord"))
    placed = left.withColumn("index", index).withColumn("place", vision.sheet_place(F.col("index")))
    return placed.select("media_id", "index", F.round("pts", 2).alias("pts"), "sources", "dhash", "distance", "place.sheet", "place.tile")


def sheets(frames: DataFrame) -> DataFrame:
    return frames.groupBy("media_id", "sheet").agg(F.array_sort(F.collect_list("index")).alias("frames"))


def files(frames: DataFrame) -> DataFrame:
    """Frames with the names of their picture and of the sheet it is on; numbers are padded, so names sort as frames do."""
    sheet = vision.sheet_place(F.col("index"))["sheet"]
    return frames.withColumns({"file": F.format_string("frames/%03d.jpg", F.col("index")), "sheet_file": F.format_string("sheets/%02d.jpg", sheet)})


def manifest(frames: DataFrame) -> DataFrame:
    """(media_id, json): what is known of each frame and its files, in order."""
    row = F.struct("index", "pts", "sources", "dhash", "distance", "file", "sheet_file")
    return files(frames).groupBy("media_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def pick(frames: DataFrame, sheet_ids: list[int] | None = None, frame_ids: list[int] | None = None, most: int = 6) -> DataFrame:
    """What to show of a medium: the sheets asked for (the first two by default), then frames, at most so many pictures."""
    if sheet_ids is None and frame_ids is None:
        sheet_ids = [1, 2]
    shown = frames.select("media_id", F.lit("sheet").alias("what"), F.col("sheet").cast("int").alias("no")).where(F.col("sheet").isin(sheet_ids or [])).distinct()
    shown = shown.unionByName(frames.select("media_id", F.lit("frame").alias("what"), F.col("index").cast("int").alias("no")).where(F.col("index").isin(frame_ids or [])))
    at = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("what"), "no"))
    return shown.withColumn("at", at).where(F.col("at") <= most).drop("at")
