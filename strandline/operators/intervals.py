"""Interval algebra on a time axis per medium.

Overlap joins give every interval the buckets of time it touches and join on (medium, bucket), so a long
recording is many join keys, not one; a pair that shares several buckets is kept in the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn("__low", low).withColumn("__bucket", F.explode(F.sequence(low, F.greatest(low, high))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float = 30.0, ls: str = "start_sec", le: str = "end_sec", rs: str = "r_start", re: str = "r_end", how: str = "inner") -> DataFrame:
    """Pairs with ``left.start < right.end`` and ``right.start < left.end``; ``how`` inner or left."""
    a, b = _bucketed(left, ls, le, width), _bucketed(right, rs, re, width).withColumnsRenamed({"__low": "__low_r", "__bucket": "__bucket_r", key: "__key_r"})
    once = F.col("__bucket") == F.greatest("__low", "__low_r")
    on = (F.col(key) == F.col("__key_r")) & (F.col("__bucket") == F.col("__bucket_r")) & once & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    pairs = a.join(b, on).drop("__low", "__low_r", "__bucket", "__bucket_r", "__key_r")
    if how == "inner":
        return pairs
    extra = [c for c in right.columns if c != key]
    return left.join(pairs.select(*left.columns, *extra), left.columns, "left")


def overlap() -> Column:
    return F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")


def speech_ratio(segments: DataFrame, regions: DataFrame, width: float = 30.0) -> DataFrame:
    """(media_id, seg_id, ratio): the share of each segment that speech regions cover, at most 1."""
    pairs = overlap_join(segments.select("media_id", "seg_id", "start_sec", "end_sec"), regions.select("media_id", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end")), "media_id", width)
    covered = pairs.groupBy("media_id", "seg_id").agg(F.sum(overlap()).alias("covered"))
    length = F.greatest(F.lit(0.01), F.col("end_sec") - F.col("start_sec"))
    return segments.join(covered, ["media_id", "seg_id"], "left").select("media_id", "seg_id", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / length).alias("ratio"))


def best_speaker(segments: DataFrame, turns: DataFrame, width: float = 30.0) -> DataFrame:
    """(media_id, seg_id, speaker): whose turn overlaps most, the earlier on a tie, null if none does."""
    pairs = overlap_join(segments.select("media_id", "seg_id", "start_sec", "end_sec"), turns.select("media_id", "turn_no", "speaker", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end")), "media_id", width)
    best = pairs.groupBy("media_id", "seg_id").agg(F.max_by("speaker", F.struct(F.round(overlap(), 6), -F.col("turn_no"))).alias("speaker"))
    return segments.select("media_id", "seg_id").join(best, ["media_id", "seg_id"], "left")


def nearest_label(short: DataFrame, labelled: DataFrame) -> DataFrame:
    """(media_id, turn_no, label): the label of the nearest start, the earlier turn on a tie, 0 if there is none.

    Only the neighbours on either side can be nearest, so both tables are merged on the time axis and
    each short turn looks back and ahead; no pairs are made.
    """
    kinds = labelled.select("media_id", "turn_no", "start_sec", "label", F.lit(0).alias("short")).unionByName(short.select("media_id", "turn_no", "start_sec", F.lit(None).cast("int").alias("label"), F.lit(1).alias("short")))
    known = F.when(F.col("short") == 0, F.struct("start_sec", "turn_no", "label"))
    first_at = Window.partitionBy("media_id", "start_sec", "short").orderBy("turn_no")
    at_once = kinds.withColumn("first", F.when(F.col("short") == 0, F.first(F.struct("start_sec", "turn_no", "label")).over(first_at)))
    back = Window.partitionBy("media_id").orderBy("start_sec", "short", "turn_no").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("media_id").orderBy("start_sec", F.desc("short"), "turn_no").rowsBetween(0, Window.unboundedFollowing)
    seen = at_once.withColumn("before", F.last(F.when(F.col("short") == 0, F.col("first")), ignorenulls=True).over(back)).withColumn("after", F.first(known, ignorenulls=True).over(ahead))
    d0, d1 = F.round(F.col("start_sec") - F.col("before.start_sec"), 6), F.round(F.col("after.start_sec") - F.col("start_sec"), 6)
    pick = F.when(F.col("before").isNull(), F.col("after.label")).when(F.col("after").isNull(), F.col("before.label")).when((d0 < d1) | ((d0 == d1) & (F.col("before.turn_no") < F.col("after.turn_no"))), F.col("before.label")).otherwise(F.col("after.label"))
    return seen.where("short = 1").select("media_id", "turn_no", F.coalesce(pick, F.lit(0)).alias("label"))


def islands(rows: DataFrame, label: str, gap: float, order: str, first_confidence: bool = False) -> DataFrame:
    """Neighbouring rows of one label less than ``gap`` apart as one: start of the first, end of the last, best confidence (or the first's)."""
    w = Window.partitionBy("media_id").orderBy("start_sec", order)
    new = F.when((F.lag(label).over(w) == F.col(label)) & (F.round(F.col("start_sec") - F.lag("end_sec").over(w), 6) < gap), 0).otherwise(1)
    numbered = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    spot = F.struct("start_sec", order)
    conf = F.min_by("confidence", spot) if first_confidence else F.max("confidence")
    return numbered.groupBy("media_id", "__island").agg(F.min("start_sec").alias("start_sec"), F.max_by("end_sec", spot).alias("end_sec"), F.min_by(label, spot).alias(label), conf.alias("confidence")).withColumnRenamed("__island", "turn_no")


def to_turns(local: DataFrame) -> DataFrame:
    """Speech turns of local speaker pieces: joined under 0.4 s, slivers under 0.6 s dropped."""
    return islands(local, "local", 0.4, "seg_no").where(F.round(F.col("end_sec") - F.col("start_sec"), 6) >= 0.6)


def merge_speaker(turns: DataFrame) -> DataFrame:
    """Turns of one speaker under 0.6 s apart as one, with the first's confidence."""
    return islands(turns, "speaker", 0.6, "turn_no", first_confidence=True)


def split_long(regions: DataFrame, most: float = 28.0, stride: float = 26.0) -> DataFrame:
    """Regions longer than ``most`` as overlapping windows; the last one ends where the region does."""
    length = F.round(F.col("end_sec") - F.col("start_sec"), 6)
    extra = F.greatest(F.lit(0), F.ceil((length - most) / stride)).cast("int")
    parts = regions.withColumn("__k", extra).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__k"))))
    start = F.col("start_sec") + F.col("piece") * stride
    return parts.withColumn("end_sec", F.when(F.col("piece") == F.col("__k"), F.col("end_sec")).otherwise(start + most)).withColumn("start_sec", start).drop("__k")


def floor_points(points: DataFrame, from_sec: float, floor_sec: float, to_col: str = "to_sec") -> DataFrame:
    """(media_id, pts) that leave no gap over ``floor_sec`` from the start over each point to the end."""
    w = Window.partitionBy("media_id").orderBy("pts")
    gaps = points.select("media_id", to_col, F.coalesce(F.lag("pts").over(w), F.lit(float(from_sec))).alias("a"), F.col("pts").alias("b"))
    last = points.groupBy("media_id").agg(F.max("pts").alias("a"), F.first(to_col).alias("b")).select("media_id", "a", "b")
    every = gaps.select("media_id", "a", "b").unionByName(last)
    n = F.greatest(F.lit(0), F.ceil(F.round((F.col("b") - F.col("a")) / floor_sec, 6)) - 1).cast("int")
    return every.where(n > 0).select("media_id", "a", F.explode(F.sequence(F.lit(1), n)).alias("k")).select("media_id", (F.col("a") + F.col("k") * floor_sec).alias("pts"))


def max_gap(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("pts")
    return points.withColumn("__gap", F.col("pts") - F.lag("pts").over(w)).groupBy("media_id").agg(F.max("__gap").alias("max_gap"))


def embedding_crop(turns: DataFrame, rate: int = 16_000, most: float = 8.0) -> DataFrame:
    """First and last sample of the middle of each turn, at most ``most`` seconds."""
    length = F.least(F.lit(most), F.col("end_sec") - F.col("start_sec"))
    first = F.greatest(F.lit(0), F.floor(((F.col("start_sec") + F.col("end_sec")) / 2 - length / 2) * rate))
    return turns.withColumn("first_sample", first).withColumn("last_sample", first + F.floor(length * rate))


def embeddable(turns: DataFrame, least: float = 1.5) -> DataFrame:
    """``embed``: whether a turn carries a voice; all do in a medium with fewer than two long ones."""
    long = F.col("end_sec") - F.col("start_sec") >= least
    n = F.count_if(long).over(Window.partitionBy("media_id"))
    return turns.withColumn("embed", long | (n < 2))


def slabs(pieces: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Speaker labels are local to a slab of a recording: the slab's number moves them apart."""
    slab = F.floor(F.col("start_sec") / seconds).cast("int")
    return pieces.withColumn("slab", slab).withColumn("local", F.col("local") + 100 * slab)
