"""Who speaks when: local pieces to turns, voices to speakers, turns to transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import media
from strandline.operators import clustering, intervals


def speaker_turns(local: DataFrame, voices: DataFrame, threshold: float = 0.35, most: int = 8, least: int = 1) -> DataFrame:
    """local: media_id, seg_no, start_sec, end_sec, local, confidence.  voices: media_id, turn_no, embedding of the turns that carry one."""
    turns = intervals.embeddable(intervals.to_turns(intervals.slabs(local)))
    weight = F.col("end_sec") - F.col("start_sec")
    carried = turns.where("embed").join(voices, ["media_id", "turn_no"]).withColumn("weight", weight).withColumn("turn_no", F.col("turn_no").cast("int"))
    labels = clustering.cluster_speakers(carried, threshold, most, least)
    known = turns.withColumn("turn_no", F.col("turn_no").cast("int")).join(labels, ["media_id", "turn_no"], "left")
    short = intervals.nearest_label(known.where("label is null"), known.where("label is not null")).withColumnRenamed("label", "near")
    named = known.join(short, ["media_id", "turn_no"], "left").withColumn("speaker", media.speaker_name(F.coalesce("label", "near", F.lit(0))))
    return intervals.merge_speaker(named.select("media_id", "turn_no", "start_sec", "end_sec", "speaker", "confidence"))


def track_turns(regions: DataFrame) -> DataFrame:
    """Recordings with a track per person: its speech is that person's. regions: media_id, participant, start_sec, end_sec."""
    w = Window.partitionBy("media_id").orderBy("start_sec", "participant")
    return regions.select("media_id", F.row_number().over(w).alias("turn_no"), "start_sec", "end_sec", F.col("participant").alias("speaker"), F.lit(0.99).alias("confidence"))


def speakers(turns: DataFrame) -> DataFrame:
    """Per medium and speaker: time, turns, and the clip to know the voice by (the first longest turn, 8 s at most)."""
    length = F.round(F.col("end_sec") - F.col("start_sec"), 6)
    longest = F.max_by(F.struct("start_sec", length.alias("len")), F.struct(length, -F.col("turn_no")))
    made = turns.groupBy("media_id", "speaker").agg(F.round(F.sum(length), 1).alias("talk_sec"), F.count(F.lit(1)).alias("turns"), longest.alias("l"))
    return made.select("media_id", "speaker", "talk_sec", "turns", F.col("l.start_sec").alias("clip_start"), F.least(F.lit(8.0), "l.len").alias("clip_sec"))
