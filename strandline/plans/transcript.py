"""What follows recognition in a transcript: coverage by speech, filters, confidence, glossary, language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import media
from strandline.functions import text as txt
from strandline.operators import filters, folds, glossary, intervals


def plan_windows(regions: DataFrame) -> DataFrame:
    """Windows to recognise: regions joined over small gaps, long ones split with an overlap."""
    return intervals.split_long(folds.merge_regions(regions)).select("media_id", "region_id", "piece", "start_sec", "end_sec")


def finish_segments(chunks: DataFrame, regions: DataFrame, phrases: DataFrame, terms: list[str] | None = None, loops: bool = True) -> DataFrame:
    """Chunks (media_id, seg_id, start_sec, end_sec, text, ...) that are kept, with flags and confidence."""
    ratio = intervals.speech_ratio(chunks, regions)
    known = chunks.join(ratio, ["media_id", "seg_id"]).withColumn("duration", F.greatest(F.lit(0.1), F.round(F.col("end_sec") - F.col("start_sec"), 6)))
    kept = filters.filter_segments(known, phrases, loops).where("keep")
    words = F.size(F.split("text", r"\s+"))
    out = kept.withColumn("confidence", media.confidence(F.col("ratio"), words, F.col("duration"), F.size("flags")))
    if terms:
        out = out.withColumn("__g", glossary.apply_glossary(F.col("text"), terms)).withColumns({"text": F.col("__g.text"), "replacements": F.col("__g.replacements")}).drop("__g")
    else:
        out = out.withColumn("replacements", F.lit(0))
    return out.withColumns({"start_sec": F.round("start_sec", 2), "end_sec": F.round("end_sec", 2)}).drop("duration", "ratio", "keep")


def stats(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Per medium: segments, filtered chunks, words, glossary replacements."""
    all_n = chunks.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    kept = segments.groupBy("media_id").agg(F.count(F.lit(1)).alias("segment_count"), F.sum(txt.word_count(F.col("text"))).alias("word_count"), F.sum("replacements").alias("replacements"))
    joined = all_n.join(kept, "media_id", "left").na.fill(0, ["segment_count", "word_count", "replacements"])
    return joined.select("media_id", "segment_count", (F.col("n") - F.col("segment_count")).alias("filtered_count"), "word_count", "replacements")


def languages(segments: DataFrame) -> DataFrame:
    said = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("l"))
    return said.select("media_id", txt.guess_language(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("language"))
