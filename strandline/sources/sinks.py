"""Texts of results: transcripts, subtitles, screen texts, reports; a row per medium, or written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import times

#: The mark of each severity.
ICONS = {"ok": "✅", "info": "ℹ️", "warn": "⚠️", "block": "⛔"}


def _joined(rows: DataFrame, key: str, order: str, line: Column, glue: str, name: str) -> DataFrame:
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    return lines.select(key, F.array_join(F.transform("l", lambda x: x["line"]), glue).alias(name))


def transcript_text(segments: DataFrame) -> DataFrame:
    who = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "))).otherwise("")
    return _joined(segments, "media_id", "seg_id", F.concat(F.lit("["), times.format_time(F.col("start_sec")), F.lit("] "), who, "text"), "\n", "txt")


def subtitles(segments: DataFrame) -> DataFrame:
    """SRT: numbered from 1 in order, blank lines between."""
    row = F.struct(F.col("seg_id").alias("o"), times.srt_time(F.col("start_sec")).alias("a"), times.srt_time(F.col("end_sec")).alias("b"), F.when(F.col("speaker").isNotNull(), F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise("").alias("w"), F.col("text").alias("t"))
    rows = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(row)).alias("l"))
    cue = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["a"], F.lit(" --> "), x["b"], F.lit("\n"), x["w"], x["t"], F.lit("\n"))
    return rows.select("media_id", F.array_join(F.transform("l", cue), "\n").alias("srt"))


def labelled_text(segments: DataFrame) -> DataFrame:
    return _joined(segments, "media_id", "seg_id", F.concat(F.lit("["), times.format_time(F.col("start_sec")), F.lit("] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), "text"), "\n", "txt")


def screen_text(frames: DataFrame) -> DataFrame:
    head = F.concat(F.lit("=== #"), F.col("frame_idx").cast("string"), F.lit(" "), times.format_time(F.col("pts")), F.lit(" (conf "), F.col("mean_confidence").cast("string"), F.lit("%)\n"))
    return _joined(frames.where(F.btrim("text") != ""), "media_id", "frame_idx", F.concat(head, "text"), "\n", "txt")


def report(findings: DataFrame) -> DataFrame:
    """A review as Markdown, gravest first."""
    icon = F.lit("")
    for severity, mark in ICONS.items():
        icon = F.when(F.col("severity") == severity, mark).otherwise(icon)
    at = F.when(F.col("at_sec").isNotNull(), F.concat(F.lit(" _(at "), times.format_time(F.col("at_sec")), F.lit(")_"))).otherwise("")
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n  "), "detail")).otherwise("")
    return _joined(findings, "media_id", "ord", F.concat(F.lit("- "), icon, F.lit(" **"), "title", F.lit("**"), at, detail), "\n", "md")


def write_text(rows: DataFrame, col: str, path: str, key: str = "media_id") -> None:
    """One folder per medium; Spark's commit makes a file appear whole or not at all."""
    rows.select(key, col).write.mode("overwrite").partitionBy(key).text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
