"""Results that exceed a response's budget: the heaviest, most redundant fields go, the rest is capped and says so.

A job's result is its rows; its size is that of their JSON.  A job within the budget keeps its rows as
they are, with a null note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as txt


def tokens_of(*cols: str) -> Column:
    """Tokens of a row's columns as JSON, about."""
    return txt.estimate_tokens(F.to_json(F.struct(*cols)))


def _sized(rows: DataFrame, key: str) -> DataFrame:
    """The rows with ``__over``'s ingredients: the tokens and the number of rows of their job."""
    own = [c for c in rows.columns if c != key]
    sizes = rows.groupBy(key).agg(F.sum(tokens_of(*own)).alias("__tokens"), F.count(F.lit(1)).alias("__rows"))
    return rows.join(sizes, key)


def screen(frames: DataFrame, budget: int, key: str = "job_id") -> DataFrame:
    """Frames with text and blocks: over the budget blocks go, and a text keeps three characters for each of its share of tokens."""
    sized = _sized(frames, key)
    over = F.col("__tokens") > budget
    share = F.greatest(F.lit(60), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("__rows")))) * 3
    capped = F.when(F.length("text") <= share, F.col("text")).otherwise(F.concat(F.left("text", share.cast("int")), F.lit("…")))
    note = F.concat(F.lit("blocks omitted, texts capped; all of it: "), txt.artifact_uri(F.col(key), "ocr"))
    return sized.withColumns({"text": F.when(over, capped).otherwise(F.col("text")), "blocks": F.when(~over, F.col("blocks")), "note": F.when(over, note)}).drop("__tokens", "__rows")


def key_frames(frames: DataFrame, budget: int, key: str = "job_id", drop: str = "dhash") -> DataFrame:
    """Frames without their hashes where they are over the budget."""
    sized = _sized(frames, key)
    over = F.col("__tokens") > budget
    return sized.withColumns({drop: F.when(~over, F.col(drop)), "note": F.when(over, "hashes omitted")}).drop("__tokens", "__rows")


def segments(rows: DataFrame, budget: int, key: str = "job_id", order: str = "seg_id", artifact: str = "transcript") -> DataFrame:
    """The first segments that fit the budget, always one, and a note of how many are left out."""
    own, w = [c for c in rows.columns if c != key], Window.partitionBy(key)
    summed = rows.withColumn("__cost", tokens_of(*own)).withColumns({"__sum": F.sum("__cost").over(w.orderBy(order)), "__at": F.row_number().over(w.orderBy(order)), "__all": F.sum("__cost").over(w), "__n": F.count(F.lit(1)).over(w)})
    kept = summed.where((F.col("__all") <= budget) | (F.col("__at") == 1) | (F.col("__sum") <= budget)).withColumn("__left", F.col("__n") - F.count(F.lit(1)).over(w))
    note = F.when(F.col("__left") > 0, F.format_string("%d of %d segment(s) omitted; all of it: %s", F.col("__left"), F.col("__n"), txt.artifact_uri(F.col(key), artifact)))
    return kept.withColumn("note", note).drop("__cost", "__sum", "__at", "__all", "__n", "__left")
