"""Text on screen: frames of blocks, scanned for secrets, redacted, summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import filters, secrets


def frame_texts(blocks: DataFrame) -> DataFrame:
    """(media_id, frame_idx, text, mean_confidence, n_blocks) from blocks with an order ``block_no``."""
    good = filters.readable_blocks(blocks)
    made = good.groupBy("media_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("l"), F.floor(F.avg("confidence") + 0.5).cast("int").alias("mean_confidence"), F.count(F.lit(1)).alias("n_blocks"))
    return made.select("media_id", "frame_idx", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), "mean_confidence", "n_blocks")


def read_screen(frames: DataFrame, random_tokens: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frames (media_id, frame_idx, pts, text, ...) -> redacted frames, and findings once per medium."""
    found = secrets.scan(frames, random_tokens=random_tokens)
    clean = secrets.redacted(frames, found, ("media_id", "frame_idx", "pts"))
    return clean, secrets.dedupe_findings(found)


def stats(frames: DataFrame) -> DataFrame:
    return frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.btrim("text") != "").alias("frames_with_text"))
