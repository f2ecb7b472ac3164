"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Gap-closed sessions: start, end, events, value."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "value")


def stage_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Events and value per kind in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), key, "n", "value")


def dedup_hashes(frames: DataFrame, threshold: int = 6) -> DataFrame:
    """Frames (media_id, idx, pts, dhash) that differ from the last kept one; the state is that one hash per medium."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, pts, h in zip(rows["idx"], rows["pts"], rows["dhash"], strict=True):
            d = 64 if last is None else ((int(h) ^ int(last)) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if d >= threshold:
                out.append((key[0], int(idx), float(pts), int(h), d))
                last = int(h)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["media_id", "idx", "pts", "dhash", "distance"])

    return frames.groupBy("media_id").applyInPandasWithState(step, "media_id string, idx int, pts double, dhash bigint, distance int", "last bigint", "append", GroupStateTimeout.NoTimeout)


def interrupted(beats: DataFrame, stale_ms: int = 30_000) -> DataFrame:
    """Jobs without a heartbeat for so long (by event time): (job_id, last_ms); beats: job_id, ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_ms": [last]})
            return
        seen = max(int(b["ts"].max().timestamp() * 1000) for b in batches)
        last = max(seen, state.get[0]) if state.exists else seen
        state.update((last,))
        state.setTimeoutTimestamp(max(last + stale_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [], "last_ms": []}).astype({"job_id": "object", "last_ms": "int64"})

    return beats.withWatermark("ts", "0 seconds").groupBy("job_id").applyInPandasWithState(step, "job_id string, last_ms bigint", "last_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
