"""Speakers from voice vectors: agglomerative clustering with average linkage, per medium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Clusters compared with all others at a time.
BLOCK = 512


def _block(sums: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean similarity of the clusters ``rows`` to every cluster: that of two is the product of their vector sums."""
    return np.round((sums[rows] @ sums.T) / np.outer(size[rows], size), 12)


def _nearest(sums: np.ndarray, size: np.ndarray, alive: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest later cluster of each of ``rows``, the first of equals, and how close it is."""
    means = _block(sums, size, rows)
    means[(np.arange(len(size)) <= rows[:, None]) | ~alive] = -np.inf
    at = means.argmax(axis=1)
    return means[np.arange(len(rows)), at], at


def cluster(vectors: np.ndarray, weights: np.ndarray, threshold: float = 0.35, most: int = 8, least: int = 1) -> list[int]:
    """Labels by first appearance.

    The two closest clusters merge while they are as close as the threshold, or there are more than
    ``most``; never below ``least``.  Then a cluster of one or two turns with under 5 % of the time joins
    its nearest.  Vector sums of clusters and the nearest later cluster of each are kept, so memory grows
    with the turns, and a merge looks again only at the clusters whose nearest it took.
    """
    n = len(vectors)
    if not n:
        return []
    sums, size = vectors.astype(np.float64), np.ones(n)
    members, alive = [[i] for i in range(n)], np.ones(n, bool)
    best, near = np.empty(n), np.empty(n, np.int64)
    for start in range(0, n, BLOCK):
        rows = np.arange(start, min(n, start + BLOCK))
        best[rows], near[rows] = _nearest(sums, size, alive, rows)
    left = n
    while left > max(least, 1):
        i = int(best.argmax())
        j = int(near[i])
        if best[i] < threshold and left <= most:
            break
        sums[i] += sums[j]
        size[i] += size[j]
        members[i].extend(members[j])
        alive[j], best[j] = False, -np.inf
        left -= 1
        lost = alive & ((near == i) | (near == j)) & (best > -np.inf)
        lost[i] = True
        before = np.flatnonzero(alive[:i] & ~lost[:i])
        if len(before):
            means = _block(sums, size, np.array([i]))[0, before]
            closer = (means > best[before]) | ((means == best[before]) & (near[before] > i))
            best[before[closer]], near[before[closer]] = means[closer], i
        rows = np.flatnonzero(lost)
        for start in range(0, len(rows), BLOCK):
            part = rows[start : start + BLOCK]
            best[part], near[part] = _nearest(sums, size, alive, part)
        if left < len(alive) // 2:  # close up, in the same order
            place = np.cumsum(alive) - 1
            sums, size, best, near = sums[alive], size[alive], best[alive], place[near[alive]]
            members = [m for m, a in zip(members, alive, strict=True) if a]
            alive = np.ones(left, bool)
    sums, size, members = sums[alive], size[alive], [m for m, a in zip(members, alive, strict=True) if a]
    total, changed = float(weights.sum()), True
    while changed and len(members) > least:
        changed = False
        for i, mine in enumerate(members):
            if len(mine) <= 2 and float(weights[mine].sum()) < total * 0.05 and len(members) > 1:
                row = _block(sums, size, np.array([i]))[0]
                row[i] = -np.inf
                j = int(row.argmax())
                members[j].extend(mine)
                sums[j] += sums[i]
                size[j] += size[i]
                keep = np.arange(len(size)) != i
                sums, size = sums[keep], size[keep]
                del members[i]
                changed = True
                break
    labels = [0] * n
    for label, mine in enumerate(sorted(members, key=min)):
        for i in mine:
            labels[i] = label
    return labels


def cluster_speakers(turns: DataFrame, threshold: float = 0.35, most: int = 8, least: int = 1) -> DataFrame:
    """(media_id, turn_no, embedding, weight) -> (media_id, turn_no, label)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_no")
        labels = cluster(np.array(pdf["embedding"].tolist()), pdf["weight"].to_numpy(), threshold, most, least)
        return pd.DataFrame({"media_id": pdf["media_id"], "turn_no": pdf["turn_no"], "label": labels})

    return turns.select("media_id", "turn_no", "embedding", "weight").groupBy("media_id").applyInPandas(run, "media_id string, turn_no int, label int")
