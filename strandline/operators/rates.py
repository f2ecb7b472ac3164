"""Word and character error rates of a transcript against a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as txt


#: Places beside the diagonal that are looked at first, and characters beyond which the built-in distance is too slow.
NEAR, LONG = 64, 4_096


def _within(a: list[int], b: np.ndarray, width: int) -> tuple[int, tuple[int, int, int]]:
    """The cost of a cheapest alignment within ``width`` places of the diagonal, and its counts.

    Two rows of the table are held, and of them what is that near the diagonal: each cell carries the counts
    of the alignment that ends in it.
    """
    n, ramp = len(b), np.arange(len(b) + 1)
    never = len(a) + n + 1
    cost, counts = np.where(ramp <= width, ramp, never), np.stack([np.zeros_like(ramp), np.zeros_like(ramp), ramp])
    for i, word in enumerate(a, 1):
        lo, hi = max(0, i - width), min(n, i + width) + 1
        own, old = ramp[lo:hi], cost[lo:hi]
        before = np.r_[cost[lo - 1] if lo else never, old[:-1]]
        miss = np.ones(hi - lo, np.int64)
        miss[lo == 0 :] = b[max(lo - 1, 0) : hi - 1] != word
        now = np.minimum.accumulate(np.minimum(old + 1, before + miss) - own) + own  # an insertion adds one to the left neighbour
        diagonal, down = now == before + miss, now == old + 1
        made = counts[:, lo:hi].copy()
        made[1] += 1
        at = np.flatnonzero(diagonal)
        made[:, at] = counts[:, at + lo - 1]
        made[0, at] += miss[at]
        # what is neither follows the nearest cell on the left that is, by insertions
        place = own - lo
        from_cell = np.maximum.accumulate(np.where(diagonal | down, place, 0))
        made = made[:, from_cell]
        made[2] += place - from_cell
        counts[:, lo:hi], cost[lo:hi] = made, now
    return int(cost[n]), tuple(counts[:, n].tolist())


def alignment(reference: list, hypothesis: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of one cheapest alignment: of several, the one that read back from the
    end prefers a match or substitution, then a deletion.

    An alignment of cost c stays within c places of the diagonal, so the table is looked at near it only,
    further out until the cost found is within what was looked at.
    """
    codes: dict = {}
    a = [codes.setdefault(x, len(codes)) for x in reference]
    b = np.array([codes.setdefault(x, len(codes)) for x in hypothesis], np.int64)
    width = max(NEAR, abs(len(a) - len(b)))
    while True:
        cost, counts = _within(a, b, width)
        if cost <= width:
            return counts
        width *= 4


def distance(a: str, b: str) -> int:
    """Edits between two texts, near the diagonal and further out as for ``alignment``."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    both = min(len(x), len(y))
    same = np.flatnonzero(x[:both] != y[:both])
    x, y = x[(first := int(same[0]) if len(same) else both) :], y[first:]
    both = min(len(x), len(y))
    same = np.flatnonzero(x[::-1][:both] != y[::-1][:both])
    last = int(same[0]) if len(same) else both
    x, y = x[: len(x) - last], y[: len(y) - last]
    n, never, ramp = len(y), len(x) + len(y) + 1, np.arange(len(y) + 1)
    width = max(NEAR, abs(len(x) - len(y)))
    while True:
        cost = np.where(ramp <= width, ramp, never)
        for i, letter in enumerate(x.tolist(), 1):
            lo, hi = max(0, i - width), min(n, i + width) + 1
            best = cost[lo:hi] + 1
            best[lo == 0 :] = np.minimum(best[lo == 0 :], cost[max(lo - 1, 0) : hi - 1] + (y[max(lo - 1, 0) : hi - 1] != letter))
            cost[lo:hi] = np.minimum.accumulate(best - ramp[lo:hi]) + ramp[lo:hi]
        if cost[n] <= width:
            return int(cost[n])
        width *= 4


def _words(s: str | None) -> list[str]:
    return [w for w in (s or "").split(" ") if w]


_COUNTS = "struct<substitutions:int,deletions:int,insertions:int,reference_words:int,hypothesis_words:int,char_errors:int>"


def _counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h in zip(reference, hypothesis, strict=True):
        rw, hw = _words(r), _words(h)
        rc, hc = "".join(rw), "".join(hw)
        rows.append((*alignment(rw, hw), len(rw), len(hw), distance(rc, hc) if max(len(rc), len(hc)) > LONG else None))
    counts = pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "reference_words", "hypothesis_words", "char_errors"])
    return counts.astype({"char_errors": "Int32"})


def error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """The pairs with counts, ``wer`` and ``cer`` (four places; 0 for an empty reference).

    Pairs are dealt out anew: the work grows with the square of a text, not with the bytes that adaptive
    execution joins partitions by.
    """
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = pairs.withColumns({"__r": txt.plain_for_rates(F.col(reference)), "__h": txt.plain_for_rates(F.col(hypothesis))})
    letters = lambda c: F.coalesce(F.replace(c, F.lit(" "), F.lit("")), F.lit(""))
    r, h = letters("__r"), letters("__h")
    short = F.when(F.greatest(F.length(r), F.length(h)) <= LONG, F.levenshtein(r, h))
    chars = {"char_errors": F.coalesce("__c.char_errors", short), "reference_chars": F.length(r)}
    counted = plain.withColumn("__c", F.pandas_udf(_counts, _COUNTS)("__r", "__h"))
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)

    words = ("substitutions", "deletions", "insertions", "reference_words", "hypothesis_words")
    opened = counted.select(*pairs.columns, *[f"__c.{c}" for c in words], *[c.alias(n) for n, c in chars.items()])
    return opened.withColumn("wer", share(errors, F.col("reference_words"))).withColumn("cer", share(F.col("char_errors"), F.col("reference_chars")))
