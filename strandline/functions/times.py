"""Media time: seconds as doubles, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = r"\d+(\.\d+)?"
HINT = "use seconds (90) or a text like 90, 1:30 or 0:01:30.5"


def parse_time(text: Column, strict: bool = True) -> Column:
    """Seconds of ``90``, ``1:30`` or ``0:01:30.5``; null and empty give null, anything else an error (null unless strict)."""
    bare = F.btrim(text)
    fits = bare.rlike(rf"\A{_FIELD}(:{_FIELD}){{0,2}}\z")
    value = F.aggregate(F.split(bare, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    other = F.raise_error(F.concat(F.lit("invalid time "), text, F.lit(f"; {HINT}"))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("double")).when(fits, value).otherwise(other)


def format_time(sec: Column) -> Column:
    """``m:ss.s``, or ``h:mm:ss.s`` from an hour on; below 0 counts as 0. 59.96 gives 0:60.0."""
    s = F.greatest(sec, F.lit(0.0))
    hours, minutes = F.floor(s / 3600), F.floor((s % 3600) / 60)
    tail = F.format_string("%04.1f", (s % 60).cast("double"))
    return F.when(hours > 0, F.format_string("%d:%02d:%s", hours, minutes, tail)).otherwise(F.format_string("%d:%s", minutes, tail))


def srt_time(sec: Column) -> Column:
    """``HH:MM:SS,mmm``; milliseconds are rounded by themselves and can read 1000."""
    whole = F.floor(sec)
    ms = F.floor((sec - whole) * 1000 + 0.5)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor((sec % 3600) / 60), F.floor(sec % 60), ms)


def in_window(pts: Column, from_sec: float | None, to_sec: float | None) -> Column:
    """A predicate on a stored column, so it reaches the scan."""
    out = F.lit(True)
    if from_sec is not None:
        out = out & (pts >= from_sec)
    if to_sec is not None:
        out = out & (pts <= to_sec)
    return out


def window_duration(total: Column, from_sec: Column, to_sec: Column) -> Column:
    """Seconds of work in a window of a medium of maybe unknown length."""
    whole = F.coalesce(total, F.lit(600.0))
    return F.greatest(F.lit(1.0), F.least(whole, F.coalesce(to_sec, whole) - F.coalesce(from_sec, F.lit(0.0))))
