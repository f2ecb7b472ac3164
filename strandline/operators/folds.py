"""Order-dependent folds: what is kept depends on what was kept before, so no window function can say it.

Each folds an ordered array of one medium in the JVM.  A medium's frames are bounded by its length
(a few bytes a second); media spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import vision


def _ordered(df: DataFrame, key: str, *cols: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))


def dedup_hashes(frames: DataFrame, threshold: int | str = "normal") -> DataFrame:
    """(media_id, idx, pts, dhash, distance): frames that differ enough from the last one kept; 64 for the first."""
    least = vision.SENSITIVITY[threshold] if isinstance(threshold, str) else threshold
    kind = "array<struct<idx:int,pts:double,dhash:bigint,distance:int>>"

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        d = F.when(last.isNull(), 64).otherwise(vision.hamming(f["dhash"], last["dhash"]))
        return F.when(last.isNull() | (d >= least), F.concat(acc, F.array(F.struct(f["idx"].alias("idx"), f["pts"].alias("pts"), f["dhash"].alias("dhash"), d.cast("int").alias("distance"))))).otherwise(acc)

    rows = _ordered(frames.select("media_id", F.col("idx").cast("int"), "pts", "dhash"), "media_id", "idx", "pts", "dhash")
    return rows.select("media_id", F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("f")).select("media_id", "f.*")


def speech_regions(frames: DataFrame, frame_sec: float = 0.032, threshold: float = 0.5, min_speech: float = 0.25, min_silence: float = 0.35, pad: float = 0.15) -> DataFrame:
    """(media_id, region_id, start_sec, end_sec) from speech probabilities (media_id, idx, p): enter at the threshold, leave
    after enough silence under 0.7 of it, at the silence's start; short regions go, the rest are padded and joined."""
    state = "struct<on:boolean,start:double,quiet:double,out:array<struct<s:double,e:double>>>"

    def step(acc: Column, f: Column) -> Column:
        t, p, none = f["idx"] * frame_sec, f["p"], F.lit(-1.0)
        low = p < threshold * 0.7
        quiet = F.when(acc["quiet"] < 0, t).otherwise(acc["quiet"])
        leave = acc["on"] & low & (F.round(t - quiet, 6) >= min_silence)
        return F.struct(
            F.when(acc["on"], ~leave).otherwise(p >= threshold).alias("on"),
            F.when(~acc["on"] & (p >= threshold), t).otherwise(acc["start"]).alias("start"),
            F.when(acc["on"] & low & ~leave, quiet).otherwise(none).alias("quiet"),
            F.when(leave, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("s"), quiet.alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    total = F.size("rows") * F.lit(frame_sec)
    start = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("start"), F.lit(-1.0).alias("quiet"), F.array().cast("array<struct<s:double,e:double>>").alias("out")).cast(state)
    raw = F.aggregate("rows", start, step, lambda acc: F.when(acc["on"], F.concat(acc["out"], F.array(F.struct(acc["start"].alias("s"), total.alias("e"))))).otherwise(acc["out"]))
    rows = _ordered(frames.select("media_id", F.col("idx").cast("int"), "p"), "media_id", "idx", "p")
    opened = rows.select("media_id", total.alias("total"), F.explode(raw).alias("r")).where(F.round(F.col("r.e") - F.col("r.s"), 6) >= min_speech)
    padded = opened.select("media_id", F.greatest(F.lit(0.0), F.col("r.s") - pad).alias("s"), F.least("total", F.col("r.e") + pad).alias("e"))
    # padding keeps the order of starts and ends, so neighbours that touch are islands
    w = Window.partitionBy("media_id").orderBy("s")
    new = F.when(F.round(F.col("s") - F.lag("e").over(w), 6) <= 0, 0).otherwise(1)
    numbered = padded.withColumn("new", new).withColumn("region_id", F.sum("new").over(w).cast("int"))
    return numbered.groupBy("media_id", "region_id").agg(F.min("s").alias("start_sec"), F.max("e").alias("end_sec"))


def merge_regions(regions: DataFrame, gap: float = 0.6, most: float = 28.0) -> DataFrame:
    """Regions joined over small gaps while the whole stays within ``most`` seconds."""
    kind = "array<struct<s:double,e:double>>"

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (F.round(r["s"] - last["e"], 6) <= gap) & (F.round(r["e"] - last["s"], 6) <= most)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), r["e"].alias("e"))))).otherwise(F.concat(acc, F.array(r)))

    rows = _ordered(regions.select("media_id", F.col("start_sec").alias("s"), F.col("end_sec").alias("e")), "media_id", "s", "e")
    made = rows.select("media_id", F.posexplode(F.aggregate("rows", F.array().cast(kind), step)).alias("region_id", "r"))
    return made.select("media_id", "region_id", F.col("r.s").alias("start_sec"), F.col("r.e").alias("end_sec"))


def merge_candidates(candidates: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """Candidates (media_id, ord, pts, sources, dhash, distance) closer than the tolerance as one: tags are united, the first
    cut sets the time, the first hash stays, the larger distance counts.  Ties in time go by ``ord``."""
    kind = "array<struct<pts:double,sources:array<string>,dhash:bigint,distance:int>>"

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (F.round(c["pts"] - last["pts"], 6) <= tolerance)
        moves = F.array_contains(c["sources"], "cut") & ~F.array_contains(last["sources"], "cut")
        takes = c["dhash"].isNotNull() & last["dhash"].isNull()
        distance = F.when(takes, c["distance"]).otherwise(last["distance"])
        one = F.struct(
            F.when(moves, c["pts"]).otherwise(last["pts"]).alias("pts"),
            F.array_union(last["sources"], c["sources"]).alias("sources"),
            F.when(takes, c["dhash"]).otherwise(last["dhash"]).alias("dhash"),
            F.when(c["distance"].isNotNull() & distance.isNotNull(), F.greatest(c["distance"], distance)).otherwise(distance).alias("distance"),
        )
        own = F.struct(c["pts"].alias("pts"), c["sources"].alias("sources"), c["dhash"].alias("dhash"), c["distance"].alias("distance"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(own)))

    rows = _ordered(candidates.select("media_id", "pts", F.col("ord").cast("int"), "sources", "dhash", F.col("distance").cast("int")), "media_id", "pts", "ord", "sources", "dhash", "distance")
    made = rows.select("media_id", F.posexplode(F.aggregate("rows", F.array().cast(kind), step)).alias("ord", "c"))
    return made.select("media_id", "ord", "c.*")


def prune(frames: DataFrame, max_frames: int, preserve_floor: bool = False) -> DataFrame:
    """At most ``max_frames`` per medium of (media_id, ord, pts, sources, dhash, distance).

    Candidates of one redundant source go first, least change first; then anchors stay before the
    rest, which is thinned evenly over time.
    """
    media = Window.partitionBy("media_id")
    single = F.size("sources") == 1
    loose = single & (F.array_contains("sources", "hash") | (F.lit(not preserve_floor) & F.array_contains("sources", "floor")))
    order = Window.partitionBy("media_id", "__loose").orderBy(F.coalesce("distance", F.lit(0)), "pts", "ord")
    first = frames.withColumn("__n", F.count(F.lit(1)).over(media)).withColumn("__loose", loose).withColumn("__rank", F.row_number().over(order))
    left = first.where(~(F.col("__loose") & (F.col("__rank") <= F.col("__n") - max_frames))).drop("__n", "__loose", "__rank")

    anchor = F.array_contains("sources", "anchor")
    kinds = Window.partitionBy("media_id", "__anchor")
    second = left.withColumn("__n", F.count(F.lit(1)).over(media)).withColumn("__anchor", anchor).withColumn("__at", F.row_number().over(kinds.orderBy("pts", "ord")) - 1).withColumn("__of", F.count(F.lit(1)).over(kinds))
    room = F.greatest(F.lit(0), F.lit(max_frames) - F.least(F.lit(max_frames), F.col("__n") - F.col("__of")))
    # index i of n is one of floor(k n / room), k < room, when the next multiple of 1 / room reaches it
    step = F.ceil(F.col("__at") * room / F.col("__of"))
    taken = (room > 0) & (step < room) & (F.floor(step * F.col("__of") / room) == F.col("__at"))
    keep = (F.col("__n") <= max_frames) | (F.col("__anchor") & (F.col("__at") < max_frames)) | (~F.col("__anchor") & taken)
    return second.where(keep).drop("__n", "__anchor", "__at", "__of")


def energy_probabilities(levels: DataFrame) -> DataFrame:
    """(media_id, idx, p): loudness (media_id, idx, rms) between the medium's quiet and loud levels, from 0 to 1."""
    level = levels.groupBy("media_id").agg(F.array_sort(F.collect_list("rms")).alias("s"))
    at = lambda q: F.get("s", F.floor(F.size("s") * q).cast("int"))
    spans = level.select("media_id", at(0.2).alias("noise"), at(0.9).alias("loud"))
    joined = levels.join(spans, "media_id")
    return joined.select("media_id", "idx", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("rms") - F.col("noise")) / F.greatest(F.lit(1e-6), F.col("loud") - F.col("noise")))).alias("p"))


def silences(log: DataFrame) -> DataFrame:
    """Silences (media_id, start_sec, end_sec, duration_sec) of a log (media_id, line_no, line); one without an end is dropped."""
    start = F.regexp_extract("line", r"silence_start:\s*([0-9.]+)", 1)
    end = F.regexp_extract("line", r"silence_end:\s*([0-9.]+)\s*\|\s*silence_duration:\s*([0-9.]+)", 1)
    length = F.regexp_extract("line", r"silence_end:\s*([0-9.]+)\s*\|\s*silence_duration:\s*([0-9.]+)", 2)
    marks = log.select("media_id", "line_no", start.alias("s"), end.alias("e"), length.alias("d")).where("s <> '' or e <> ''")
    w = Window.partitionBy("media_id").orderBy("line_no")
    before = F.last(F.when(F.col("s") != "", F.struct("line_no", "s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    used = F.coalesce(F.last(F.when(F.col("e") != "", F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    seen = marks.withColumn("open", before).withColumn("closed", used).where((F.col("e") != "") & F.col("open").isNotNull() & (F.col("open.line_no") > F.col("closed")))
    return seen.select("media_id", F.col("open.s").cast("double").alias("start_sec"), F.col("e").cast("double").alias("end_sec"), F.col("d").cast("double").alias("duration_sec"))


def budget_prefix(rows: DataFrame, cost: Column, budget: int, key: str = "media_id", order: str = "seg_id") -> DataFrame:
    """The first rows of each medium whose costs together stay in the budget; always the first one."""
    w = Window.partitionBy(key).orderBy(order)
    summed = rows.withColumn("__cost", cost).withColumn("__sum", F.sum("__cost").over(w)).withColumn("__at", F.row_number().over(w))
    return summed.where((F.col("__at") == 1) | (F.col("__sum") <= budget)).drop("__cost", "__sum", "__at")


def preview(rows: DataFrame, line: Column, most: int = 700, key: str = "media_id", order: str = "seg_id") -> DataFrame:
    """The first lines of each medium that fit a preview: what is joined so far, and the next line, within ``most`` characters."""
    w = Window.partitionBy(key).orderBy(order)
    summed = rows.withColumn("line", line).withColumn("__sum", F.sum(F.length("line")).over(w)).withColumn("__at", F.row_number().over(w))
    return summed.where(F.col("__sum") + F.greatest(F.col("__at") - 2, F.lit(0)) <= most).drop("__sum", "__at")


def cap_per_group(rows: DataFrame, groups: list[str], order: str, most: int) -> DataFrame:
    """At most so many rows of each group, and ``hidden``: how many of the group there are beyond."""
    w = Window.partitionBy(*groups)
    numbered = rows.withColumn("__at", F.row_number().over(w.orderBy(order))).withColumn("hidden", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - most))
    return numbered.where(F.col("__at") <= most).drop("__at")
