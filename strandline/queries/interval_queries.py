"""Interval algebra and folds over the stand-in media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import times
from strandline.operators import folds, intervals
from strandline.plans import diarize, keyframes, transcript
from strandline.queries.base import FRAMES, PROBS, REG, SEG, TURN, frames, probabilities, query, regions, segments, turns

_CHAIN = f"WITH {SEG}, {REG}, {TURN}"


def _r(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


@query("interval_speech_ratio", f"""{_CHAIN} SELECT seg.media_id, seg.seg_id, round(least(1, coalesce(sum(least(seg.end_sec, reg.end_sec) - greatest(seg.start_sec, reg.start_sec)) FILTER (reg.media_id IS NOT NULL), 0) / greatest(0.01, any_value(seg.end_sec) - any_value(seg.start_sec))), 4) AS ratio
  FROM seg LEFT JOIN reg ON reg.media_id = seg.media_id AND seg.start_sec < reg.end_sec AND reg.start_sec < seg.end_sec GROUP BY ALL""")  # fmt: skip
def speech_ratio(spark: SparkSession, d: str) -> DataFrame:
    return intervals.speech_ratio(segments(spark, d), regions(spark, d)).select("media_id", "seg_id", *_r("ratio"))


@query("interval_best_speaker", f"""{_CHAIN}, o AS (SELECT seg.media_id, seg_id, t.speaker, row_number() OVER (PARTITION BY seg.media_id, seg_id ORDER BY round(least(seg.end_sec, t.end_sec) - greatest(seg.start_sec, t.start_sec), 6) DESC, turn_no) AS r
  FROM seg JOIN turns t ON t.media_id = seg.media_id AND seg.start_sec < t.end_sec AND t.start_sec < seg.end_sec)
  SELECT seg.media_id, seg.seg_id, o.speaker FROM seg LEFT JOIN o ON o.media_id = seg.media_id AND o.seg_id = seg.seg_id AND r = 1""")  # fmt: skip
def best_speaker(spark: SparkSession, d: str) -> DataFrame:
    return intervals.best_speaker(segments(spark, d), turns(spark, d))


@query("interval_overlap_pairs", f"""{_CHAIN} SELECT seg.media_id, seg_id, turn_no, round(least(seg.end_sec, t.end_sec) - greatest(seg.start_sec, t.start_sec), 4) AS shared
  FROM seg JOIN turns t ON t.media_id = seg.media_id AND seg.start_sec < t.end_sec AND t.start_sec < seg.end_sec""")  # fmt: skip
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("media_id", "turn_no", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"))
    pairs = intervals.overlap_join(segments(spark, d), t, "media_id")
    return pairs.select("media_id", "seg_id", "turn_no", F.round(intervals.overlap(), 4).alias("shared"))


@query("interval_nearest_turn", f"""{_CHAIN}, known AS (SELECT *, CAST(turn_no % 3 AS INTEGER) AS label FROM turns WHERE turn_no % 4 = 0),
  near AS (SELECT s.media_id, s.turn_no, k.label, row_number() OVER (PARTITION BY s.media_id, s.turn_no ORDER BY round(abs(k.start_sec - s.start_sec), 6), k.turn_no) AS r FROM turns s LEFT JOIN known k USING (media_id) WHERE s.turn_no % 4 <> 0)
  SELECT media_id, turn_no, coalesce(label, 0) AS label FROM near WHERE r = 1""")  # fmt: skip
def nearest_turn(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("label", F.col("turn_no") % 3)
    return intervals.nearest_label(t.where("turn_no % 4 <> 0"), t.where("turn_no % 4 = 0"))


_PIECES = "pieces AS (SELECT media_id, turn_no AS seg_no, start_sec, end_sec + CASE WHEN turn_no % 2 = 0 THEN 0.4 ELSE 0 END AS end_sec, CAST(turn_no // 3 % 2 AS INTEGER) AS local, confidence FROM turns)"


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    end = F.col("end_sec") + F.when(F.col("turn_no") % 2 == 0, 0.4).otherwise(0.0)
    return turns(spark, d).select("media_id", F.col("turn_no").alias("seg_no"), "start_sec", end.alias("end_sec"), F.floor(F.col("turn_no") / 3).cast("int").alias("l"), "confidence").withColumn("local", F.col("l") % 2).drop("l")


def _islands(source: str, label: str, gap: float, order: str, conf: str, least: float) -> str:
    return f"""n AS (SELECT *, CASE WHEN lag({label}) OVER w = {label} AND round(start_sec - lag(end_sec) OVER w, 6) < {gap} THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY media_id ORDER BY start_sec, {order})),
    g AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY start_sec, {order}) AS island FROM n)
    SELECT media_id, CAST(island AS BIGINT) AS turn_no, round(min(start_sec), 4) AS start_sec, round(arg_max(end_sec, (start_sec, {order})), 4) AS end_sec, arg_min({label}, (start_sec, {order})) AS {label}, round({conf}, 4) AS confidence
    FROM g GROUP BY media_id, island HAVING round(arg_max(end_sec, (start_sec, {order})) - min(start_sec), 6) >= {least}"""


@query("interval_speaker_pieces", f"{_CHAIN}, {_PIECES}, {_islands('pieces', 'local', 0.4, 'seg_no', 'max(confidence)', 0.6)}")
def speaker_pieces(spark: SparkSession, d: str) -> DataFrame:
    return intervals.to_turns(_pieces(spark, d)).select("media_id", F.col("turn_no").cast("bigint").alias("turn_no"), *_r("start_sec", "end_sec"), "local", *_r("confidence"))


@query("interval_speaker_merge", f"{_CHAIN}, {_PIECES}, named AS (SELECT media_id, seg_no AS turn_no, start_sec, end_sec, 'S' || local AS speaker, confidence FROM pieces), {_islands('named', 'speaker', 0.6, 'turn_no', 'arg_min(confidence, (start_sec, turn_no))', -1)}")
def speaker_merge(spark: SparkSession, d: str) -> DataFrame:
    named = _pieces(spark, d).select("media_id", F.col("seg_no").alias("turn_no"), "start_sec", "end_sec", F.format_string("S%d", "local").alias("speaker"), "confidence")
    return intervals.merge_speaker(named).select("media_id", F.col("turn_no").cast("bigint").alias("turn_no"), *_r("start_sec", "end_sec"), "speaker", *_r("confidence"))


@query("interval_split_windows", f"""{_CHAIN}, w AS (SELECT media_id, seg_id, start_sec, end_sec, CAST(greatest(0, ceil((round(end_sec - start_sec, 6) - 28) / 26)) AS INTEGER) AS k FROM seg),
  p AS (SELECT *, CAST(unnest(range(0, k + 1)) AS INTEGER) AS piece FROM w)
  SELECT media_id, seg_id, piece, round(start_sec + piece * 26, 4) AS start_sec, round(CASE WHEN piece = k THEN end_sec ELSE start_sec + piece * 26 + 28 END, 4) AS end_sec FROM p""")  # fmt: skip
def split_windows(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("media_id", "seg_id", "start_sec", "end_sec")
    return intervals.split_long(s).select("media_id", "seg_id", "piece", *_r("start_sec", "end_sec"))


_MERGED = """ro AS (SELECT media_id, start_sec AS s, end_sec AS e, row_number() OVER (PARTITION BY media_id ORDER BY start_sec, end_sec) AS i FROM {0}),
  step AS (SELECT media_id, i, s, e, 0 AS region_id FROM ro WHERE i = 1
    UNION ALL SELECT ro.media_id, ro.i, CASE WHEN {1} THEN step.s ELSE ro.s END, ro.e, step.region_id + CASE WHEN {1} THEN 0 ELSE 1 END FROM step JOIN ro ON ro.media_id = step.media_id AND ro.i = step.i + 1),
  mer AS (SELECT media_id, CAST(region_id AS INTEGER) AS region_id, min(s) AS start_sec, arg_max(e, i) AS end_sec FROM step GROUP BY ALL)""".format("seg", "round(ro.s - step.e, 6) <= 0.6 AND round(ro.e - step.s, 6) <= 28")


@query("fold_merge_windows", f"WITH RECURSIVE {SEG}, {_MERGED} SELECT media_id, region_id, round(start_sec, 4) AS start_sec, round(end_sec, 4) AS end_sec FROM mer")
def merge_windows(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_regions(segments(spark, d)).select("media_id", "region_id", *_r("start_sec", "end_sec"))


@query("plan_transcript_windows", f"""WITH RECURSIVE {SEG}, {_MERGED}, w AS (SELECT *, CAST(greatest(0, ceil((round(end_sec - start_sec, 6) - 28) / 26)) AS INTEGER) AS k FROM mer), p AS (SELECT *, CAST(unnest(range(0, k + 1)) AS INTEGER) AS piece FROM w)
  SELECT media_id, region_id, piece, round(start_sec + piece * 26, 4) AS start_sec, round(CASE WHEN piece = k THEN end_sec ELSE start_sec + piece * 26 + 28 END, 4) AS end_sec FROM p""")  # fmt: skip
def plan_windows(spark: SparkSession, d: str) -> DataFrame:
    return transcript.plan_windows(segments(spark, d)).select("media_id", "region_id", "piece", *_r("start_sec", "end_sec"))


_KEPT = """kept AS (SELECT media_id, idx, pts, dhash, dhash AS last, 64 AS distance, TRUE AS keep FROM fr WHERE idx = 0
    UNION ALL SELECT fr.media_id, fr.idx, fr.pts, fr.dhash, CASE WHEN bit_count(xor(fr.dhash, kept.last)) >= 6 THEN fr.dhash ELSE kept.last END, CAST(bit_count(xor(fr.dhash, kept.last)) AS INTEGER), bit_count(xor(fr.dhash, kept.last)) >= 6
    FROM kept JOIN fr ON fr.media_id = kept.media_id AND fr.idx = kept.idx + 1)"""


@query("fold_hash_dedup", f"WITH RECURSIVE {FRAMES}, {_KEPT} SELECT media_id, idx, pts, dhash, distance FROM kept WHERE keep")
def hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return folds.dedup_hashes(frames(spark, d))


@query("fold_speech_regions", f"""WITH RECURSIVE {FRAMES}, {PROBS},
  st AS (SELECT media_id, -1 AS idx, FALSE AS on_, 0.0::DOUBLE AS start, -1.0::DOUBLE AS quiet, NULL::DOUBLE AS s, NULL::DOUBLE AS e FROM (SELECT DISTINCT media_id FROM probs)
    UNION ALL SELECT st.media_id, pr.idx,
      CASE WHEN on_ THEN NOT (p < 0.35 AND round(pr.idx * 0.1 - CASE WHEN quiet < 0 THEN pr.idx * 0.1 ELSE quiet END, 6) >= 0.35) ELSE p >= 0.5 END,
      CASE WHEN NOT on_ AND p >= 0.5 THEN pr.idx * 0.1::DOUBLE ELSE start END,
      CASE WHEN on_ AND p < 0.35 AND NOT round(pr.idx * 0.1 - CASE WHEN quiet < 0 THEN pr.idx * 0.1 ELSE quiet END, 6) >= 0.35 THEN CASE WHEN quiet < 0 THEN pr.idx * 0.1::DOUBLE ELSE quiet END ELSE -1 END,
      CASE WHEN on_ AND p < 0.35 AND round(pr.idx * 0.1 - CASE WHEN quiet < 0 THEN pr.idx * 0.1 ELSE quiet END, 6) >= 0.35 THEN start END,
      CASE WHEN on_ AND p < 0.35 AND round(pr.idx * 0.1 - CASE WHEN quiet < 0 THEN pr.idx * 0.1 ELSE quiet END, 6) >= 0.35 THEN CASE WHEN quiet < 0 THEN pr.idx * 0.1::DOUBLE ELSE quiet END END
    FROM st JOIN probs pr ON pr.media_id = st.media_id AND pr.idx = st.idx + 1),
  tot AS (SELECT media_id, count(*) AS n FROM probs GROUP BY media_id),
  raw AS (SELECT media_id, s, e FROM st WHERE s IS NOT NULL UNION ALL SELECT st.media_id, start, n * 0.1::DOUBLE FROM st JOIN tot ON tot.media_id = st.media_id AND idx = n - 1 WHERE on_),
  pad AS (SELECT raw.media_id, greatest(0, s - 0.15) AS s, least(n * 0.1, e + 0.15) AS e FROM raw JOIN tot USING (media_id) WHERE round(e - s, 6) >= 0.25),
  isl AS (SELECT *, CASE WHEN round(s - lag(e) OVER (PARTITION BY media_id ORDER BY s), 6) <= 0 THEN 0 ELSE 1 END AS new FROM pad),
  num AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY s) AS region_id FROM isl)
  SELECT media_id, CAST(region_id AS INTEGER) AS region_id, round(min(s), 4) AS start_sec, round(max(e), 4) AS end_sec FROM num GROUP BY ALL""")  # fmt: skip
def speech_regions(spark: SparkSession, d: str) -> DataFrame:
    return folds.speech_regions(probabilities(spark, d), frame_sec=0.1).select("media_id", "region_id", *_r("start_sec", "end_sec"))


@query("plan_speech_summary", f"WITH {SEG}, {REG} SELECT media_id, count(*) AS regions, round(sum(end_sec - start_sec), 4) AS speech_sec FROM reg GROUP BY media_id")
def speech_summary(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d).groupBy("media_id").agg(F.count(F.lit(1)).alias("regions"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 4).alias("speech_sec"))


_CAND = """cand AS (SELECT media_id, idx * 0.5::DOUBLE + CASE WHEN event_id % 3 = 0 THEN 0.45::DOUBLE ELSE 0 END AS pts, CAST(row_number() OVER (PARTITION BY media_id ORDER BY idx) AS INTEGER) AS i, CASE idx % 3 WHEN 0 THEN ['hash'] WHEN 1 THEN ['cut'] ELSE ['anchor'] END AS sources,
    CASE WHEN idx % 3 = 0 THEN dhash END AS dhash, CASE WHEN idx % 3 = 0 THEN CAST(event_id % 60 AS INTEGER) END AS distance FROM fr)"""
_JOINED = "round(c.pts - m.pts, 6) <= 0.75"


def _merge_cand(cand: str, m: str, mc: str) -> str:
    """Candidates (i, pts, sources, dhash, distance) of a table, merged step by step, and what became of them."""
    return f"""{m} AS (SELECT media_id, i, 0 AS ord, pts, sources, dhash, distance FROM {cand} WHERE i = 1
    UNION ALL SELECT c.media_id, c.i, m.ord + CASE WHEN {_JOINED} THEN 0 ELSE 1 END,
      CASE WHEN {_JOINED} AND NOT (list_contains(c.sources, 'cut') AND NOT list_contains(m.sources, 'cut')) THEN m.pts ELSE c.pts END,
      CASE WHEN {_JOINED} THEN list_sort(list_distinct(list_concat(m.sources, c.sources))) ELSE c.sources END,
      CASE WHEN {_JOINED} AND m.dhash IS NOT NULL THEN m.dhash ELSE c.dhash END,
      CASE WHEN NOT {_JOINED} THEN c.distance WHEN c.distance IS NOT NULL AND (m.distance IS NOT NULL) THEN greatest(c.distance, m.distance) WHEN c.dhash IS NOT NULL AND m.dhash IS NULL THEN c.distance ELSE m.distance END
    FROM {m} m JOIN {cand} c ON c.media_id = m.media_id AND c.i = m.i + 1),
  {mc} AS (SELECT media_id, CAST(ord AS INTEGER) AS ord, arg_max(pts, i) AS pts, arg_max(sources, i) AS sources, max(dhash) AS dhash, max(distance) AS distance FROM {m} GROUP BY media_id, ord)"""


_MERGE_CAND = _merge_cand("cand", "m", "mc")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every frame is a candidate, each third late by nearly the space between two."""
    k = F.col("idx") % 3
    f = frames(spark, d).withColumn("pts", F.col("idx") * 0.5 + F.when(F.col("event_id") % 3 == 0, 0.45).otherwise(0.0))
    tag = F.when(k == 0, F.array(F.lit("hash"))).when(k == 1, F.array(F.lit("cut"))).otherwise(F.array(F.lit("anchor")))
    return f.select("media_id", "pts", F.col("idx").alias("ord"), tag.alias("sources"), F.when(k == 0, F.col("dhash")).alias("dhash"), F.when(k == 0, (F.col("event_id") % 60).cast("int")).alias("distance"))


@query("fold_merge_candidates", f"WITH RECURSIVE {FRAMES}, {_CAND}, {_MERGE_CAND} SELECT media_id, ord, round(pts, 4) AS pts, array_to_string(sources, '+') AS sources, dhash, distance FROM mc")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    made = folds.merge_candidates(_candidates(spark, d))
    return made.select("media_id", "ord", *_r("pts"), F.array_join(F.array_sort("sources"), "+").alias("sources"), "dhash", "distance")


_SPREAD = "spread AS (SELECT media_id, idx * 6.0::DOUBLE + event_id % 11 AS pts FROM fr)"


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """All frames, at uneven distances."""
    return frames(spark, d).withColumn("pts", F.col("idx") * 6.0 + F.col("event_id") % 11)


@query("fold_floor_points", f"""WITH {FRAMES}, {_SPREAD}, pt AS (SELECT media_id, pts, max(pts) OVER (PARTITION BY media_id) + 50 AS to_sec FROM spread),
  gap AS (SELECT media_id, coalesce(lag(pts) OVER (PARTITION BY media_id ORDER BY pts), 0) AS a, pts AS b FROM pt UNION ALL SELECT media_id, max(pts), any_value(to_sec) FROM pt GROUP BY media_id),
  n AS (SELECT *, CAST(greatest(0, ceil(round((b - a) / 4, 6)) - 1) AS INTEGER) AS n FROM gap) SELECT media_id, a + k * 4 AS pts FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n WHERE n > 0)""")  # fmt: skip
def floor_points(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = _spread(spark, d).withColumn("to_sec", F.max("pts").over(Window.partitionBy("media_id")) + 50)
    return intervals.floor_points(p, 0.0, 4.0)


@query("interval_max_gap", f"WITH {FRAMES}, {_SPREAD}, g AS (SELECT media_id, pts - lag(pts) OVER (PARTITION BY media_id ORDER BY pts) AS g FROM spread) SELECT media_id, max(g) AS max_gap FROM g GROUP BY media_id")
def max_gap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.max_gap(_spread(spark, d))


def _prune_sql(most: int, loose: str, mc: str = "mc") -> str:
    return f"""a AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n, {loose} AS loose FROM {mc}),
  b AS (SELECT *, row_number() OVER (PARTITION BY media_id, loose ORDER BY coalesce(distance, 0), pts, ord) AS r FROM a),
  c AS (SELECT media_id, ord, pts, sources, dhash, distance FROM b WHERE NOT (loose AND r <= n - {most})),
  e AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n, list_contains(sources, 'anchor') AS anchor FROM c),
  f AS (SELECT *, row_number() OVER (PARTITION BY media_id, anchor ORDER BY pts, ord) - 1 AS pos, count(*) OVER (PARTITION BY media_id, anchor) AS cnt FROM e),
  g AS (SELECT *, {most} - least({most}, n - cnt) AS room FROM f),
  idx AS (SELECT DISTINCT media_id, floor(k * cnt / room) AS keep_at FROM (SELECT DISTINCT media_id, cnt, room, unnest(range(0, room)) AS k FROM g WHERE NOT anchor AND room > 0))
  SELECT media_id, ord, pts, sources, dhash, distance FROM g LEFT JOIN idx USING (media_id)
  WHERE (n <= {most}) OR (anchor AND pos < {most}) OR (NOT anchor AND keep_at = pos) GROUP BY ALL"""


_LOOSE = "len(sources) = 1 AND (list_contains(sources, 'hash') OR list_contains(sources, 'floor'))"


@query("fold_prune_frames", f"WITH RECURSIVE {FRAMES}, {_CAND}, {_MERGE_CAND}, left_over AS (WITH {_prune_sql(12, _LOOSE)}) SELECT media_id, ord, round(pts, 4) AS pts, array_to_string(sources, '+') AS sources FROM left_over")
def prune_frames(spark: SparkSession, d: str) -> DataFrame:
    made = folds.prune(folds.merge_candidates(_candidates(spark, d)), 12)
    return made.select("media_id", "ord", *_r("pts"), F.array_join(F.array_sort("sources"), "+").alias("sources"))


@query("plan_key_frames", f"""WITH RECURSIVE {FRAMES}, {_KEPT}, ends AS (SELECT media_id, max(pts) + 1 AS to_sec FROM fr GROUP BY media_id),
  every AS (SELECT media_id, pts, 0 AS kind, ['hash'] AS sources, dhash, distance FROM kept WHERE keep
    UNION ALL SELECT media_id, least(pts + 0.4::DOUBLE, to_sec - 0.25::DOUBLE), 1, ['cut'], NULL, NULL FROM fr JOIN ends USING (media_id) WHERE event_type = 'click' AND event_id % 7 = 0
    UNION ALL SELECT media_id, pts, 2, ['anchor'], NULL, NULL FROM fr JOIN ends USING (media_id) WHERE event_id % 101 = 0 AND pts BETWEEN 0 AND to_sec),
  c1 AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pts, kind) AS i FROM every), {_merge_cand('c1', 'm1', 'mc1')},
  gaps AS (SELECT media_id, coalesce(lag(pts) OVER (PARTITION BY media_id ORDER BY pts), 0) AS a, pts AS b FROM mc1 UNION ALL SELECT media_id, max(pts), any_value(to_sec) FROM mc1 JOIN ends USING (media_id) GROUP BY media_id),
  holes AS (SELECT *, CAST(greatest(0, ceil(round((b - a) / 4, 6)) - 1) AS INTEGER) AS n FROM gaps), floors AS (SELECT media_id, a + k * 4 AS pts FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM holes WHERE n > 0)),
  c2 AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pts, kind) AS i FROM (SELECT media_id, pts, ord AS kind, sources, dhash, distance FROM mc1 UNION ALL SELECT media_id, pts, 1 << 30, ['floor'], NULL, NULL FROM floors)), {_merge_cand('c2', 'm2', 'mc2')},
  left_over AS (WITH {_prune_sql(40, _LOOSE, 'mc2')}), numbered AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pts, ord) AS i FROM left_over)
  SELECT media_id, CAST(i AS INTEGER) AS index, round(pts, 2) AS pts, array_to_string(list_sort(sources), '+') AS sources, dhash, distance, (i - 1) // 9 + 1 AS sheet, CAST((i - 1) % 9 + 1 AS INTEGER) AS tile FROM numbered""")  # fmt: skip
def key_frames(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    ends = f.groupBy("media_id").agg((F.max("pts") + 1).alias("to_sec"))
    made = keyframes.select_frames(f, f.where("event_type = 'click' and event_id % 7 = 0").select("media_id", "pts"), ends, f.where("event_id % 101 = 0").select("media_id", "pts"), max_frames=40, floor_sec=4.0)
    return made.withColumn("sources", F.array_join(F.array_sort("sources"), "+"))


@query("plan_contact_sheets", f"""WITH RECURSIVE {FRAMES}, {_KEPT}, n AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS i FROM kept WHERE keep)
  SELECT media_id, CAST((i - 1) // 9 + 1 AS BIGINT) AS sheet, string_agg(i, ',' ORDER BY i) AS frames, CAST(max((i - 1) % 9 % 3 * 484) AS BIGINT) AS last_left, CAST(max((i - 1) % 9 // 3 * 274) AS BIGINT) AS last_top FROM n GROUP BY ALL""")  # fmt: skip
def contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from strandline.functions import vision

    n = folds.dedup_hashes(frames(spark, d)).withColumn("i", F.row_number().over(Window.partitionBy("media_id").orderBy("idx")))
    p = n.withColumn("p", vision.sheet_place(F.col("i")))
    return p.groupBy("media_id", F.col("p.sheet").cast("bigint").alias("sheet")).agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("frames"), F.max(F.col("p.left")).cast("bigint").alias("last_left"), F.max(F.col("p.top")).cast("bigint").alias("last_top"))


@query("plan_frame_files", f"""WITH RECURSIVE {FRAMES}, {_KEPT}, n AS (SELECT media_id, pts, CAST(row_number() OVER (PARTITION BY media_id ORDER BY idx) AS INTEGER) AS i FROM kept WHERE keep), s AS (SELECT *, (i - 1) // 9 + 1 AS sheet FROM n)
  SELECT media_id, i AS index, pts, 'frames/' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '.jpg' AS file, 'sheets/' || CASE WHEN sheet < 100 THEN lpad(CAST(sheet AS VARCHAR), 2, '0') ELSE CAST(sheet AS VARCHAR) END || '.jpg' AS sheet_file FROM s""")  # fmt: skip
def frame_files(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = folds.dedup_hashes(frames(spark, d)).withColumn("index", F.row_number().over(Window.partitionBy("media_id").orderBy("idx")))
    return keyframes.files(n).select("media_id", "index", "pts", "file", "sheet_file")


@query("media_sample_times", f"WITH {SEG}, e AS (SELECT media_id, max(end_sec) AS to_sec FROM seg GROUP BY media_id) SELECT media_id, CAST(i AS INTEGER) AS idx, 1.5 + i / 2 AS pts FROM (SELECT media_id, to_sec, unnest(range(0, CAST(greatest(0, ceil(round((to_sec - 1.5) * 2, 6))) AS BIGINT))) AS i FROM e)")
def sample_times(spark: SparkSession, d: str) -> DataFrame:
    from strandline.sources import media as src

    return src.sample_times(segments(spark, d).groupBy("media_id").agg(F.max("end_sec").alias("to_sec")), 2.0, 1.5)


@query("fold_energy_probabilities", f"""WITH {FRAMES}, s AS (SELECT media_id, list(value ORDER BY value) AS l FROM fr GROUP BY media_id), q AS (SELECT media_id, l[CAST(floor(len(l) * 0.2) AS INTEGER) + 1] AS noise, l[CAST(floor(len(l) * 0.9) AS INTEGER) + 1] AS loud FROM s)
  SELECT media_id, idx, round(least(1, greatest(0, (value - noise) / greatest(1e-6, loud - noise))), 6) AS p FROM fr JOIN q USING (media_id)""")  # fmt: skip
def energy(spark: SparkSession, d: str) -> DataFrame:
    levels = frames(spark, d).select("media_id", "idx", F.col("value").alias("rms"))
    return folds.energy_probabilities(levels).select("media_id", "idx", F.round("p", 6).alias("p"))


@query("fold_silences", f"""WITH {FRAMES}, ev AS (SELECT media_id, idx, event_id % 3 AS k FROM fr WHERE event_id % 3 < 2),
  nx AS (SELECT media_id, idx, k, lag(k) OVER w AS pk, lag(idx) OVER w AS pi FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY idx))
  SELECT media_id, pi + 0.5 AS start_sec, idx + 0.25 AS end_sec, round(idx - pi - 0.25, 4) AS duration_sec FROM nx WHERE k = 1 AND pk = 0""")  # fmt: skip
def silence_log(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame says a silence starts, the next that it ended; the durations are those said."""
    from pyspark.sql import Window

    k = F.col("event_id") % 3
    ev = frames(spark, d).where("event_id % 3 < 2")
    before = F.lag("idx").over(Window.partitionBy("media_id").orderBy("idx"))
    start = F.format_string("[silencedetect] silence_start: %s", (F.col("idx") + 0.5).cast("string"))
    end = F.format_string("[silencedetect] silence_end: %s | silence_duration: %s", (F.col("idx") + 0.25).cast("string"), F.coalesce(F.round(F.col("idx") - before - 0.25, 4), F.lit(0.0)).cast("string"))
    return folds.silences(ev.select("media_id", F.col("idx").alias("line_no"), F.when(k == 0, start).otherwise(end).alias("line")))


@query("fold_budget_prefix", f"WITH {SEG}, c AS (SELECT media_id, seg_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS cost FROM seg), s AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)) SELECT media_id, seg_id, cost FROM s WHERE r = 1 OR used <= 120")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    from strandline.functions import text as txt

    s = segments(spark, d).select("media_id", "seg_id", txt.estimate_tokens(F.col("text")).alias("cost"))
    return folds.budget_prefix(s, F.col("cost"), 120)


@query("fold_preview", f"WITH {SEG}, l AS (SELECT media_id, seg_id, '[' || speaker || '] ' || text AS line FROM seg), s AS (SELECT *, sum(length(line)) OVER w AS used, row_number() OVER w AS r FROM l WINDOW w AS (PARTITION BY media_id ORDER BY seg_id)) SELECT media_id, seg_id, line FROM s WHERE used + greatest(r - 2, 0) <= 700")
def previews(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), "speaker", F.lit("] "), "text")
    return folds.preview(segments(spark, d), line).select("media_id", "seg_id", "line")


@query("fold_cap_per_group", f"WITH {SEG}, n AS (SELECT media_id, speaker, seg_id, row_number() OVER (PARTITION BY media_id, speaker ORDER BY seg_id) AS r, count(*) OVER (PARTITION BY media_id, speaker) AS c FROM seg) SELECT media_id, speaker, seg_id, greatest(0, c - 2) AS hidden FROM n WHERE r <= 2")
def cap_groups(spark: SparkSession, d: str) -> DataFrame:
    return folds.cap_per_group(segments(spark, d), ["media_id", "speaker"], "seg_id", 2).select("media_id", "speaker", "seg_id", "hidden")


@query("interval_embedding_crop", f"""{_CHAIN}, l AS (SELECT *, least(8, end_sec - start_sec) AS len, count(*) FILTER (end_sec - start_sec >= 4.3) OVER (PARTITION BY media_id) AS n FROM turns)
  SELECT media_id, turn_no, CAST(greatest(0, floor(((start_sec + end_sec) / 2 - len / 2) * 16000)) AS BIGINT) AS first_sample, CAST(greatest(0, floor(((start_sec + end_sec) / 2 - len / 2) * 16000)) + floor(len * 16000) AS BIGINT) AS last_sample, end_sec - start_sec >= 4.3 OR n < 2 AS embed FROM l""")  # fmt: skip
def embedding_crop(spark: SparkSession, d: str) -> DataFrame:
    t = intervals.embeddable(intervals.embedding_crop(turns(spark, d)), 4.3)
    return t.select("media_id", "turn_no", F.col("first_sample").cast("bigint"), F.col("last_sample").cast("bigint"), "embed")


@query("interval_slabs", f"{_CHAIN} SELECT media_id, turn_no, CAST(floor(start_sec / 60) AS INTEGER) AS slab, CAST(turn_no % 3 + 100 * floor(start_sec / 60) AS INTEGER) AS local FROM turns")
def slabs(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("local", F.col("turn_no") % 3)
    return intervals.slabs(t).select("media_id", "turn_no", "slab", "local")


@query("interval_time_window", f"{_CHAIN} SELECT media_id, seg_id FROM seg WHERE start_sec >= 20 AND start_sec <= 90")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where(times.in_window(F.col("start_sec"), 20.0, 90.0)).select("media_id", "seg_id")


@query("plan_speakers", f"""{_CHAIN}, l AS (SELECT *, round(end_sec - start_sec, 6) AS len FROM turns)
  SELECT media_id, speaker, round(sum(len), 1) AS talk_sec, count(*) AS turns, arg_max(start_sec, (len, -turn_no)) AS clip_start, least(8, max(len)) AS clip_sec FROM l GROUP BY media_id, speaker""")  # fmt: skip
def speakers(spark: SparkSession, d: str) -> DataFrame:
    return diarize.speakers(turns(spark, d))


@query("plan_diarize")
def diarized(spark: SparkSession, d: str) -> DataFrame:
    """Local pieces are those of the stand-in turns; a turn's voice is a vector that its medium and number pick of all."""
    from strandline.queries.base import table

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
    size = (v.agg(F.max("n")).first()[0] or 0) + 1
    pieces = _pieces(spark, d)
    made = intervals.to_turns(intervals.slabs(pieces)).select("media_id", "turn_no")
    picked = made.withColumn("n", F.pmod(F.col("media_id").cast("long") * 131 + F.col("turn_no") * 17, F.lit(size)))
    voices = picked.join(v, "n").select("media_id", "turn_no", "embedding")
    return diarize.speaker_turns(pieces, voices, threshold=0.1, most=4)
