"""Filters, secrets, reviews, jobs, sources and vision over the stand-in media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import addresses, media, vision
from strandline.functions import text as txt
from strandline.operators import clustering, filters, jobs, secrets
from strandline.plans import review, screen, transcript
from strandline.queries import base
from strandline.queries.base import JOBS, NOW, REG, SEG, TURN, query, regions, segments, table, turns
from strandline.sources import media as src
from strandline.sources import sinks, state

_PHRASES = ", ".join("'" + filters.normalised(p).replace("'", "''") + "'" for p in filters.PHRASES)
_RATIO = "rt AS (SELECT seg.*, greatest(0.1, round(seg.end_sec - seg.start_sec, 6)) AS duration, least(1, coalesce(o.s, 0) / greatest(0.01, seg.end_sec - seg.start_sec)) AS ratio FROM seg LEFT JOIN (SELECT seg.media_id, seg.seg_id, sum(least(seg.end_sec, reg.end_sec) - greatest(seg.start_sec, reg.start_sec)) AS s FROM seg JOIN reg ON reg.media_id = seg.media_id AND seg.start_sec < reg.end_sec AND reg.start_sec < seg.end_sec GROUP BY ALL) o USING (media_id, seg_id))"
#: The loop rule: of all places (run length n, first word i) whose run is said three times, the first; ``reps`` is how often it is said.
_LOOP = r"""lw AS (SELECT media_id, seg_id, regexp_split_to_array(trim(text), '\s+') AS w FROM rt),
  lb AS (SELECT *, list_transform(w, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g'))) AS b FROM lw WHERE len(w) >= 9),
  lp AS (SELECT media_id, seg_id, w, b, n, unnest(range(1, len(w) - 3 * n + 2)) AS i FROM (SELECT *, unnest([3, 4, 5, 6]) AS n FROM lb) WHERE len(w) >= 3 * n),
  lf AS (SELECT media_id, seg_id, arg_min({'n': n, 'i': i}, n * 1000000 + i) AS fst, any_value(w) AS w, any_value(b) AS b FROM lp WHERE b[i:i + n - 1] = b[i + n:i + 2 * n - 1] AND b[i:i + n - 1] = b[i + 2 * n:i + 3 * n - 1] GROUP BY media_id, seg_id),
  lr AS (SELECT *, 1 + coalesce(list_min(list_filter(range(1, len(w) + 1), lambda r: b[fst.i + r * fst.n:fst.i + (r + 1) * fst.n - 1] <> b[fst.i:fst.i + fst.n - 1])) - 1, 0) AS reps FROM lf),
  lt AS (SELECT media_id, seg_id, array_to_string(list_concat(w[1:fst.i + fst.n - 1], w[fst.i + reps * fst.n:]), ' ') AS said FROM lr),
  rs AS (SELECT rt.* EXCLUDE (text), rt.text AS heard, coalesce(said, trim(text)) AS text, said IS NOT NULL AS looped FROM rt LEFT JOIN lt USING (media_id, seg_id))"""
_FILTERED = rf"""{_LOOP}, fl AS (SELECT *, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS words, trim(regexp_replace(regexp_replace(lower(heard), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g')) IN ({_PHRASES}) AS known FROM rs),
  fg AS (SELECT *, list_filter([CASE WHEN known THEN 'blocklist' END, CASE WHEN looped THEN 'repetition_loop' END, CASE WHEN ratio < 0.15 AND duration >= 1 THEN 'no_speech' END, CASE WHEN words / greatest(0.5, duration) > 8 AND words >= 8 THEN 'too_fast' END], lambda x: x IS NOT NULL) AS flags FROM fl),
  ok AS (SELECT *, round(0.55 * least(1, ratio / 0.6) + 0.3 * CASE WHEN words / duration BETWEEN 0.8 AND 5 THEN 1 WHEN words / duration < 0.8 THEN 0.75 ELSE 0.5 END + 0.15 * CASE WHEN len(flags) > 0 THEN 0.4 ELSE 1 END, 2) AS confidence FROM fg WHERE NOT list_has_any(flags, ['blocklist', 'no_speech']))"""


@query("filter_segments", f"WITH {SEG}, {REG}, {_RATIO}, {_FILTERED} SELECT media_id, seg_id, array_to_string(flags, '+') AS flags FROM fg")
def segment_flags(spark: SparkSession, d: str) -> DataFrame:
    from strandline.operators import intervals

    s = segments(spark, d)
    known = s.join(intervals.speech_ratio(s, regions(spark, d)), ["media_id", "seg_id"]).withColumn("duration", F.greatest(F.lit(0.1), F.round(F.col("end_sec") - F.col("start_sec"), 6)))
    return filters.filter_segments(known, filters.blocklist(spark)).select("media_id", "seg_id", F.array_join("flags", "+").alias("flags"))


def _finished(spark: SparkSession, d: str) -> DataFrame:
    return transcript.finish_segments(segments(spark, d), regions(spark, d), filters.blocklist(spark))


@query("plan_transcript_stats", rf"WITH {SEG}, {REG}, {_RATIO}, {_FILTERED}, n AS (SELECT media_id, count(*) AS n FROM seg GROUP BY media_id), k AS (SELECT media_id, count(*) AS c, sum(len(regexp_split_to_array(trim(text), '\s+'))) AS w FROM ok GROUP BY media_id) SELECT media_id, coalesce(c, 0) AS segment_count, n - coalesce(c, 0) AS filtered_count, CAST(coalesce(w, 0) AS BIGINT) AS word_count FROM n LEFT JOIN k USING (media_id)")
def transcript_stats(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return transcript.stats(s, _finished(spark, d)).drop("replacements")


@query("plan_transcript_loops", f"WITH {SEG}, {REG}, {_RATIO}, {_FILTERED} SELECT media_id, seg_id, round(start_sec, 2) AS start_sec, round(end_sec, 2) AS end_sec, text, confidence, array_to_string(flags, '+') AS flags FROM ok")
def transcript_loops(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, d).select("media_id", "seg_id", "start_sec", "end_sec", "text", "confidence", F.array_join("flags", "+").alias("flags"))


def _vote(lang: str) -> str:
    return " + ".join(f"(length(t) - length(replace(t, ' {w} ', ''))) // {len(w) + 2}" for w in txt.LANGUAGE_VOTES[lang])


@query("plan_transcript_language", f"""WITH j AS (SELECT CAST(conv_id AS VARCHAR) AS media_id, ' ' || lower(string_agg(text, ' ' ORDER BY turn)) || ' ' AS t FROM conversations GROUP BY conv_id), v AS (SELECT media_id, {_vote('pt')} AS pt, {_vote('en')} AS en, {_vote('es')} AS es FROM j)
  SELECT media_id, CASE WHEN greatest(pt, en, es) < 3 THEN 'auto' WHEN greatest(pt, en, es) = pt THEN 'pt' WHEN greatest(pt, en, es) = en THEN 'en' ELSE 'es' END AS language FROM v""")  # fmt: skip
def transcript_language(spark: SparkSession, d: str) -> DataFrame:
    return transcript.languages(segments(spark, d))


_TIME = "CASE WHEN ds >= 36000 THEN (ds // 36000) || ':' || lpad(CAST(ds % 36000 // 600 AS VARCHAR), 2, '0') ELSE CAST(ds // 600 AS VARCHAR) END || ':' || lpad(CAST(ds % 600 // 10 AS VARCHAR), 2, '0') || '.' || ds % 10"
_DS = "s AS (SELECT *, CAST(round(start_sec * 10) AS BIGINT) AS ds FROM seg)"


@query("sink_transcript_text", f"WITH {SEG}, {_DS} SELECT media_id, string_agg('[' || {_TIME} || '] ' || speaker || ': ' || text, chr(10) ORDER BY seg_id) AS txt FROM s GROUP BY media_id")
def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.transcript_text(segments(spark, d))


@query("sink_labelled_text", f"WITH {SEG}, {_DS} SELECT media_id, string_agg('[' || {_TIME} || '] ' || CASE WHEN speaker = 'system' THEN '?' ELSE speaker END || ': ' || text, chr(10) ORDER BY seg_id) AS txt FROM s GROUP BY media_id")
def labelled_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.labelled_text(segments(spark, d).withColumn("speaker", F.when(F.col("speaker") != "system", F.col("speaker"))))


def _srt(c: str) -> str:
    return f"lpad(CAST({c} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0')"


@query("sink_subtitles", f"""WITH {SEG}, s AS (SELECT *, CAST(round(start_sec * 1000) AS BIGINT) AS a, CAST(round(end_sec * 1000) AS BIGINT) AS b, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS i FROM seg)
  SELECT media_id, string_agg(i || chr(10) || {_srt('a')} || ' --> ' || {_srt('b')} || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY seg_id) AS srt FROM s GROUP BY media_id""")  # fmt: skip
def subtitles(spark: SparkSession, d: str) -> DataFrame:
    return sinks.subtitles(segments(spark, d))


# -- secrets --------------------------------------------------------------------------------------

def _screen(spark: SparkSession, d: str) -> DataFrame:
    """A document is a frame of the medium that is its source."""
    return table(spark, d, "documents").select(F.col("source").alias("media_id"), F.col("doc_id").cast("int").alias("frame_idx"), F.col("doc_id").cast("double").alias("pts"), "text")


def _sql_rule(rule: str) -> str:
    """The rule for an engine without lookahead."""
    return rule.replace("(?!ant-)(?:proj-)?", "").replace("'", "''")


def _found_sql() -> str:
    """All findings of whole documents.  Blanks inside keys, which SQL's expressions can't follow, are tested apart."""
    parts = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, '{grade}' AS grade, unnest(regexp_extract_all(l, '{_sql_rule(rule)}')) AS raw FROM ln" for kind, grade, rule in secrets.RULES)
    share = "(len(raw) - len(replace(raw, c, ''))) / len(raw)"
    kinds = "regexp_replace(regexp_replace(regexp_replace(raw, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g')"
    return rf"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
  tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '{secrets.TOKEN}')) AS raw FROM documents),
  rnd AS (SELECT DISTINCT doc_id, raw FROM tk WHERE len(regexp_replace(raw, '[^0-9]', '', 'g')) >= {secrets.LEAST_DIGITS} AND -list_sum(list_transform(list_distinct(string_split(raw, '')), lambda c: {share} * log2({share}))) >= {secrets.LEAST_BITS}
    AND len(list_filter(range(1, len(raw)), lambda i: ({kinds})[i] <> ({kinds})[i + 1])) / (len(raw) - 1) >= {secrets.LEAST_TURNS}),
  hit AS (SELECT DISTINCT * FROM ({parts} UNION ALL SELECT doc_id, 'high_entropy_token', 'entropy', raw FROM rnd) WHERE NOT (kind = 'openai_key' AND starts_with(raw, 'sk-ant-'))),
  alone AS (SELECT h.*, source, text FROM hit h JOIN documents USING (doc_id) WHERE NOT EXISTS (FROM hit o WHERE o.doc_id = h.doc_id AND len(o.raw) > len(h.raw) AND contains(o.raw, h.raw) AND o.grade <> 'low')),
  cued AS (SELECT *, instr(text, raw) AS plc, nullif(lower(regexp_extract(replace(substr(text, greatest(1, instr(text, raw) - {secrets.CUE_SPAN}), len(raw) + {2 * secrets.CUE_SPAN}), raw, ' '), '{secrets.CUES}', 0)), '') AS context, regexp_replace(raw, '\s+', '', 'g') AS bare FROM alone),
  graded AS (SELECT *, CASE WHEN grade IN ('high', 'medium', 'low') THEN grade WHEN context IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM cued),
  fnd AS (SELECT source AS media_id, CAST(doc_id AS INTEGER) AS frame_idx, CAST(doc_id AS DOUBLE) AS pts, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, plc, kind, raw) AS INTEGER) AS ord,
    kind, grade, raw, left(bare, 4) || '…' || right(bare, 3) AS masked, CAST(len(bare) AS INTEGER) AS length, confidence, CASE WHEN grade = 'entropy' THEN 'entropy' ELSE 'pattern' END || CASE WHEN context IS NULL THEN '' ELSE '+context' END AS signals, context FROM graded)"""


@query("secrets_scan", f"WITH {_found_sql()} SELECT media_id, frame_idx, kind, masked, length FROM fnd")
def secrets_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(_screen(spark, d)).select("media_id", "frame_idx", "kind", "masked", "length")


@query("secrets_findings", f"WITH {_found_sql()} SELECT media_id, frame_idx, pts, ord, kind, masked, length, confidence, signals, context FROM fnd")
def secrets_findings(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(_screen(spark, d)).withColumn("signals", F.array_join("signals", "+")).drop("raw")


_ONCE = "once AS (SELECT media_id, kind, masked, length, count(*) AS frames, arg_min({'f': frame_idx, 'p': pts, 'o': ord, 'c': confidence, 'x': context}, (frame_idx, ord)) AS s FROM fnd GROUP BY ALL)"


@query("secrets_once_per_medium", f"WITH {_found_sql()}, {_ONCE} SELECT media_id, kind, masked, length, frames, s.f AS frame_idx FROM once")
def secrets_once(spark: SparkSession, d: str) -> DataFrame:
    once = secrets.dedupe_findings(secrets.scan(_screen(spark, d)))
    return once.select("media_id", "kind", "masked", "length", "frames", "frame_idx")


_MASKED = "left(regexp_replace(r, '\\s+', '', 'g'), 4) || '…' || right(regexp_replace(r, '\\s+', '', 'g'), 3)"


@query("secrets_redacted", f"""WITH {_found_sql()}, raws AS (SELECT frame_idx, list(DISTINCT raw ORDER BY len(raw) DESC, raw DESC) FILTER (kind <> 'env_assignment') AS strong, list(DISTINCT raw ORDER BY len(raw) DESC, raw DESC) FILTER (kind = 'env_assignment') AS weak FROM fnd GROUP BY frame_idx),
  one AS (SELECT doc_id, source, list_reduce(list_concat([text], coalesce(strong, [])), lambda acc, r: replace(acc, r, {_MASKED})) AS text, weak FROM documents LEFT JOIN raws ON frame_idx = doc_id),
  two AS (SELECT doc_id, source, list_reduce(list_concat([text], coalesce(weak, [])), lambda acc, r: replace(acc, r, {_MASKED})) AS text FROM one)
  SELECT source AS media_id, CAST(doc_id AS INTEGER) AS frame_idx, md5(text) AS text, CAST(length(text) AS INTEGER) AS chars FROM two""")  # fmt: skip
def secrets_redacted(spark: SparkSession, d: str) -> DataFrame:
    clean, _ = screen.read_screen(_screen(spark, d))
    return clean.select("media_id", "frame_idx", F.md5("text").alias("text"), F.length("text").alias("chars"))


@query("secrets_by_confidence", f"WITH {_found_sql()} SELECT media_id, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM fnd GROUP BY media_id")
def secrets_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return secrets.by_confidence(secrets.scan(_screen(spark, d)))


@query("secrets_entropy", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9]{32,}\b')) AS tok FROM documents), c AS (SELECT doc_id, tok, unnest(string_split(tok, '')) AS ch FROM (SELECT DISTINCT * FROM t)),
  f AS (SELECT doc_id, tok, ch, count(*) / length(tok) AS p FROM c GROUP BY doc_id, tok, ch) SELECT doc_id, tok, round(-sum(p * log2(p)), 6) AS bits FROM f GROUP BY ALL""")  # fmt: skip
def entropy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(secrets.TOKEN), F.lit(0)))).alias("tok"))
    return t.select("doc_id", "tok", F.round(secrets.entropy(F.col("tok")), 6).alias("bits"))


@query("screen_stats", "SELECT source AS media_id, count(*) AS frames, count(*) FILTER (trim(text) <> '') AS frames_with_text FROM documents GROUP BY source")
def screen_stats(spark: SparkSession, d: str) -> DataFrame:
    return screen.stats(_screen(spark, d))


_BLK = "blk AS (SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(turn // 2 AS INTEGER) AS frame_idx, CAST(turn AS INTEGER) AS block_no, text, CAST((conv_id * 37 + turn * 11) % 100 AS INTEGER) AS confidence FROM conversations)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("media_id"), F.floor(F.col("turn") / 2).cast("int").alias("frame_idx"), F.col("turn").cast("int").alias("block_no"), "text", ((F.col("conv_id") * 37 + F.col("turn") * 11) % 100).cast("int").alias("confidence"))


@query("screen_frame_texts", f"WITH {_BLK} SELECT media_id, frame_idx, string_agg(text, chr(10) ORDER BY block_no) AS text, CAST(floor(avg(confidence) + 0.5) AS INTEGER) AS mean_confidence, count(*) AS n_blocks FROM blk WHERE trim(text) <> '' AND confidence >= 30 GROUP BY ALL")
def frame_texts(spark: SparkSession, d: str) -> DataFrame:
    return screen.frame_texts(_blocks(spark, d))


@query("sink_screen_text", f"""WITH {_BLK}, f AS (SELECT media_id, frame_idx, string_agg(text, chr(10) ORDER BY block_no) AS text, CAST(floor(avg(confidence) + 0.5) AS INTEGER) AS c FROM blk WHERE trim(text) <> '' AND confidence >= 30 GROUP BY ALL)
  SELECT media_id, string_agg('=== #' || frame_idx || ' 0:' || lpad(CAST(frame_idx AS VARCHAR), 2, '0') || '.0 (conf ' || c || '%)' || chr(10) || text, chr(10) ORDER BY frame_idx) AS txt FROM f GROUP BY media_id""")  # fmt: skip
def screen_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.screen_text(screen.frame_texts(_blocks(spark, d)).withColumn("pts", F.col("frame_idx").cast("double")))


# -- review ---------------------------------------------------------------------------------------

_SIZES = "sz AS (SELECT p_partkey AS k, [1920, 1080, 1890, 1440, 864, 2560, 1000][p_partkey % 7 + 1] AS w, [1080, 1920, 1080, 1080, 1080, 1080, 1000][p_partkey % 7 + 1] + p_size % 2 * 10 AS h FROM part)"
_ASPECT = """asp AS (SELECT k, w, h, w / h AS d, (SELECT arg_min(n, (abs(v - w / h), i)) FROM (VALUES ('16:9', 16 / 9, 0), ('9:16', 9 / 16, 1), ('4:3', 4 / 3, 2), ('1:1', 1.0, 3), ('4:5', 4 / 5, 4), ('21:9', 21 / 9, 5), ('7:4', 7 / 4, 6)) r(n, v, i)) AS near,
  (SELECT min(abs(v - w / h)) FROM (VALUES (16 / 9), (9 / 16), (4 / 3), (1.0), (4 / 5), (21 / 9), (7 / 4)) r(v)) < 0.005 AS exact FROM sz)"""


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 7 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), pick(1920, 1080, 1890, 1440, 864, 2560, 1000).alias("width"), (pick(1080, 1920, 1080, 1080, 1080, 1080, 1000) + F.col("p_size") % 2 * 10).alias("height"))


@query("media_aspect", f"""WITH {_SIZES}, {_ASPECT} SELECT k, CASE WHEN exact THEN near ELSE w || ':' || h END AS ratio, round(d, 4) AS decimal,
  CASE WHEN NOT exact THEN '' WHEN near = '16:9' THEN 'youtube,linkedin' WHEN near = '9:16' THEN 'youtube-shorts,instagram,tiktok' WHEN near IN ('1:1', '4:5') THEN 'instagram,linkedin' ELSE '' END AS fits,
  CASE WHEN abs(d - 16 / 9) < 0.005 THEN 'fits' WHEN d < 16 / 9 THEN 'pillarbox' ELSE 'letterbox' END AS in16x9 FROM asp""")  # fmt: skip
def aspects(spark: SparkSession, d: str) -> DataFrame:
    s = _sizes(spark, d).withColumn("a", media.aspect(F.col("width"), F.col("height")))
    return s.select("k", "a.ratio", "a.decimal", F.array_join("a.fits", ",").alias("fits"), "a.in16x9")


@query("review_aspect", f"""WITH {_SIZES}, {_ASPECT}, r AS (SELECT *, CASE WHEN exact THEN near ELSE w || ':' || h END AS ratio FROM asp)
  SELECT CAST(k AS VARCHAR) AS media_id, CASE WHEN ratio = '16:9' THEN 'ok' ELSE 'warn' END AS severity, CASE WHEN ratio = '16:9' THEN 'Aspect 16:9 fits YouTube' ELSE 'Aspect ' || ratio || ' does not match YouTube (16:9)' END AS title FROM r""")  # fmt: skip
def review_aspect(spark: SparkSession, d: str) -> DataFrame:
    info = _sizes(spark, d).select(F.col("k").cast("string").alias("media_id"), "width", "height", F.lit("video").alias("kind"))
    return review.aspect_findings(info, review.preset(spark, "youtube")).select("media_id", "severity", "title")


_LOUD = "lv AS (SELECT CAST(s_suppkey AS VARCHAR) AS media_id, -30 + s_suppkey % 25 AS i, -4 + s_suppkey % 6 AS tp FROM supplier)"


@query("review_loudness", f"""WITH {_LOUD} SELECT media_id, CASE WHEN abs(i + 14) <= 2 THEN 'ok' ELSE 'warn' END AS severity,
  CASE WHEN abs(i + 14) <= 2 THEN 'Loudness ' || i || '.0 LUFS is on target' ELSE 'Loudness ' || i || '.0 LUFS is ' || abs(i + 14) || '.0 dB ' || CASE WHEN i < -14 THEN 'below' ELSE 'above' END || ' YouTube''s -14 LUFS' END AS title FROM lv
  UNION ALL SELECT media_id, 'warn', 'True peak ' || tp || '.0 dBTP above -1 dBTP' FROM lv WHERE tp > -1""")  # fmt: skip
def review_loudness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lv = table(spark, d, "supplier").select(k.cast("string").alias("media_id"), (k % 25 - 30).cast("double").alias("integrated_lufs"), (k % 6 - 4).cast("double").alias("true_peak_dbtp"), F.lit(5.0).alias("loudness_range"))
    return review.loudness_findings(lv, review.preset(spark, "youtube")).select("media_id", "severity", "title")


_SIL = "sl AS (SELECT media_id, CAST(turn_no AS DOUBLE) AS start_sec, 2.0::DOUBLE + turn_no % 4 AS duration_sec FROM turns WHERE turn_no % 5 < 2 AND CAST(media_id AS INTEGER) % 3 <> 0)"


def _silences(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).where((F.col("turn_no") % 5 < 2) & (F.col("media_id").cast("int") % 3 != 0))
    return t.select("media_id", F.col("turn_no").cast("double").alias("start_sec"), (F.lit(2.0) + F.col("turn_no") % 4).alias("duration_sec"))


@query("review_silences", f"""WITH {SEG}, {REG}, {TURN}, {_SIL}, s AS (SELECT media_id, count(*) AS gaps, sum(duration_sec) AS total, max(duration_sec) AS longest, arg_max(start_sec, (duration_sec, -start_sec)) AS at_sec FROM sl GROUP BY media_id)
  SELECT media_id, CASE WHEN gaps IS NULL THEN 'ok' WHEN longest >= 5 THEN 'warn' ELSE 'info' END AS severity, at_sec, coalesce(greatest(0, total - gaps * 0.5), 0) AS saving FROM (SELECT DISTINCT media_id FROM seg) LEFT JOIN s USING (media_id)""")  # fmt: skip
def review_silences(spark: SparkSession, d: str) -> DataFrame:
    s = _silences(spark, d)
    found = review.silence_findings(segments(spark, d).select("media_id").distinct(), s)
    return found.join(review.silence_summary(s).select("media_id", "saving"), "media_id", "left").select("media_id", "severity", "at_sec", F.coalesce("saving", F.lit(0.0)).alias("saving"))


@query("review_coverage", f"""WITH {SEG}, r AS (SELECT media_id, greatest(1, max(end_sec)) AS w, count(*) AS frames, CAST(media_id AS INTEGER) % 4 AS pruned FROM seg GROUP BY media_id)
  SELECT media_id, CAST(ceil(w / 4) AS BIGINT) AS needed, round(least(w, frames * 4), 4) AS coverage_sec, 60 >= ceil(w / 4) AND pruned = 0 AS complete FROM r""")  # fmt: skip
def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = segments(spark, d).groupBy("media_id").agg(F.greatest(F.lit(1.0), F.max("end_sec")).alias("window_sec"), F.count(F.lit(1)).alias("frames")).withColumn("pruned", F.col("media_id").cast("int") % 4)
    return review.coverage(r, 60).select("media_id", F.col("needed").cast("bigint"), F.round("coverage_sec", 4).alias("coverage_sec"), "complete")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """A source is a medium, its documents the frames that were read and the pauses that were heard; every third has no sound, every fourth no picture."""
    f, n = _screen(spark, d), F.length("media_id")
    read = f.groupBy("media_id").agg(F.count(F.lit(1)).alias("frames")).withColumns({"window_sec": F.col("frames") * 4.0, "pruned": F.col("frames") % 2})
    info = read.select("media_id", F.when(n % 4 == 3, "audio").otherwise("video").alias("kind"), F.when(n % 2 == 0, 1920).otherwise(1440).alias("width"), F.lit(1080).alias("height"), (n % 3 != 2).alias("has_audio"))
    loud = read.select("media_id", (F.lit(-30.0) + n * 3).alias("integrated_lufs"), (F.lit(-6.0) + n).alias("true_peak_dbtp"), F.lit(4.0).alias("loudness_range"))
    quiet = f.select("media_id", F.col("pts").alias("start_sec"), (F.col("frame_idx") % 7).cast("double").alias("duration_sec")).where("duration_sec >= 2")
    return review.review(info, review.preset(spark, "youtube"), loudness=loud, silences=quiet, read=read, secrets=screen.read_screen(f)[1])


def _clock(sec: str) -> str:
    return _TIME.replace("ds", f"CAST(round(({sec}) * 10) AS BIGINT)")


def _listed(cap: int) -> str:
    return f"string_agg(line, '; ' ORDER BY nth) FILTER (nth <= {cap}) || CASE WHEN count(*) > {cap} THEN '; and ' || (count(*) - {cap}) || ' more' ELSE '' END"


_REVIEW = f"""{_found_sql()}, {_ONCE},
  rd AS (SELECT source AS media_id, count(*) AS frames, count(*) * 4.0::DOUBLE AS w, count(*) % 2 AS pruned, len(source) AS n FROM documents GROUP BY source),
  inf AS (SELECT *, n % 4 <> 3 AS seen, n % 3 <> 2 AS heard, CASE WHEN n % 2 = 0 THEN 1920 ELSE 1440 END AS width, frames <= 500 AND pruned = 0 AS complete, -30 + n * 3 AS i, -6 + n AS tp FROM rd),
  cov AS (SELECT *, CASE WHEN complete THEN 'All ' || {_clock('w')} || ' were read, a frame every four seconds (' || frames || ' in all).' ELSE 'About ' || {_clock('least(w, frames * 4)')} || ' of ' || {_clock('w')} || ' were read, a frame every four seconds (' || frames || ' of ' || frames || ').' END AS coverage FROM inf),
  sl AS (SELECT source AS media_id, CAST(doc_id AS DOUBLE) AS start_sec, doc_id % 7 AS dur FROM documents WHERE doc_id % 7 >= 2),
  gp AS (SELECT media_id, count(*) AS gaps, sum(dur) AS total, max(dur) AS longest, arg_max(start_sec, (dur, -start_sec)) AS at_sec FROM sl GROUP BY media_id),
  ln2 AS (SELECT media_id, s.c AS confidence, kind || ' ' || masked || ' at ' || {_clock('s.p')} || CASE WHEN s.x IS NULL THEN '' ELSE ' (near "' || s.x || '")' END AS line, s FROM once),
  rk AS (SELECT *, row_number() OVER (PARTITION BY media_id, confidence ORDER BY s.f, s.o, s.p, line) AS nth FROM ln2),
  gr AS (SELECT media_id, confidence, count(*) AS c, CASE WHEN confidence = 'low' THEN {_listed(5)} ELSE {_listed(8)} END AS listed, arg_min(s.p, nth) AS first_pts FROM rk GROUP BY media_id, confidence),
  fd AS (
    SELECT media_id, 'aspect' AS "check", CASE WHEN NOT seen THEN 'info' WHEN width = 1920 THEN 'ok' ELSE 'warn' END AS severity, CASE WHEN NOT seen THEN 'No video stream, aspect check skipped' WHEN width = 1920 THEN 'Aspect 16:9 fits YouTube' ELSE 'Aspect 4:3 does not match YouTube (16:9)' END AS title,
      CASE WHEN NOT seen THEN 'kind: audio' WHEN width = 1920 THEN '1920×1080' ELSE '1440×1080: shown with black bars (pillarbox) where 16:9 is expected; change the frame before publishing.' END AS detail, NULL::DOUBLE AS at_sec, NULL AS data FROM inf
    UNION ALL SELECT media_id, 'loudness', CASE WHEN abs(i + 14) <= 2 THEN 'ok' ELSE 'warn' END, CASE WHEN abs(i + 14) <= 2 THEN 'Loudness ' || i || '.0 LUFS is on target' ELSE 'Loudness ' || i || '.0 LUFS is ' || abs(i + 14) || '.0 dB ' || CASE WHEN i < -14 THEN 'below' ELSE 'above' END || ' YouTube''s -14 LUFS' END,
      CASE WHEN i + 14 < -2 THEN 'Too quiet by ' || abs(i + 14) || ' dB: playback on YouTube would lift its noise as well, so bring it to -14 LUFS first. True peak ' || tp || '.0 dBTP, range 4.0 LU.' ELSE 'True peak ' || tp || '.0 dBTP, loudness range 4.0 LU.' END, NULL, '{{"deltaDb":' || (i + 14) || '.0}}' FROM inf WHERE heard
    UNION ALL SELECT media_id, 'loudness', 'warn', 'True peak ' || tp || '.0 dBTP above -1 dBTP', 'Encoding may clip such peaks; limit them.', NULL, NULL FROM inf WHERE heard AND tp > -1
    UNION ALL SELECT media_id, 'loudness', 'info', 'No audio stream, loudness check skipped', '', NULL, NULL FROM inf WHERE NOT heard
    UNION ALL SELECT media_id, 'silences', CASE WHEN gaps IS NULL THEN 'ok' WHEN longest >= 5 THEN 'warn' ELSE 'info' END, CASE WHEN gaps IS NULL THEN 'No silence gaps of 2 s or more' ELSE gaps || ' silence gap' || CASE WHEN gaps > 1 THEN 's' ELSE '' END || ' of 2 s or more, ' || total || ' s in all' END,
      CASE WHEN gaps IS NULL THEN '' ELSE 'The longest, ' || longest || '.0 s, starts at ' || {_clock('at_sec')} || '. With half a second left of each, ' || CAST(floor(greatest(0, total - gaps * 0.5) + 0.5) AS BIGINT) || ' s go.' END, at_sec, NULL FROM inf LEFT JOIN gp USING (media_id) WHERE heard
    UNION ALL SELECT media_id, 'silences', 'info', 'No audio stream, silence check skipped', '', NULL, NULL FROM inf WHERE NOT heard
    UNION ALL SELECT media_id, 'secrets', CASE confidence WHEN 'high' THEN 'block' WHEN 'medium' THEN 'warn' ELSE 'info' END, CASE confidence WHEN 'high' THEN c || ' probable secret' || CASE WHEN c > 1 THEN 's' ELSE '' END || ' visible on screen' WHEN 'medium' THEN c || ' possible secret' || CASE WHEN c > 1 THEN 's' ELSE '' END || ' on screen' ELSE c || ' low-confidence token(s) / personal data on screen' END,
      listed || CASE confidence WHEN 'high' THEN '. Whoever saw it may keep it: cutting the frame is not enough, withdraw the key. ' ELSE '. ' END || coverage, CASE WHEN confidence <> 'low' THEN first_pts END, NULL FROM gr JOIN cov USING (media_id) WHERE seen
    UNION ALL SELECT media_id, 'secrets', CASE WHEN complete THEN 'ok' ELSE 'warn' END, CASE WHEN complete THEN 'No secrets found in ' || frames || ' frames' ELSE 'No secrets found, but not all was read' END, coverage, NULL, NULL FROM cov WHERE seen AND media_id NOT IN (SELECT media_id FROM once)
    UNION ALL SELECT media_id, 'secrets', 'info', 'Audio only, on-screen check skipped', '', NULL, NULL FROM inf WHERE NOT seen),
  rv AS (SELECT *, list_position(['ok', 'info', 'warn', 'block'], severity) AS r, CAST(row_number() OVER (PARTITION BY media_id ORDER BY list_position(['ok', 'info', 'warn', 'block'], severity) DESC, "check", title, detail) AS INTEGER) AS ord FROM fd)"""


@query("review_findings", f'WITH {_REVIEW} SELECT media_id, "check", severity, title, detail, at_sec, data, ord FROM rv')
def review_findings(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d)


@query("review_verdict", f"WITH {_REVIEW} SELECT media_id, ['ok', 'info', 'warn', 'block'][max(r)] AS verdict, count(*) AS n_findings, CAST(CASE max(r) WHEN 4 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM rv GROUP BY media_id")
def review_verdict(spark: SparkSession, d: str) -> DataFrame:
    return review.verdict(_reviewed(spark, d)).withColumn("exit_code", review.exit_code(F.col("verdict")))


_ICON = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.ICONS.items()) + " ELSE '' END"


@query("sink_review_report", f"WITH {_REVIEW} SELECT media_id, string_agg('- ' || {_ICON} || ' **' || title || '**' || CASE WHEN at_sec IS NULL THEN '' ELSE ' _(at ' || {_clock('at_sec')} || ')_' END || CASE WHEN detail = '' THEN '' ELSE chr(10) || '  ' || detail END, chr(10) ORDER BY ord) AS md FROM rv GROUP BY media_id")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.report(_reviewed(spark, d))


@query("review_event_verdict", "WITH s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 WHEN 'click' THEN 2 ELSE 1 END AS r FROM events) SELECT CAST(user_id AS VARCHAR) AS media_id, ['ok', 'info', 'warn', 'block'][max(r)] AS verdict, count(*) AS n_findings FROM s GROUP BY user_id")
def event_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over findings that are events, as graded by their type."""
    t = F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("media_id"), F.when(t == "purchase", "warn").when(t == "error", "block").when(t == "click", "info").otherwise("ok").alias("severity"))
    return review.verdict(e)


# -- jobs -----------------------------------------------------------------------------------------


@query("jobs_stale", f"""WITH {JOBS} SELECT id, CASE WHEN status IN ('queued', 'running') AND epoch({NOW}) - epoch(coalesce(heartbeat_at, updated_at, created_at)) > 30 THEN 'interrupted' ELSE status END AS status,
  CASE WHEN status IN ('queued', 'running') AND epoch({NOW}) - epoch(coalesce(heartbeat_at, updated_at, created_at)) > 30 THEN 'INTERRUPTED' END AS error_code FROM jobs""")  # fmt: skip
def jobs_stale(spark: SparkSession, d: str) -> DataFrame:
    return jobs.refresh_stale(base.jobs(spark, d), F.expr(NOW)).select("id", "status", "error_code")


@query("jobs_eta", f"WITH {JOBS} SELECT id, round((epoch(created_at) + 3600 - epoch(started_at)) / fraction * (1 - fraction)) AS eta FROM jobs WHERE status = 'running' AND fraction > 0.02 AND started_at IS NOT NULL")
def jobs_eta(spark: SparkSession, d: str) -> DataFrame:
    j = base.jobs(spark, d).withColumn("eta", jobs.eta_seconds(F.col("created_at") + F.expr("interval 1 hour")))
    return j.where("eta is not null").select("id", "eta")


@query("jobs_latest", f"WITH {JOBS} SELECT id, kind, status, created_at FROM jobs WHERE regexp_full_match(id, 'j_[0-9a-f]{{12}}') ORDER BY created_at DESC, id LIMIT 50")
def jobs_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(base.jobs(spark, d), 50).select("id", "kind", "status", "created_at")


@query("jobs_peak_concurrency", f"""WITH {JOBS}, m AS (SELECT kind, started_at AS t, 1 AS d FROM jobs WHERE started_at IS NOT NULL AND finished_at IS NOT NULL UNION ALL SELECT kind, finished_at, -1 FROM jobs WHERE started_at IS NOT NULL AND finished_at IS NOT NULL),
  s AS (SELECT kind, t, sum(d) AS d FROM m GROUP BY ALL), r AS (SELECT kind, sum(d) OVER (PARTITION BY kind ORDER BY t) AS n FROM s) SELECT kind, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY kind""")  # fmt: skip
def jobs_peak(spark: SparkSession, d: str) -> DataFrame:
    return jobs.peak_concurrency(base.jobs(spark, d))


@query("jobs_collectable", f"WITH {JOBS} SELECT id FROM jobs WHERE updated_at < {NOW} - INTERVAL 400 DAY AND status <> 'running'")
def jobs_collectable(spark: SparkSession, d: str) -> DataFrame:
    return jobs.collectable(base.jobs(spark, d), F.expr(NOW), 400).select("id")


@query("jobs_current_state", """SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, arg_max(CASE WHEN event_id % 4 = 0 THEN 'end' ELSE 'progress' END, (ts, event_id)) AS event, count(*) AS n_events, CAST(sum(CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END) AS BIGINT) AS worked_ms FROM events GROUP BY user_id""")
def jobs_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("event_no"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 4 == 0, "end").otherwise("progress").alias("event"), (F.col("event_id") % 1000).alias("duration_ms"))
    return jobs.current_state(e).drop("last_ts")


@query("jobs_estimates", """WITH s AS (SELECT p_partkey, CAST(p_size * 12 AS DOUBLE) AS d FROM part) SELECT p_partkey, round(8 + d * 0.6, 4) AS transcribe, round(8 + d * 0.2, 4) AS transcribe_fast, round(6 + d * 0.04 + least(120, d / 5) * 0.3, 4) AS keyframes,
  round(10 + d * 0.04 + least(80, greatest(6, d / 6)) * 3.2, 4) AS read_screen, round(4 + d * 0.06 + 10 + d * 0.04 + least(500, ceil(d / 4)) * 3.2, 4) AS review, round(12 + d * 0.08, 4) AS diarize, greatest(1, least(d, 300 - 20)) AS window_sec FROM s""")  # fmt: skip
def estimates(spark: SparkSession, d: str) -> DataFrame:
    from strandline.functions import times

    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 12).cast("double").alias("d"))
    c = F.col("d")
    cols = {"transcribe": media.estimate_seconds("transcribe", c), "transcribe_fast": media.estimate_seconds("transcribe", c, fast=True), "keyframes": media.estimate_seconds("keyframes", c), "read_screen": media.estimate_seconds("read_screen", c, 80), "review": media.estimate_seconds("review", c, 500), "diarize": media.estimate_seconds("diarize", c)}
    return s.select("p_partkey", *[F.round(v, 4).alias(k) for k, v in cols.items()], times.window_duration(c, F.lit(20.0), F.lit(300.0)).alias("window_sec"))


# -- sources --------------------------------------------------------------------------------------

_HOST = r"regexp_extract(url, '^https?://([^/:?#]+)', 1)"


@query("source_origin", rf"SELECT page_id, CASE WHEN regexp_matches({_HOST}, '(^|\.)(youtube\.com|vimeo\.com|x\.com)$') THEN 'site' ELSE 'url' END AS origin, regexp_matches(lower({_HOST}), '\.(localhost|local|internal|home\.arpa)$') OR lower({_HOST}) = 'localhost' AS refused FROM pages")
def source_origin(spark: SparkSession, d: str) -> DataFrame:
    return src.resolve(table(spark, d, "pages").select("page_id", F.col("url").alias("input"))).select("page_id", "origin", "refused")


_IP = "ip AS (SELECT c_custkey AS k, c_custkey * 7 % 256 AS a, c_custkey * 13 % 256 AS b, c_custkey % 256 AS c, c_nationkey AS e FROM customer)"


@query("source_private_ipv4", f"""WITH {_IP} SELECT k, a || '.' || b || '.' || c || '.' || e AS ip, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)
  OR (a = 198 AND b IN (18, 19, 51)) OR (a = 203 AND b = 0) OR a >= 224 AS private FROM ip""")  # fmt: skip
def private_ipv4(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in (k * 7 % 256, k * 13 % 256, k % 256, F.col("c_nationkey"))])
    c = table(spark, d, "customer").select(k.alias("k"), ip.alias("ip"))
    return c.withColumn("private", media.is_private_ipv4(media.ipv4(F.col("ip"))))


@query("source_private_address", f"WITH {_IP} SELECT k, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19, 51)) OR (a = 203 AND b = 0) OR a >= 224 AS private FROM ip")
def private_address(spark: SparkSession, d: str) -> DataFrame:
    """The same addresses inside IPv6: mapped, translated and 6to4, by customer."""
    k = F.col("c_custkey")
    quad = [k * 7 % 256, k * 13 % 256, k % 256, F.col("c_nationkey")]
    hexed = F.concat(F.lpad(F.hex(quad[0]), 2, "0"), F.lpad(F.hex(quad[1]), 2, "0"), F.lit(":"), F.lpad(F.hex(quad[2]), 2, "0"), F.lpad(F.hex(quad[3].cast("long")), 2, "0"))
    dotted = F.concat_ws(".", *[q.cast("string") for q in quad])
    ip = F.when(k % 4 == 0, F.concat(F.lit("::ffff:"), dotted)).when(k % 4 == 1, F.concat(F.lit("64:ff9b::"), hexed)).when(k % 4 == 2, F.concat(F.lit("2002:"), hexed, F.lit("::1"))).otherwise(dotted)
    return table(spark, d, "customer").select(k.alias("k"), addresses.private_address(ip).alias("private"))


@query("source_data_uri", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime, md5(text) AS content FROM conversations")
def data_uri(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    uri = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))).otherwise(F.concat(F.lit("data:text/HTML,"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))))
    return c.withColumn("u", src.data_uri(uri)).select("conv_id", "turn", "u.mime", F.md5("u.content").alias("content"))


@query("source_probe", """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 2 THEN 'audio' WHEN p_size % 5 = 0 AND p_partkey % 3 = 1 THEN 'image' ELSE 'video' END AS kind, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS duration_sec,
  CASE WHEN p_partkey % 3 <> 2 THEN CAST(1920 AS INTEGER) END AS width, CASE WHEN p_partkey % 3 <> 2 THEN round(30000 / 1001, 3) END AS fps, CAST(CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS INTEGER) AS audio_tracks FROM part""")  # fmt: skip
def probe(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    video = F.lit('{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"30000/1001"}')
    audio = F.lit('{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000"},{"codec_type":"video","width":5,"height":5,"disposition":{"attached_pic":1}}')
    streams = F.when(k == 0, F.concat_ws(",", video, audio)).when(k == 1, video).otherwise(audio)
    dur = F.when(F.col("p_size") % 5 == 0, F.lit("0")).otherwise(F.col("p_size").cast("string"))
    j = F.concat(F.lit('{"format":{"format_name":"mov","duration":"'), dur, F.lit('","size":"99"},"streams":['), streams, F.lit("]}"))
    p = src.probed(table(spark, d, "part").select(F.col("p_partkey").alias("k"), j.alias("probe")))
    return p.select("k", "info.kind", "info.duration_sec", "info.video.width", "info.video.fps", "info.audio_tracks")


@query("source_folder_tracks", "SELECT c_nationkey AS folder, 'f/' || max(c_custkey) FILTER (c_custkey % 5 = 0) || '.mp4' AS mixed, CAST(count(*) FILTER (c_custkey % 5 <> 0) AS INTEGER) AS n_tracks, min('Customer ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' x') FILTER (c_custkey % 5 <> 0) AS first FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_custkey % 5 = 0) > 0 AND count(*) FILTER (c_custkey % 5 <> 0) > 0")
def folder_tracks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("f/"), k.cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("f/Audio Record/audioCustomer_"), F.lpad(k.cast("string"), 6, "0"), F.lit("-x_12.m4a")))
    files = table(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), path.alias("path"), k.alias("length"))
    t = src.folder_tracks(files)
    return t.select("folder", "mixed", F.size("tracks").alias("n_tracks"), F.get("tracks", 0)["participant"].alias("first"))


@query("source_redirects", "SELECT page_id, page_id % 9 <= 5 AND page_id % 4 <> 3 AS allowed FROM pages")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("page_id") % 4 == 3, "http://127.0.0.1/x").otherwise("https://a.example.com/x")
    hops = F.concat(F.array_repeat(F.lit("https://b.example.org/"), (F.col("page_id") % 9).cast("int")), F.array(last))
    return table(spark, d, "pages").select("page_id", src.hops_allowed(hops).alias("allowed"))


@query("source_normalised_video", f"WITH {_SIZES} SELECT k, CAST(w // 2 * 2 AS BIGINT) AS width, CAST(h // 2 * 2 AS BIGINT) AS height, CAST(greatest(1, least(60, floor(CASE WHEN k % 90 = 0 THEN 30 ELSE k % 90 END + 0.5))) AS BIGINT) AS fps FROM sz")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    n = media.normalised_video(F.col("width"), F.col("height"), (F.col("k") % 90).cast("double"))
    return _sizes(spark, d).withColumn("n", n).select("k", *[F.col(f"n.{c}").cast("bigint").alias(c) for c in ("width", "height", "fps")])


@query("state_replaced", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 3 = 0")
def replaced(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return state.replaced(old, old.where("k % 3 = 0").withColumn("v", F.lit(-1.0)), "k")


@query("media_identity", "SELECT doc_id, 'c_' || left(sha256(text), 24) AS identity FROM documents")
def identity(spark: SparkSession, d: str) -> DataFrame:
    known = media.file_identity(F.col("source"), F.octet_length("text"), F.col("n_chars"), F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", known.alias("identity"))


# -- vision ---------------------------------------------------------------------------------------


@query("vision_hashes", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN e[(i // 8 * 9 + i % 8) % 64 + 1] > e[(i // 8 * 9 + i % 8 + 1) % 64 + 1] THEN '1' ELSE '0' END) AS bits FROM v)
  SELECT vec_id, lower(string_agg(hex(CAST('0b' || s AS INTEGER)), '' ORDER BY k)) AS hash FROM (SELECT vec_id, k, array_to_string(bits[k * 4 + 1:k * 4 + 4], '') AS s FROM b, range(0, 16) t(k)) GROUP BY vec_id""")  # fmt: skip
def hashes(spark: SparkSession, d: str) -> DataFrame:
    """A vector's 64 components, around again, are the 72 pixels of a picture."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get("embedding", (i % 64).cast("int")))
    return table(spark, d, "embeddings").select("vec_id", vision.hash_hex(vision.dhash(pixels)).alias("hash"))


@query("vision_hamming", "WITH h AS (SELECT event_id AS k, ((event_id * 2654435761) >> 7) & 4095 AS h FROM events) SELECT a.k, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits FROM h a JOIN h b ON b.k = a.k + 1")
def hamming(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").select(F.col("event_id").alias("k"), F.shiftright(F.col("event_id") * F.lit(2654435761), 7).bitwiseAND(F.lit(4095)).alias("h"))
    return h.join(h.select((F.col("k") - 1).alias("k"), F.col("h").alias("h2")), "k").select("k", vision.hamming(F.col("h"), F.col("h2")).alias("bits"))


@query("vision_unit_vectors", "WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, e), 5) AS before, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first FROM v")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return v.select("vec_id", F.round(vision.dot(F.col("e"), F.col("e")), 5).alias("before"), F.round(F.get(vision.unit(F.col("e")), 0), 5).alias("first"))


@query("vision_tile_boxes", "WITH b AS (SELECT p_partkey AS k, p_size % 10 / 10 AS x, p_size % 7 / 10 AS y FROM part) SELECT k, CAST(t AS INTEGER) AS tile, round(tx + x * s, 6) AS x, round(ty + y * s, 6) AS y, CAST(greatest(0, floor(round((tx + x * s) * 640, 6))) AS BIGINT) AS left_px FROM b, (VALUES (0, 0.0, 0.0, 0.5), (1, 0.5, 0.0, 0.5), (2, 0.0, 0.5, 0.5), (3, 0.5, 0.5, 0.5), (4, 0.2, 0.2, 0.6)) v(t, tx, ty, s)")
def tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    tiles = F.expr("array(" + ", ".join("named_struct('x', {}D, 'y', {}D, 'w', {}D, 'h', {}D)".format(*t) for t in vision.tile_boxes()) + ")")
    box = F.struct((F.col("p_size") % 10 / 10).alias("x"), (F.col("p_size") % 7 / 10).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("k"), box.alias("box")).select("k", "box", F.posexplode(tiles).alias("tile", "t"))
    f = b.withColumn("f", vision.to_frame(F.col("box"), F.col("t")))
    f = f.select("k", "tile", F.struct(F.round("f.x", 6).alias("x"), F.round("f.y", 6).alias("y"), F.round("f.w", 6).alias("w"), F.round("f.h", 6).alias("h")).alias("f"))
    scaled = F.struct(F.round(F.col("f.x") * 640, 6).alias("x"), F.col("f.y").alias("y"), F.col("f.w").alias("w"), F.col("f.h").alias("h"))
    return f.withColumn("s", scaled).select("k", "tile", F.col("f.x").alias("x"), F.col("f.y").alias("y"), vision.pixel_box(F.col("s"), F.lit(1), F.lit(1))["left"].cast("bigint").alias("left_px"))


@query("vision_scene_cuts", "SELECT CAST(user_id AS VARCHAR) AS media_id, CAST(event_id AS DOUBLE) + 5 AS pts FROM events WHERE event_id % 100 / 100 > 0.3")
def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select(F.col("user_id").cast("string").alias("media_id"), F.col("event_id").cast("double").alias("pts"), (F.col("event_id") % 100 / 100).alias("score"))
    return src.scene_cuts(scores, 0.3, 5.0)


@query("cluster_voices")
def cluster_voices(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label are a medium's turns, of whole numbers of seconds."""
    v = table(spark, d, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    t = v.select(F.col("label").cast("string").alias("media_id"), F.col("n").alias("turn_no"), "embedding", (F.col("n") % 7 + 1).cast("double").alias("weight"))
    return clustering.cluster_speakers(t, threshold=0.1, most=6)


@query("cluster_similarities", """WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.label, round(avg(list_dot_product(a.e, b.e)), 4) AS linkage, count(*) AS pairs FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def similarities(spark: SparkSession, d: str) -> DataFrame:
    """The mean over all pairs of a label, from sums of vectors; no pair is made."""
    v = table(spark, d, "embeddings").where("label IS NOT NULL")
    own = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("m"), F.sum(own).alias("own"))
    sums = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("whole"))
    linkage = F.when(F.col("m") > 1, F.round((F.col("whole") - F.col("own")) / (F.col("m") * (F.col("m") - 1)), 4))
    return rows.where("n > 1").join(whole, "label", "left").select("label", linkage.alias("linkage"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))


@query("source_allowed_args", """WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: x IN ('the', 'of') OR x IN ('a') OR (i > 1 AND w[i - 1] IN ('a'))), ' ') AS kept FROM a""")
def allowed_args(spark: SparkSession, d: str) -> DataFrame:
    """Words stand for arguments: two plain flags, and one that takes a value."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(src.allowed_args(F.split("text", " "), ["the", "of"], ["a"]), " ").alias("kept"))


@query("jobs_inline", "SELECT p_partkey, 6 + d * 0.04 + least(120, d / 5) * 0.3 <= 8 AS keyframes_inline, 4 + d * 0.06 <= 8 AS review_inline, 8 + d * 0.6 <= 8 AS transcribe_inline FROM (SELECT p_partkey, CAST(p_size * 2 + 1 AS DOUBLE) AS d FROM part)")
def jobs_inline(spark: SparkSession, d: str) -> DataFrame:
    """Whether a task on a medium of so many seconds runs at once."""
    c = F.col("d")
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 2 + 1).cast("double").alias("d"))
    return s.select("p_partkey", (media.estimate_seconds("keyframes", c) <= 8).alias("keyframes_inline"), (media.estimate_seconds("review", c, secrets=False) <= 8).alias("review_inline"), (media.estimate_seconds("transcribe", c) <= 8).alias("transcribe_inline"))


@query("plan_pick_frames", """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT DISTINCT media_id, 'sheet' AS what, CAST((i - 1) // 9 + 1 AS INTEGER) AS no FROM n WHERE (i - 1) // 9 + 1 IN (1, 3)),
  f AS (SELECT media_id, 'frame' AS what, CAST(i AS INTEGER) AS no FROM n WHERE i IN (2, 5, 7, 11, 13)), u AS (SELECT * FROM s UNION ALL SELECT * FROM f)
  SELECT media_id, what, no FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY what DESC, no) AS r FROM u) WHERE r <= 6""")  # fmt: skip
def pick_frames(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import keyframes

    f = base.frames(spark, d).withColumn("index", F.col("idx") + 1).withColumn("sheet", vision.sheet_place(F.col("index"))["sheet"])
    return keyframes.pick(f, [1, 3], [2, 5, 7, 11, 13])


@query("media_cache_key", """SELECT doc_id, left(sha1('{"p0":"' || source || '","p1":' || n_chars || ',"p2":null}'), 20) AS key FROM documents""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", media.cache_key(F.col("source"), F.col("n_chars"), F.lit(None).cast("string")).alias("key"))


@query("media_supports", "SELECT p_partkey AS k, p_partkey % 3 <> 1 AS transcribe, p_partkey % 3 <> 2 AS keyframes, p_partkey % 3 <> 1 AS diarize FROM part")
def supports(spark: SparkSession, d: str) -> DataFrame:
    info = F.struct(F.when(F.col("p_partkey") % 3 != 2, 1).alias("video"), F.when(F.col("p_partkey") % 3 != 1, 1).alias("audio"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), info.alias("info"))
    return p.select("k", *[media.supports(F.col("info"), t).alias(t) for t in ("transcribe", "keyframes", "diarize")])


@query("state_cache_usable", "SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 10 <> 3 AND (o_orderkey + 1) % 10 <> 3")
def cache_usable(spark: SparkSession, d: str) -> DataFrame:
    """A result is usable while both its files are there."""
    o = table(spark, d, "orders")
    path = lambda c: F.concat(F.lit("/a/"), c.cast("string"))
    cached = o.select(F.col("o_orderkey").cast("string").alias("key"), F.array(path(F.col("o_orderkey")), path(F.col("o_orderkey") + 1)).alias("artifacts"))
    files = cached.select(F.explode("artifacts").alias("path")).distinct().where(~F.col("path").endswith("3"))
    return state.usable(cached, files).select("key")


@query("plan_track_turns", f"WITH {SEG} SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_sec, speaker) AS INTEGER) AS turn_no, start_sec, speaker, 0.99::DOUBLE AS confidence FROM seg")
def track_turns(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import diarize

    tracks = segments(spark, d).select("media_id", "start_sec", "end_sec", F.col("speaker").alias("participant"))
    return diarize.track_turns(tracks).select("media_id", "turn_no", "start_sec", "speaker", "confidence")


# -- responses and figures --------------------------------------------------------------------------

_TOKENS = "CAST(ceil(length(to_json({{{}}})) / 3.5) AS BIGINT)"


@query("trim_segments", f"""WITH {SEG}, c AS (SELECT media_id, seg_id, text, {_TOKENS.format("'seg_id': seg_id, 'text': text")} AS cost FROM seg), w AS (SELECT *, sum(cost) OVER k AS used, row_number() OVER k AS r, sum(cost) OVER (PARTITION BY media_id) AS total, count(*) OVER (PARTITION BY media_id) AS n FROM c WINDOW k AS (PARTITION BY media_id ORDER BY seg_id)),
  kept AS (SELECT *, n - count(*) OVER (PARTITION BY media_id) AS gone FROM w WHERE total <= 300 OR r = 1 OR used <= 300) SELECT media_id, seg_id, text, CASE WHEN gone > 0 THEN gone || ' of ' || n || ' segment(s) omitted; all of it: strand://jobs/' || media_id || '/transcript' END AS note FROM kept""")  # fmt: skip
def trim_segments(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import trim

    return trim.segments(segments(spark, d).select("media_id", "seg_id", "text"), 300, key="media_id")


@query("trim_screen", f"""WITH f AS (SELECT source AS media_id, doc_id, text, [left(text, 10)] AS blocks FROM documents), s AS (SELECT *, sum({_TOKENS.format("'doc_id': doc_id, 'text': text, 'blocks': blocks")}) OVER (PARTITION BY media_id) > 30000 AS over, greatest(60, 30000 // count(*) OVER (PARTITION BY media_id)) * 3 AS most FROM f)
  SELECT media_id, doc_id, CASE WHEN over AND length(text) > most THEN left(text, most) || '…' ELSE text END AS text, CASE WHEN NOT over THEN array_to_string(blocks, '|') END AS blocks, CASE WHEN over THEN 'blocks omitted, texts capped; all of it: strand://jobs/' || media_id || '/ocr' END AS note FROM s""")  # fmt: skip
def trim_screen(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import trim

    f = table(spark, d, "documents").select(F.col("source").alias("media_id"), "doc_id", "text", F.array(F.left("text", F.lit(10))).alias("blocks"))
    return trim.screen(f, 30_000, key="media_id").withColumn("blocks", F.array_join("blocks", "|"))


@query("trim_key_frames", f"""WITH {base.FRAMES}, s AS (SELECT media_id, idx, dhash, sum({_TOKENS.format("'idx': idx, 'dhash': dhash")}) OVER (PARTITION BY media_id) > 700 AS over FROM fr) SELECT media_id, idx, CASE WHEN NOT over THEN dhash END AS dhash, CASE WHEN over THEN 'hashes omitted' END AS note FROM s""")
def trim_key_frames(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import trim

    return trim.key_frames(base.frames(spark, d).select("media_id", "idx", "dhash"), 700, key="media_id")


@query("plan_speaker_counts", f"WITH {SEG}, {TURN} SELECT media_id, count(DISTINCT speaker) AS speakers FROM turns GROUP BY media_id")
def speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import pipelines

    return pipelines.speaker_counts(turns(spark, d))


@query("state_known_timings", "SELECT o.o_orderkey AS fixture, o.o_orderkey % 2 = 0 AS cached, CASE WHEN o.o_orderkey % 2 = 0 THEN coalesce(p.o_totalprice, o.o_orderkey) ELSE o.o_orderkey END::DOUBLE AS seconds FROM orders o LEFT JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') p USING (o_orderkey)")
def known_timings(spark: SparkSession, d: str) -> DataFrame:
    """Orders are runs; those that are fulfilled have an earlier one."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    runs = o.select(k.alias("fixture"), (k % 2 == 0).alias("cached"), k.cast("double").alias("seconds"))
    return state.known_timings(runs, o.where("o_orderstatus = 'F'").select(k.alias("fixture"), F.col("o_totalprice").cast("double").alias("seconds")))


@query("source_limits", rf"SELECT page_id, CASE WHEN regexp_matches(lower({_HOST}), '\.(localhost|local|internal|home\.arpa)$') OR lower({_HOST}) = 'localhost' THEN 'SOURCE_BLOCKED' WHEN length(html) > 9000 THEN 'SOURCE_TOO_LARGE' WHEN page_id % 50 > 40 THEN 'SOURCE_TOO_LONG' END AS error_code FROM pages")
def source_limits(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans import pipelines

    p = table(spark, d, "pages").select("page_id", F.col("url").alias("input"), F.length("html").alias("length"), (F.col("page_id") % 50).cast("double").alias("duration_sec"))
    return pipelines.limits(src.resolve(p), 40.0, 9_000).select("page_id", "error_code")


@query("media_audio_levels", "WITH v AS (SELECT vec_id // 50 AS media_id, vec_id % 50 AS no, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT CAST(media_id AS VARCHAR) AS media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY no) - 1 AS INTEGER) AS idx, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 5) AS rms FROM v")
def audio_levels(spark: SparkSession, d: str) -> DataFrame:
    """A vector, eight times over, is a chunk of one frame of sound."""
    from strandline.plans import pipelines

    v = table(spark, d, "embeddings")
    pcm = v.select(F.floor(F.col("vec_id") / 50).cast("string").alias("media_id"), (F.col("vec_id") % 50).cast("int").alias("chunk_no"), F.flatten(F.array_repeat("embedding", 8)).alias("samples"))
    return pipelines.levels(pcm).select("media_id", "idx", F.round("rms", 5).alias("rms"))
