"""Text and time functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as txt
from strandline.functions import times
from strandline.operators import glossary, rates
from strandline.queries.base import SEG, query, segments, table

_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)


@query(
    "text_normal_forms",
    rf"""WITH n AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: len(x) > 1 AND NOT list_contains([{_STOP}], x)) AS t,
      regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g') AS c, trim(regexp_replace(regexp_replace(lower(text), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g')) AS p,
      trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS e FROM documents)
    SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens, md5(c) AS compact, md5(p) AS plain, md5(e) AS for_rates FROM n""",
)
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    tokens = txt.search_tokens(c)
    made = table(spark, d, "documents").select("doc_id", tokens.alias("t"), txt.compact(c).alias("c"), txt.plain(c).alias("p"), txt.plain_for_rates(c).alias("e"))
    return made.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"), F.md5("c").alias("compact"), F.md5("p").alias("plain"), F.md5("e").alias("for_rates"))


def _votes(lang: str) -> str:
    return " + ".join(f"(length(t) - length(replace(t, ' {w} ', ''))) // {len(w) + 2}" for w in txt.LANGUAGE_VOTES[lang])


@query(
    "text_language_vote",
    f"""WITH v AS (SELECT doc_id, {_votes('pt')} AS pt, {_votes('en')} AS en, {_votes('es')} AS es FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents))
    SELECT doc_id, CASE WHEN greatest(pt, en, es) < 3 THEN 'auto' WHEN greatest(pt, en, es) = pt THEN 'pt' WHEN greatest(pt, en, es) = en THEN 'en' ELSE 'es' END AS language FROM v""",
)
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", txt.guess_language(F.col("text")).alias("language"))


@query(
    "text_budget",
    """SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, length(CASE WHEN ceil(length(text) / 3.5) <= 400 THEN text ELSE left(text, 1200) || chr(10) || chr(10) || '[…truncated to fit the response budget. Full content: doc]' END) AS kept,
      CASE WHEN length(text) <= 60 THEN text ELSE left(text, 60) || '…' END AS capped, length('<untrusted-content source="media">' || chr(10) || text || chr(10) || '</untrusted-content>') AS wrapped FROM documents""",
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", txt.estimate_tokens(c).alias("tokens"), F.length(txt.truncate_to_budget(c, 400, "doc")).cast("bigint").alias("kept"), txt.cap_text(c, 60).alias("capped"), F.length(txt.untrusted(c)).cast("bigint").alias("wrapped"))


@query(
    "time_formats",
    rf"""WITH {SEG}, s AS (SELECT media_id, seg_id, CAST(round(start_sec * 1000) AS BIGINT) AS ms, CAST(round(start_sec * 10) AS BIGINT) AS ds FROM seg)
    SELECT media_id, seg_id, CASE WHEN ds >= 36000 THEN (ds // 36000) || ':' || lpad(CAST(ds % 36000 // 600 AS VARCHAR), 2, '0') ELSE CAST(ds // 600 AS VARCHAR) END || ':' || lpad(CAST(ds % 600 // 10 AS VARCHAR), 2, '0') || '.' || ds % 10 AS said,
      lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt,
      ds / 10 AS back FROM s""",
)
def time_formats(spark: SparkSession, d: str) -> DataFrame:
    said = segments(spark, d).withColumn("said", times.format_time(F.col("start_sec")))
    return said.select("media_id", "seg_id", "said", times.srt_time(F.round("start_sec", 3)).alias("srt"), F.round(times.parse_time(F.col("said")), 1).alias("back"))


_URIS = [k for k in txt.ARTIFACTS if k not in ("sheet", "frame")]


@query(
    "text_artifact_uris",
    f"SELECT conv_id, turn, {', '.join(f"'strand://jobs/' || conv_id || '/{txt.ARTIFACTS[k]}' AS {k}" for k in _URIS)}, 'strand://jobs/' || conv_id || '/sheet/' || turn AS sheet, 'strand://jobs/' || conv_id || '/frame/' || turn AS frame, CASE WHEN length(text) > 7 THEN left(text, 4) || '…' || right(text, 3) END AS masked FROM conversations",
)
def artifact_uris(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    job = F.col("conv_id").cast("string")
    plain = [txt.artifact_uri(job, k).alias(k) for k in _URIS]
    return c.select("conv_id", "turn", *plain, txt.artifact_uri(job, "sheet", F.col("turn")).alias("sheet"), txt.artifact_uri(job, "frame", F.col("turn")).alias("frame"), F.when(F.length("text") > 7, txt.mask(F.col("text"))).alias("masked"))


@query(
    "text_glossary_words",
    r"""WITH w AS (SELECT conv_id, turn, i, ws[i] AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations)),
      n AS (SELECT *, regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') AS h FROM w),
      d AS (SELECT *, levenshtein(h, 'ertion') AS e FROM n)
    SELECT conv_id, turn, md5(string_agg(CASE WHEN h <> '' AND h <> 'ertion' AND e <= 2 AND e / greatest(length(h), 6) <= 0.34 THEN 'ertion' || regexp_extract(w, '[.,;:!?]+$', 0) ELSE w END, ' ' ORDER BY i)) AS text FROM d GROUP BY ALL""",
)
def glossary_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(glossary.correct_words(F.col("text"), "ertion")).alias("text"))


@query("text_glossary_phrases")
def glossary_phrases(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "conversations").withColumn("g", glossary.apply_glossary(F.col("text"), ["the ertion", "Thonre", "of in the"]))
    return made.select("conv_id", "turn", F.col("g.text").alias("text"), F.col("g.replacements").alias("replacements"))


@query("text_error_rates")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each answer against the question before it."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", before.alias("reference"), F.col("text").alias("hypothesis")).where("reference is not null")
    return rates.error_rates(pairs).drop("reference", "hypothesis")
