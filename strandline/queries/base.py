"""The tables that stand in for media, the same in Spark and in SQL.

Conversations are transcripts: a turn is a segment of 0.4 s a word, 0.2 s apart.  Events of a user are a
medium's frames, one a second, and its speech probabilities.  Orders are jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    ms = F.size(F.split(F.trim("text"), r"\s+")) * 400
    w = Window.partitionBy("conv_id").orderBy("turn")
    placed = t.withColumn("ms", ms).withColumn("end_ms", F.sum(F.col("ms") + 200).over(w) - 200)
    return placed.select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn").cast("int").alias("seg_id"), ((F.col("end_ms") - F.col("ms")) / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"), "text", F.col("role").alias("speaker"))


SEG = r"""
placed AS (SELECT *, len(regexp_split_to_array(trim(text), '\s+')) * 400 AS ms FROM conversations),
ends AS (SELECT *, sum(ms + 200) OVER (PARTITION BY conv_id ORDER BY turn) - 200 AS end_ms FROM placed),
seg AS (SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(turn AS INTEGER) AS seg_id, (end_ms - ms) / 1000 AS start_sec, end_ms / 1000 AS end_sec, text, role AS speaker FROM ends)
"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Speech under two of three segments, starting late and ending early."""
    s = segments(spark, d)
    own = (F.col("seg_id") + F.col("media_id").cast("int")) % 3
    return s.where(own != 2).select("media_id", F.col("seg_id").alias("region_id"), (F.col("start_sec") + 0.5).alias("start_sec"), (F.col("end_sec") - 0.25).alias("end_sec")).where("end_sec > start_sec")


REG = """reg AS (SELECT * FROM (SELECT media_id, seg_id AS region_id, start_sec + 0.5 AS start_sec, end_sec - 0.25 AS end_sec FROM seg WHERE (seg_id + CAST(media_id AS INTEGER)) % 3 <> 2) WHERE end_sec > start_sec)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A turn every five seconds, of three speakers."""
    last = segments(spark, d).groupBy("media_id").agg(F.max("end_sec").alias("end"))
    k = last.select("media_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / 5).cast("int"))).alias("turn_no"))
    who = F.format_string("SPEAKER_%02d", (F.col("turn_no") * 7 + F.col("media_id").cast("int")) % 3)
    return k.select("media_id", "turn_no", (F.col("turn_no") * 5 + (F.col("turn_no") % 3) * 0.25).alias("start_sec"), (F.col("turn_no") * 5 + 4.5).alias("end_sec"), who.alias("speaker"), (F.lit(0.5) + (F.col("turn_no") % 5) / 10).alias("confidence"))


TURN = """
lasts AS (SELECT media_id, max(end_sec) AS e FROM seg GROUP BY media_id),
turns AS (SELECT media_id, k AS turn_no, k * 5 + (k % 3) * 0.25::DOUBLE AS start_sec, k * 5 + 4.5::DOUBLE AS end_sec, 'SPEAKER_0' || ((k * 7 + CAST(media_id AS INTEGER)) % 3) AS speaker, 0.5::DOUBLE + (k % 5) / 10 AS confidence
  FROM (SELECT media_id, CAST(unnest(range(0, CAST(floor(e / 5) AS INTEGER) + 1)) AS INTEGER) AS k FROM lasts))
"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx")
    h = F.shiftright(F.col("event_id") * F.lit(2654435761), 7).bitwiseAND(F.lit(4095))
    own = e.select(F.col("user_id").cast("string").alias("media_id"), idx, "event_id", "event_type", "value", h.cast("bigint").alias("dhash"))
    return own.withColumn("pts", F.col("idx").cast("double"))


FRAMES = """fr AS (SELECT CAST(user_id AS VARCHAR) AS media_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS idx, event_id, event_type, value, ((event_id * 2654435761) >> 7) & 4095 AS dhash,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS DOUBLE) AS pts FROM events)"""


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Speech probabilities that hold for four frames."""
    p = (F.floor(F.col("idx") / 4) * 7919 + F.col("media_id").cast("bigint") * 31) % 1000 / 1000
    return frames(spark, d).select("media_id", "idx", p.alias("p"))


PROBS = "probs AS (SELECT media_id, idx, (CAST(floor(idx / 4) AS BIGINT) * 7919 + CAST(media_id AS BIGINT) * 31) % 1000 / 1000 AS p FROM fr)"

NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = lambda n: F.expr(f"o_orderdate + make_dt_interval(0, 0, 0, cast({n} as decimal(18,6)))")
    kind = F.element_at(F.array(*map(F.lit, ("transcribe", "keyframes", "read_screen", "review", "diarize"))), (k % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed", "cancelled", "completed", "running"))), (k % 7 + 1).cast("int"))
    ident = F.concat(F.lit("j_"), F.lpad(F.lower(F.hex(k)), 12, "0"))
    started = F.when(k % 7 != 0, at("o_orderkey % 50"))
    return table(spark, d, "orders").select(
        ident.alias("id"), kind.alias("kind"), status.alias("status"), (k % 101 / 100).alias("fraction"), F.col("o_orderdate").alias("created_at"), started.alias("started_at"),
        F.when(status.isin("completed", "failed", "cancelled"), at("o_orderkey % 50 + 60 + o_orderkey % 900")).alias("finished_at"), at("o_orderkey % 977").alias("updated_at"),
        F.when(k % 3 == 0, at("o_orderkey % 4001")).alias("heartbeat_at"), F.lit(None).cast("string").alias("error_code"),
    )


JOBS = """jobs AS (SELECT 'j_' || lpad(lower(hex(o_orderkey)), 12, '0') AS id, ['transcribe', 'keyframes', 'read_screen', 'review', 'diarize'][o_orderkey % 5 + 1] AS kind,
  ['queued', 'running', 'completed', 'failed', 'cancelled', 'completed', 'running'][o_orderkey % 7 + 1] AS status, o_orderkey % 101 / 100 AS fraction, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 50) END AS started_at,
  CASE WHEN o_orderkey % 7 IN (2, 3, 4, 5) THEN o_orderdate + to_seconds(o_orderkey % 50 + 60 + o_orderkey % 900) END AS finished_at,
  o_orderdate + to_seconds(o_orderkey % 977) AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_seconds(o_orderkey % 4001) END AS heartbeat_at FROM orders)"""
