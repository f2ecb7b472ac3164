"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role, same text) of the two conversations of a pair is rendered
once, as the prompt; what follows in each is rendered as its completion, with the spans of characters to
train on: the texts of assistant turns and their end marks.  All in DataFrame operations: turns are
ordered inside the array of their conversation, so rows may come in any order.

A conversation is one row of the result, as its rendering is one text; pairs of any number spread by id.

Nulls: a null role or text is an empty one; turns with a null number come first, turns without a pair id
are left out.  A pair with one side only has that side's turns as its completion and an empty prompt.
Equal conversations have two empty completions.  Repeated rows of a turn count once; turns that share a
number come in the order of their role and text, as bytes.  Marks inside a text or a role are broken by a
blank, and a role's line breaks become blanks, so neither can end its turn.  Texts of any length are whole.
Extra columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>\n"


def _turns(side: DataFrame, name: str) -> DataFrame:
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.translate(clean("role"), "\r\n", "  ").alias("role"), clean("text").alias("text"))
    return side.where("pair_id is not null").groupBy("pair_id").agg(F.array_sort(F.collect_set(row)).alias(name))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """``from:to`` of each span to train on, in characters of the completion."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(len(START) + 1) + F.length(t["role"])
        end = start + F.length(t["text"]) + F.lit(len(END))
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, state, step, lambda acc: acc["spans"]), ",")


def _parts(turns: Column) -> Column:
    """The completion in pieces, each with whether it is trained on."""
    piece = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(piece(F.concat(F.lit(START), t["role"], F.lit("\n")), F.lit(False)), piece(F.concat(t["text"], F.lit(END)), t["role"] == "assistant"))))


def format_preferences(chosen: DataFrame, rejected: DataFrame, parts: bool = False) -> DataFrame:
    """Two tables (pair_id, turn, role, text) -> pair_id, n_prompt_turns, prompt, and each side's completion and spans.

    With ``parts``, also each completion as pieces (text, train), for tokenizers that mask by piece.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id", "full").select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    differs = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] != y["role"]) | (x["text"] != y["text"]), F.lit(True)))
    first = F.array_position(differs, F.lit(True))
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))

    def rest(side: str) -> Column:
        return F.filter(F.col(side), lambda _, i: i >= F.col("n"))

    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _rendered(F.filter("c", lambda _, i: i < F.col("n"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"),
        _spans(rest("c")).alias("chosen_spans"),
        _rendered(rest("r")).alias("rejected"),
        _spans(rest("r")).alias("rejected_spans"),
        *([_parts(rest("c")).alias("chosen_parts"), _parts(rest("r")).alias("rejected_parts")] if parts else []),
    )


#: The place of a turn without a number: before all others.
UNNUMBERED = -(1 << 63)


def stale_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from conversations: up to the last answer as it is; and with that answer replaced by the first one, or by nothing if it is the only one."""
    known = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(UNNUMBERED)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct("turn", "text"))
    answers = known.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"), first["turn"].alias("first"), first["text"].alias("stale"))
    turns = known.join(answers, "pair_id").where("turn <= last")
    worse = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.when(F.col("first") < F.col("last"), F.col("stale")).otherwise(F.lit(""))).otherwise(F.col("text"))
    return turns.select("pair_id", "turn", "role", "text"), turns.select("pair_id", "turn", "role", worse.alias("text"))


def op8_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference pair for every conversation that has an answer."""
    return format_preferences(*stale_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: DuckDB's answer for op8_preference_chat.
OP8_SQL = r"""
WITH known AS (
  SELECT conv_id AS p, coalesce(CAST(turn AS BIGINT), -9223372036854775808) AS t, role AS said_by, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT p, max(t) AS last, min(t) AS first, arg_min(text, (t, text)) AS stale FROM known WHERE said_by = 'assistant' GROUP BY p
), turns AS (
  SELECT p, t, replace(replace(replace(coalesce(said_by, ''), '<|', '< |'), chr(13), ' '), chr(10), ' ') AS role, text AS c,
         CASE WHEN t = last AND said_by = 'assistant' THEN CASE WHEN first < last THEN stale ELSE '' END ELSE text END AS r
  FROM known JOIN answers USING (p) WHERE t <= last
), sides AS (
  SELECT DISTINCT p, 'c' AS side, t, role, replace(c, '<|', '< |') AS text FROM turns UNION ALL SELECT DISTINCT p, 'r', t, role, replace(r, '<|', '< |') FROM turns
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY p, side ORDER BY t, role, text) AS pos, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS turn FROM sides
), differ AS (
  SELECT p, min(pos) AS from_pos FROM (SELECT p, pos FROM placed GROUP BY p, pos HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY p
), parts AS (
  SELECT placed.*, pos < coalesce(from_pos, 1e18) AS common FROM placed LEFT JOIN differ USING (p)
), spans AS (
  SELECT *, coalesce(sum(length(turn)) FILTER (NOT common) OVER (PARTITION BY p, side ORDER BY pos), 0) AS ends FROM parts
)
SELECT p AS pair_id, CAST(count(*) FILTER (common AND side = 'c') AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (common AND side = 'c'), '') AS prompt,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (NOT common AND side = 'c'), '') AS chosen,
       coalesce(string_agg(CAST(ends - length(text) - 11 AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY pos) FILTER (NOT common AND side = 'c' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(turn, '' ORDER BY pos) FILTER (NOT common AND side = 'r'), '') AS rejected,
       coalesce(string_agg(CAST(ends - length(text) - 11 AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY pos) FILTER (NOT common AND side = 'r' AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY p
"""
