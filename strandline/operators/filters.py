"""Transcript quality: known phrases, repetition loops, silence, impossible rates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as txt

#: Phrases that speech models put over silence and noise.
PHRASES = (
    "thank you", "thanks for watching", "thanks for watching and i'll see you next time", "thank you so much for joining us", "thank you for watching", "see you next time",
    "see you in the next video", "subtitles by the amara org community", "subtitles by", "please subscribe", "don't forget to subscribe", "like and subscribe", "bye", "bye bye",
    "music", "applause", "laughter", "e aí", "é isso aí", "é isso aí galera", "obrigado", "obrigada", "obrigado por assistir", "obrigado por assistir até o final",
    "até a próxima", "até o próximo vídeo", "tchau", "tchau tchau", "legendas pela comunidade amara org", "legendas por", "inscreva-se no canal", "inscreva se no canal",
    "não se esqueça de se inscrever", "deixe o seu like", "eu não sei o que é isso", "eu não sei o que você está falando", "então me lembre-se me lembre-se me lembre-se",
    "música", "aplausos", "risos",
)


#: Phrases of a list that is broadcast, at most.
SHORT_LIST = 10_000


def normalised(s: str) -> str:
    """Lower case, compatibility forms, punctuation and symbols as blanks, blanks collapsed."""
    folded = unicodedata.normalize("NFKC", s.lower())
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in folded).split())


def blocklist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(phrase): the fixed phrases, or those of text files, one a line, ``#`` for comments."""
    if path is None:
        lines = spark.createDataFrame([(p,) for p in PHRASES], "value string")
    else:
        lines = spark.read.text(path)
    return lines.where((F.btrim("value") != "") & ~F.btrim("value").startswith("#")).select(txt.plain(F.col("value")).alias("phrase")).distinct()


def collapse(text: str | None) -> tuple[str | None, bool]:
    """The text with its first loop (a phrase of 3 to 6 words, three times or more in a row) said once."""
    words = (text or "").split()
    if len(words) < 9:
        return text, False
    bare = [normalised(w) for w in words]
    for n in range(3, 7):
        for i in range(len(words) - 3 * n + 1):
            reps = 1
            while bare[i + reps * n : i + (reps + 1) * n] == bare[i : i + n]:
                reps += 1
            if reps >= 3:
                return " ".join(words[: i + n] + words[i + reps * n :]), True
    return text, False


def _collapse_all(texts: pd.Series) -> pd.DataFrame:
    made = [collapse(t) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in made], "collapsed": [c for _, c in made]})


def collapse_repetition(text: Column) -> Column:
    """struct(text, collapsed)."""
    return F.pandas_udf(_collapse_all, "struct<text:string,collapsed:boolean>")(text)


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def filter_segments(segments: DataFrame, phrases: DataFrame, loops: bool = True) -> DataFrame:
    """Segments with ``duration`` and ``ratio`` -> text (loops said once), flags and keep.

    The phrase list is broadcast if it is short, as the fixed one is; a list from files may not be.
    """
    bare = segments.withColumn("__trim", F.btrim("text")).withColumn("__plain", txt.plain(F.col("text")))
    known = phrases.select(F.col("phrase").alias("__plain"), F.lit(True).alias("__known"))
    if len(known.take(SHORT_LIST + 1)) <= SHORT_LIST:
        known = F.broadcast(known)
    seen = bare.join(known, "__plain", "left")
    if loops:
        seen = seen.withColumn("__loop", F.when(words_in(F.col("__trim")) >= 9, collapse_repetition(F.col("__trim"))))
    else:
        seen = seen.withColumn("__loop", F.lit(None).cast("struct<text:string,collapsed:boolean>"))
    said = F.coalesce(F.col("__loop.text"), F.col("__trim"), F.lit(""))
    words = words_in(said)
    rate = words / F.greatest(F.lit(0.5), F.col("duration"))
    empty = F.coalesce(F.col("__trim"), F.lit("")) == ""
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.when(empty, F.array(F.lit("empty"))).otherwise(
        F.array_compact(
            F.array(
                flag(F.coalesce("__known", F.lit(False)), "blocklist"),
                flag(F.coalesce(F.col("__loop.collapsed"), F.lit(False)), "repetition_loop"),
                flag((F.col("ratio") < 0.15) & (F.col("duration") >= 1), "no_speech"),
                flag((rate > 8) & (words >= 8), "too_fast"),
            )
        )
    )
    out = seen.withColumn("text", said).withColumn("flags", flags)
    return out.withColumn("keep", ~F.arrays_overlap("flags", F.array(*map(F.lit, ("empty", "blocklist", "no_speech"))))).drop("__trim", "__plain", "__known", "__loop")


def drop_empty(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", F.btrim("text")).where(F.col("text") != "")


def readable_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with text that was read with some confidence."""
    return blocks.where((F.btrim("text") != "") & (F.col("confidence") >= 30))


