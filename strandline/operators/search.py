"""Hybrid retrieval: keyword scores per job, vector scores, rank fusion, top-k.

Keyword scores need no postings: a document's counts of the query's tokens are taken in place, and only
one row of statistics per job is aggregated and joined back.  Fusion takes the heads of both lists.
"""

from __future__ import annotations

import unicodedata
from re import split

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text as txt
from strandline.functions import vision

K1, B, FUSION = 1.4, 0.75, 60
#: Jobs whose statistics are broadcast, at most: some ten megabytes.
FEW_JOBS = 100_000


def query_tokens(query: str) -> list[str]:
    """The tokens of a query; a word that is given twice counts twice."""
    bare = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not "̀" <= c <= "ͯ")
    return [t for t in split("[^a-z0-9]+", bare) if len(t) > 1 and t not in txt.STOP_WORDS]


def postings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(job_id, doc_id, token, tf)."""
    return docs.select("job_id", "doc_id", F.explode(txt.search_tokens(F.col(text_col))).alias("token")).groupBy("job_id", "doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(job_id, n_docs, avg_len)."""
    return docs.select("job_id", F.size(txt.search_tokens(F.col(text_col))).alias("len")).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("len") / F.count(F.lit(1))).alias("avg_len"))


def _count(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def bm25(docs: DataFrame, query: str, text_col: str = "text") -> DataFrame:
    """The documents with ``bm25``; statistics are per job, over both kinds of document.

    One row of statistics a job is broadcast if a count of the jobs, over one column, finds them few, so the
    texts are not shuffled; with more jobs they meet by a join on the job.
    """
    tokens = query_tokens(query)
    words = list(dict.fromkeys(tokens))
    counted = docs.withColumn("__tokens", txt.search_tokens(F.col(text_col)))
    counted = counted.withColumn("__len", F.size("__tokens")).withColumn("__tf", F.array(*[_count("__tokens", w) for w in words]).cast("array<int>")).drop("__tokens")
    job = counted.groupBy("job_id").agg(F.count(F.lit(1)).alias("__n"), F.sum("__len").alias("__sum"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"__df{i}") for i in range(len(words))])
    few = docs.select("job_id").distinct().limit(FEW_JOBS + 1).count() <= FEW_JOBS
    joined = counted.join(F.broadcast(job) if few else job, "job_id")
    avg = F.col("__sum") / F.col("__n")
    total = F.lit(0.0)
    for w in tokens:
        i = words.index(w)
        f, df = F.col("__tf")[i], F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        total = total + F.when(f > 0, idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("__len") / avg))).otherwise(0.0)
    return joined.withColumn("bm25", total).drop("__len", "__tf", "__n", "__sum", *[f"__df{i}" for i in range(len(words))])


def vector_scores(docs: DataFrame, query: list[float], col: str = "embedding") -> DataFrame:
    """The documents with ``vector``: the dot product with the query's vector; 0 for a document without one."""
    return docs.withColumn("vector", F.coalesce(vision.dot(F.col(col), F.array(*[F.lit(float(x)) for x in query])), F.lit(0.0)))


def _keys(df: DataFrame, score: str, tie: tuple[str, ...]) -> Column:
    return F.struct((-F.col(score)).alias("s"), *[F.col(t).cast("long").alias(f"t{i}") for i, t in enumerate(tie)])


def _positions(scored: DataFrame, found: list, score: str, tie: tuple[str, ...]) -> dict[tuple, int]:
    """The place of each found row among all rows by falling score: rows are counted between the found ones, not sorted."""
    places = sorted({(-r[score], *[r[t] for t in tie]) for r in found})
    marks = F.array(*[F.struct(F.lit(p[0]).alias("s"), *[F.lit(int(x)).cast("long").alias(f"t{i}") for i, x in enumerate(p[1:])]) for p in places])
    below = F.size(F.filter(marks, lambda m: m <= _keys(scored, score, tie)))
    counts = {r["at"]: r["n"] for r in scored.groupBy(below.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, before = {}, 0
    for i, p in enumerate(places):
        before += counts.get(i, 0)
        out[p] = before + 1
    return out


def fused_top(scored: DataFrame, k: int = 8, *tie: str) -> DataFrame:
    """The k best rows of ``bm25`` and ``vector`` by reciprocal ranks over all rows, each passage once.

    Only rows among the first of either list can be in the result, so no global sort is made: the heads
    of both lists are taken, their exact places counted in one aggregation each, and the heads grow until
    nothing outside them can reach the k-th score.  Copies of a passage with equal scores are behind the
    first of them in both lists, so only that one can be shown and is taken, however many there are; all
    copies count for places.  ``score`` is rounded to five places, and ties go by the ``tie`` columns.
    """
    spark, depth, columns = scored.sparkSession, FUSION + 4 * k, scored.columns
    passage = F.xxhash64("source", F.round(F.coalesce("start_sec", F.lit(0.0)), 1), "text")
    slim = scored.select(*tie, "bm25", "vector", passage.alias("__passage")).persist()  # a few numbers a row; a lost part is computed again
    first = slim.groupBy("__passage", "bm25", "vector").agg(F.min(F.struct(*tie)).alias("__tie")).select("__tie.*", "bm25", "vector").persist()
    try:
        total = first.count()
        order = [F.col(t) for t in tie]
        while True:
            found = {tuple(r[t] for t in tie): r for by in ("bm25", "vector") for r in first.orderBy(F.desc(by), *order).limit(depth).collect()}
            if not found:
                break
            rank_bm, rank_vec = (_positions(slim, list(found.values()), by, tie) for by in ("bm25", "vector"))
            wanted = spark.createDataFrame(list(found), T.StructType([slim.schema[t] for t in tie]))
            rows = scored.drop("bm25", "vector").join(F.broadcast(wanted), list(tie), "left_semi").collect()  # scores are known
            hits = []
            for r in rows:
                at = tuple(r[t] for t in tie)
                bm, vec = found[at]["bm25"], found[at]["vector"]
                rb, rv = rank_bm[(-bm, *at)], rank_vec[(-vec, *at)]
                score = (1 / (FUSION + rb) if bm > 0 else 0.0) + 1 / (FUSION + rv)
                hits.append((round(score, 5), at, rb if bm > 0 else None, rv, r))
            hits.sort(key=lambda h: (-h[0], h[1]))
            seen, shown = set(), []
            for h in hits:
                key = (h[4]["source"], round(h[4]["start_sec"] or 0.0, 1), h[4]["text"])
                if key not in seen:
                    seen.add(key)
                    shown.append(h)
            if len(found) >= total or (len(shown) >= k and shown[k - 1][0] - 1e-5 > 2 / (FUSION + 1 + depth)):
                break
            depth *= 4
    finally:
        slim.unpersist()
        first.unpersist()
    schema = T.StructType([*scored.schema, T.StructField("score", T.DoubleType()), T.StructField("bm25_rank", T.IntegerType()), T.StructField("vector_rank", T.IntegerType())])
    made = [(*[found[at][c] if c in ("bm25", "vector") else r[c] for c in columns], s, rb, rv) for s, at, rb, rv, r in shown[:k]] if found else []
    return spark.createDataFrame(made, schema)


def search(docs: DataFrame, query: str, query_vector: list[float], k: int = 8, kind: str | None = None, jobs: list[str] | None = None) -> DataFrame:
    """Hybrid top-k over documents (schema ``DOCS``); ``kind`` filters after the statistics are taken."""
    if len(query) < 2:
        raise ValueError("a query has two characters at least")
    chosen = docs if jobs is None else docs.where(F.col("job_id").isin(jobs))
    scored = vector_scores(bm25(chosen, query), query_vector)
    if kind and kind != "both":
        scored = scored.where(F.col("kind") == kind)
    return fused_top(scored, k, "job_ord", "doc_ord")


def docs_from_segments(segments: DataFrame, source: Column, embed: Column | None = None) -> DataFrame:
    return segments.select(F.format_string("%s:s%d", "media_id", "seg_id").alias("doc_id"), F.col("media_id").alias("job_id"), F.lit("speech").alias("kind"), "text", "start_sec", "end_sec", "speaker", source.alias("source"), (embed if embed is not None else F.lit(None).cast("array<float>")).alias("embedding"))


def docs_from_frames(frames: DataFrame, source: Column, embed: Column | None = None) -> DataFrame:
    """Screen texts of more than three characters, blanks collapsed, 2,000 characters at most."""
    said = F.left(F.regexp_replace("text", r"\s+", " "), F.lit(2000))
    return frames.where(F.length(F.btrim("text")) > 3).select(F.format_string("%s:f%d", "media_id", "frame_idx").alias("doc_id"), F.col("media_id").alias("job_id"), F.lit("screen").alias("kind"), said.alias("text"), F.col("pts").alias("start_sec"), F.col("pts").alias("end_sec"), F.lit(None).cast("string").alias("speaker"), source.alias("source"), (embed if embed is not None else F.lit(None).cast("array<float>")).alias("embedding"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A stand-in for a text model, and no more than that: counts of hashed tokens, of length 1."""
    tokens = txt.search_tokens(text)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(tokens, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dim)) == i)).cast("double"))
    return vision.unit(counts).cast("array<float>")


def not_indexed(jobs: DataFrame, index: DataFrame) -> DataFrame:
    """Jobs that an index has nothing of yet."""
    return jobs.join(index.select("job_id").distinct(), "job_id", "left_anti")


def write_index(docs: DataFrame, path: str) -> None:
    """Adds documents, a folder per job; a job that is written again is replaced."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    from strandline.schemas import DOCS

    return spark.read.schema(DOCS).parquet(path)


def scope(finished: list[str], which: str | None = None, job_id: str | None = None) -> tuple[list[str], list[str] | None]:
    """Jobs to index first, and jobs to search (None: all that are indexed).

    The scope is the job if one is given, else all. Asking for a job's scope without a job indexes
    nothing and searches everything.
    """
    chosen = which or ("job" if job_id else "all")
    if chosen == "job":
        return [j for j in finished if j == job_id], [job_id] if job_id else None
    return list(finished), None
