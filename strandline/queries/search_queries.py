"""Retrieval queries over documents; a document's source is its job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as txt
from strandline.operators import search
from strandline.queries.base import SEG, query, segments, table

QUERY = "tion and ered ble tion ingen"
_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)
_TOK = f"""
tok AS (SELECT doc_id, source AS job_id, text, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: len(x) > 1 AND NOT list_contains([{_STOP}], x)) AS t FROM documents),
job AS (SELECT job_id, count(*) AS n, sum(len(t)) / count(*) AS avg_len FROM tok GROUP BY job_id),
post AS (SELECT job_id, doc_id, token, count(*) AS tf FROM (SELECT job_id, doc_id, unnest(t) AS token FROM tok) GROUP BY ALL),
df AS (SELECT job_id, token, count(*) AS df FROM post GROUP BY ALL)
"""
_BM = f"""
q AS (SELECT unnest({search.query_tokens(QUERY)}) AS token),
hit AS (SELECT post.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (0.25 + 0.75 * len(t) / avg_len))) AS s
  FROM q JOIN post USING (token) JOIN df USING (job_id, token) JOIN job USING (job_id) JOIN tok ON tok.doc_id = post.doc_id GROUP BY post.doc_id),
bm AS (SELECT tok.doc_id, tok.job_id, tok.text, round(coalesce(s, 0), 8) AS bm25 FROM tok LEFT JOIN hit USING (doc_id))
"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("job_id"), "text")


@query("search_bm25_topk", f"WITH {_TOK}, {_BM} SELECT doc_id, job_id, round(bm25, 5) AS score FROM bm WHERE bm25 > 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = search.bm25(corpus(spark, d), QUERY).select("doc_id", "job_id", F.round(F.round("bm25", 8), 5).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("search_bm25_scores", f"WITH {_TOK}, {_BM} SELECT doc_id, round(bm25, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(corpus(spark, d), QUERY).select("doc_id", F.round(F.round("bm25", 8), 6).alias("score"))


@query("search_postings", f"WITH {_TOK} SELECT job_id, token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS most FROM post GROUP BY ALL")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(corpus(spark, d)).groupBy("job_id", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most"))


@query("search_corpus_stats", f"WITH {_TOK} SELECT job_id, n AS n_docs, round(avg_len, 6) AS avg_len FROM job")
def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.corpus_stats(corpus(spark, d)).select("job_id", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    """All documents, with the vector of the same id if there is one; the query's vector is that of the smallest id."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    probe = [float(x) for x in vectors.orderBy("doc_id").first()["embedding"]]
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("job_id"), "text", "source", F.lit(0.0).alias("start_sec"), F.when(F.col("doc_id") % 2 == 0, "speech").otherwise("screen").alias("kind"))
    return search.bm25(docs, QUERY).join(vectors, "doc_id", "left").withColumn("bm25", F.round("bm25", 8)), probe


_FUSED = """
v AS (SELECT vec_id AS doc_id, embedding FROM embeddings),
p AS (SELECT embedding AS q FROM v ORDER BY doc_id LIMIT 1),
pair AS (SELECT bm.*, round(coalesce(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 0), 8) AS vector FROM bm LEFT JOIN v USING (doc_id) CROSS JOIN p{where}),
ranked AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rb, row_number() OVER (ORDER BY vector DESC, doc_id) AS rv FROM pair),
fused AS (SELECT *, round(CASE WHEN bm25 > 0 THEN 1 / (60 + rb) ELSE 0 END + 1 / (60 + rv), 5) AS score FROM ranked),
once AS (SELECT *, row_number() OVER (PARTITION BY job_id, text ORDER BY score DESC, doc_id) AS r FROM fused)
SELECT doc_id, job_id, score, CAST(CASE WHEN bm25 > 0 THEN rb END AS INTEGER) AS bm25_rank, CAST(rv AS INTEGER) AS vector_rank FROM once WHERE r = 1 ORDER BY score DESC, doc_id LIMIT {k}
"""


def _top(scored: DataFrame, probe: list[float], k: int) -> DataFrame:
    ranked = search.vector_scores(scored, probe).withColumn("vector", F.round("vector", 8))
    return search.fused_top(ranked.drop("embedding"), k, "doc_id").select("doc_id", "job_id", "score", "bm25_rank", "vector_rank")


@query("search_hybrid_topk", f"WITH {_TOK}, {_BM}, {_FUSED.format(where='', k=12)}")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _top(*_hybrid(spark, d), 12)


@query("search_hybrid_kind", f"WITH {_TOK}, {_BM}, {_FUSED.format(where=' WHERE bm.doc_id % 2 = 1', k=8)}")
def hybrid_kind(spark: SparkSession, d: str) -> DataFrame:
    """The kind filter comes after the statistics, which cover both kinds."""
    scored, probe = _hybrid(spark, d)
    return _top(scored.where("kind = 'screen'"), probe, 8)


@query("search_not_indexed", "SELECT DISTINCT source AS job_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def not_indexed(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return search.not_indexed(docs.select("job_id").distinct(), docs.where("doc_id % 97 = 0"))


@query("search_docs_from_segments", f"WITH {SEG} SELECT media_id || ':s' || seg_id AS doc_id, media_id AS job_id, 'speech' AS kind, text, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, speaker, 'conversations' AS source FROM seg")
def docs_from_segments(spark: SparkSession, d: str) -> DataFrame:
    made = search.docs_from_segments(segments(spark, d), F.lit("conversations")).drop("embedding")
    return made.withColumns({"start_sec": F.round("start_sec", 3), "end_sec": F.round("end_sec", 3)})


@query("search_docs_from_frames", r"SELECT source || ':f' || doc_id AS doc_id, left(regexp_replace(text, '\s+', ' ', 'g'), 2000) AS text, CAST(doc_id AS DOUBLE) AS start_sec FROM documents WHERE length(trim(text)) > 3")
def docs_from_frames(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "documents").select(F.col("source").alias("media_id"), F.col("doc_id").alias("frame_idx"), F.col("doc_id").cast("double").alias("pts"), "text")
    return search.docs_from_frames(shown, F.lit("documents")).select("doc_id", "text", "start_sec")
