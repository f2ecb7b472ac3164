"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

1. language: documents whose language can't be told (no letters, or a score under ``LANGUAGE_SCORE``) go.
2. lines: lines of recurring templates are cut from all documents but the first that holds them.
3. similar: of each group of near-copies (five-word shingles, 80 % in common) the smallest id stays.
4. passages: words in 13-word windows that a document with a smaller id also has are cut.
5. packing: what is left is packed into bins; the result has one row per piece.

Stages 1 to 4 return the columns of ``documents``, whatever further ones there are and whatever their names;
``n_chars`` follows the text.  A document that a stage
leaves without words, but came with some, goes.  A null or wordless text has no letter and goes in
stage 1.  Rows that repeat an id stay together through stages 1 and 2 and are one document in stage 3,
which keeps them all or none.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import jaccard_join, language_id, line_dedup, packing, substring_dedup
from strandline.llm._common import Scratch, released, shielded, unshielded

#: The least calibrated score of a language that is believed: far under any clean text's.
LANGUAGE_SCORE = 0.4


def _with_text(made: DataFrame, columns: list[str], changed: Column) -> DataFrame:
    """The columns of documents, with ``n_chars`` following the text where that has changed."""
    hidden = {f"__c{i}" for i, c in enumerate(columns) if c == "n_chars"}
    count = {h: F.when(changed & F.col("text").isNotNull(), F.length("text").cast(made.schema[h].dataType)).otherwise(F.col(h)) for h in hidden}
    return unshielded(made.withColumns(count) if count else made, columns, "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what it rejects goes."""
    own = shielded(docs, "doc_id", "text", "lang")
    model = language_id.fit(own)
    told = language_id.predict(own, model, keep=tuple(own.columns))
    return unshielded(told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)), docs.columns, "doc_id", "text", "lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: recurring lines are cut; a document that was nothing else goes."""
    made, changed = line_dedup.dedup_lines(shielded(docs, "doc_id", "text")), F.col("n_dropped") > 0
    return _with_text(made.where(~changed | (packing.word_count(F.col("text")) > 0)), docs.columns, changed)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near-copies stays."""
    own = shielded(docs, "doc_id", "text")
    groups = jaccard_join.similar_texts(own, k=5, num=80, den=100)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return unshielded(own.join(gone, own.doc_id == F.col("__gone"), "left_anti"), docs.columns, "doc_id", "text")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated passages are cut; a document that was nothing else goes."""
    own, changed = shielded(docs, "doc_id", "text"), F.col("n_removed") > 0
    made = substring_dedup.dedup_substrings(own, 13, tuple(c for c in own.columns if c not in ("doc_id", "text")))
    return _with_text(made.where(~changed | (F.col("n_removed") < F.col("n_words"))), docs.columns, changed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of documents in bins."""
    return packing.pack_texts(docs)


STAGES = [("language", language), ("lines", lines), ("similar", similar), ("passages", passages), ("packing", packed)]

#: SQL can't express the trained language model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    What a stage wrote for itself, and its input, are deleted when its result has been written.
    """
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
