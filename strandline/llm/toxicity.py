"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it holds, counted once.  Each is scaled by the log of
the ratio of its share in toxic and in other training texts; logistic regression with an L2 penalty is
fitted on the scaled features.  Features seen in fewer than ``MIN_DOCS`` training texts or with a ratio
near 1 weigh nothing.

Training reads at most ``FIT_DOCS`` labelled texts of each class (those with the smallest hash of their
id), a documented bound; scoring reads every whole text.  Only a text decides its score.

Nulls and empty texts hold no n-gram and get the score of the intercept; very long texts are read whole.
Rows with a null id or label aren't learned from.  Rows that repeat an id, text and label are learned
once, whatever their number; an id with two labels or two texts is learned with each.  Texts of equal
hash rank by id.  If either class is missing, all scores are the share of toxic texts among those seen
(0.0 if none).  An empty table gives an empty result.  Extra columns pass through by ``score_texts`` if
named, except that ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, crc_mod, map_texts, rows_of
from strandline.llm.char_grams import grams

ORDERS, BITS = (3, 4, 5), 20
#: Labelled texts of each class that are learned from, at most.
FIT_DOCS = 4_000
#: Training texts that must hold a feature, and the least log ratio for it to count.
MIN_DOCS, MIN_RATIO = 6, 1.5
L2, ROUNDS = 0.002, 200


@dataclass
class Model:
    weights: np.ndarray  # by bucket, ratio included
    bias: float

    def score(self, text: str | None) -> float:
        b = grams(text, ORDERS, BITS)
        b = np.unique(b[self.weights[b] != 0])
        z = float(self.weights[b].astype(np.float64).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _presence(texts: list[str | None]) -> list[np.ndarray]:
    return [np.unique(grams(t, ORDERS, BITS)) for t in texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each bucket, as sparse arrays, one row per partition."""
    counts, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for batch in batches:
        for texts, labels in rows_of(batch):
            for b, y in zip(_presence(texts), labels, strict=True):
                counts[y, b] += 1
                n[y] += 1
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        yield pa.RecordBatch.from_arrays([pa.array([y]), pa.array([n[y]]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([counts[y, at].astype(np.int32).tobytes()], pa.binary())], names=["y", "n", "at", "c"])


def _features(used: np.ndarray) -> Callable:
    schema = pa.schema([("y", pa.int64()), ("at", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(used, bitorder="little").astype(bool)
        for batch in batches:
            for texts, labels in rows_of(batch):
                held = [b[mask[b]].astype(np.int32).tobytes() for b in _presence(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(held, pa.binary())], schema=schema)

    return run


def logistic(starts: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows, classes weighted alike, by Adam steps."""
    w, bias = np.zeros(size), 0.0
    row = np.repeat(np.arange(len(y)), np.diff(np.r_[starts, len(features)]))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[features] * values, minlength=len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        grad = np.bincount(features, weights=g[row] * values, minlength=size) + L2 * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, bias


def few_of_each(rows: DataFrame) -> DataFrame:
    """At most FIT_DOCS distinct rows of each class, those with the smallest hash of their id."""
    once = rows.distinct()
    order = [F.xxhash64("doc_id"), *rows.columns]
    return once.where("toxic = 1").orderBy(*order).limit(FIT_DOCS).unionAll(once.where("toxic = 0").orderBy(*order).limit(FIT_DOCS))


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, toxic)."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = labelled.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"), F.xxhash64("text").alias("v"))
    picked = few_of_each(rows.select("doc_id", "toxic", "v"))
    # a row that repeats comes once, so the sample has as many rows as were picked
    sample = scratch.keep(rows.join(F.broadcast(picked), ["doc_id", "toxic", "v"]).dropDuplicates(["doc_id", "toxic", "v"]).select("text", "toxic"), "sample")
    counts, n = np.zeros((2, 1 << BITS)), [0, 0]
    for r in sample.select("text", "toxic").coalesce(8).mapInArrow(_count, "y long, n long, at binary, c binary").toLocalIterator():
        counts[r["y"], np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["c"], np.int32)
        n[r["y"]] += r["n"]
    if not n[0] or not n[1]:
        scratch.drop(sample)
        share = n[1] / max(1, sum(n))
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    use = (counts.sum(axis=0) >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    held = sample.select("text", "toxic").mapInArrow(_features(np.packbits(use, bitorder="little")), "y long, at binary").collect()
    held.sort(key=lambda r: (r["y"], r["at"]))  # the sum of floats then doesn't depend on the order of tasks
    y = np.array([r["y"] for r in held])
    parts = [np.frombuffer(r["at"], np.int32) for r in held]
    starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    features = np.concatenate(parts)
    number = np.zeros(1 << BITS, np.int64)
    kept = np.flatnonzero(use)
    number[kept] = np.arange(len(kept))
    w, bias = logistic(starts, number[features], ratio[features], y, len(kept))
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w * ratio[kept]
    scratch.drop(sample)
    return Model(weights, bias)


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))

    def start() -> Callable:
        raw, bias = sent.value
        own = Model(np.frombuffer(raw, np.float32), bias)

        def compute(texts: list) -> list[list]:
            score = [own.score(t) for t in texts]
            return [score, [int(s >= 0.5) for s in score]]

        return compute

    return map_texts(docs, "text", keep, {"score": "double", "predicted": "int"}, start)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, learned from the labels whose crc32 is no multiple of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 5) != 0)
    # the same bound as in fit, before the texts are joined: at most FIT_DOCS ids of each class
    few = few_of_each(usable.select("doc_id", F.col("toxic").cast("long").alias("toxic")))
    model = fit(docs.join(F.broadcast(few), "doc_id"))
    return score_texts(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
