"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed character n-grams with weights ``(1 + ln tf) * idf``, scaled to unit length.  Document
frequencies count every training text.  The regression is trained online by follow-the-regularised-leader
steps with an elastic-net penalty, whose L1 part leaves most weights at zero; then one temperature is
fitted on texts set aside, so that scores are calibrated.

The regression is fitted on at most ``FIT_DOCS`` texts of each language (those with the smallest hash of
their id) and about ``FIT_ALL`` texts in all, documented bounds; where there are more languages than that
allows in full, each has an equal share, one text at least.  One in ``ASIDE`` of them sets the
temperature.  Every language is learned.  Prediction reads every whole text; only the text decides.

Nulls: a null text, or one without a letter, is ``und`` with score 0; very long texts are read whole.
Rows with a null id or language aren't learned from.  Repeated rows count in document frequencies as often
as they are, and are in the sample once.  Ties between languages go to the first by name.  With nothing to
learn from, all texts are ``und``; with one language only, texts with a letter get it with score 1.  An
empty table gives an empty result.  Extra columns pass through by ``predict`` if named, except that
``lang_pred`` and ``score`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, crc_mod, map_texts, rows_of
from strandline.llm.char_grams import grams

ORDERS, BITS = (1, 2, 3), 15
#: Texts of each language that the regression is fitted on, at most; one in ASIDE sets the temperature.
FIT_DOCS, ASIDE = 800, 5
#: Step size and its smoothing, elastic-net penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.002, 0.0005, 4
#: Texts of all languages that the regression is fitted on, about: it bounds what the driver holds.
FIT_ALL = 24_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def tf_idf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text, of unit length."""
    tf = np.bincount(grams(text, ORDERS, BITS), minlength=1 << BITS)
    at = np.flatnonzero(tf)
    x = (1 + np.log(tf[at])) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size else x


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (bucket, language)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, x = tf_idf(text, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and biases by FTRL-proximal steps; the bias isn't penalised."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zz) <= L1] = 0
        return w

    def bias() -> np.ndarray:
        return -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)

    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in rng.permutation(len(y)).tolist():
            at, x = rows[i]
            w, b = weights(at), bias()
            g = softmax(x @ w + b)
            g[y[i]] -= 1
            grad = x[:, None] * g
            was = n[at]
            now = was + grad * grad
            z[at] += grad - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
            n[at] = now
            now = n[size] + g * g
            z[size] += g - (np.sqrt(now) - np.sqrt(n[size])) / ALPHA * b
            n[size] = now
    return weights(slice(0, size)), bias()


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(y)), y], 1e-300)).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for (texts,) in rows_of(batch):
            for text in texts:
                tf = np.zeros(1 << BITS, bool)
                tf[grams(text, ORDERS, BITS)] = True
                df += tf
                n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for counts, cells in rows_of(batch):
            for c, cell in zip(counts, cells, strict=True):
                df += np.frombuffer(cell, np.int64)
                n += c
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])


def fit(labelled: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang)."""
    spark = labelled.sparkSession
    scratch = Scratch(spark, "language")
    rows = labelled.where("doc_id is not null and lang is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(1 << BITS), 1.0)
    # each partition's frequencies have one size; they are summed in a few tasks, then here
    partial = rows.select("text").mapInArrow(_frequencies, "n long, df binary")
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in partial.repartition(8).mapInArrow(_sum, "n long, df binary").collect():
        df += np.frombuffer(r["df"], np.int64)
        n += r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # the sample: ids under a hash bound that leaves a few times as many as are wanted, then the smallest
    wanted = max(1, min(FIT_DOCS, FIT_ALL // len(langs)))
    order, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), 1 << 31
    bound = spark.createDataFrame([(r["lang"], min(span, 4 * wanted * span // r["count"])) for r in counts], "lang string, bound long")
    keyed = rows.withColumn("v", F.xxhash64("text"))
    near = keyed.select("doc_id", "lang", "v", order.alias("o")).join(F.broadcast(bound), "lang").where(F.col("o") < F.col("bound")).select("doc_id", "lang", "v", "o").distinct()
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "v"))).where(F.col("r") <= wanted).select("doc_id", "lang", "v")
    sample = scratch.keep(keyed.join(F.broadcast(few), ["doc_id", "lang", "v"]).dropDuplicates(["doc_id", "lang", "v"]).select("doc_id", "text", "lang"), "sample")
    sent = spark.sparkContext.broadcast(idf.tobytes())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(sent.value)
        for batch in batches:
            for ids, texts, tags in rows_of(batch):
                made = [tf_idf(t, own) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], names=["doc_id", "lang", "at", "x"])

    held = sample.mapInArrow(features, "doc_id long, lang string, at binary, x binary").collect()
    held.sort(key=lambda r: (r["doc_id"], r["lang"], r["at"]))
    made = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in held]
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[r["lang"]] for r in held], np.int64)
    aside = np.arange(len(y)) % ASIDE == 0 if len(y) >= 10 * ASIDE else np.zeros(len(y), bool)
    train = np.flatnonzero(~aside)
    w, bias = ftrl([made[i] for i in train.tolist()], y[train], len(langs), 1 << BITS)
    logits = np.array([made[i][1] @ w[made[i][0]] + bias for i in np.flatnonzero(aside).tolist()]).reshape(-1, len(langs))
    scratch.drop(sample)
    return Model(langs, w.astype(np.float32), bias, idf, calibrate(logits, y[aside]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        own = sent.value

        def compute(texts: list) -> list[list]:
            made = [own.predict(t) for t in texts]
            return [[a for a, _ in made], [s for _, s in made]]

        return compute

    return map_texts(docs, "text", keep, {"lang_pred": "string", "score": "double"}, start)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, learned from those whose crc32 leaves another remainder of 4 than 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
