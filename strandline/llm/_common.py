"""Helpers shared by the training-data operators: scratch tables, word hashing, packed shuffles.

A *packed shuffle* moves numpy arrays as binary cells, one row per (batch, bucket), in place of one
row per element: the JVM handles thousands of rows where it would handle millions, and a reducer
sorts one bounded bucket at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULT = np.uint64(0x9E3779B97F4A7C15)


# -- scratch tables -----------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set one only where the session names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_by_code = sc._jsc.sc().getCheckpointDir()
        found = set_by_code.get() if set_by_code.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of applications that go at their end.
_left_behind: set[str] = set()
_made_here: ContextVar[list | None] = ContextVar("made_here", default=None)


@contextmanager
def released() -> Iterator[None]:
    """Scratch tables made inside are deleted at the end, when the result that reads them has been written."""
    made: list[Scratch] = []
    token = _made_here.set(made)
    try:
        yield
    finally:
        _made_here.reset(token)
        for scratch in made:
            scratch.delete()


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs only unwritten work.

    A step's shuffle files go as soon as its table is written.  The tables of an operator whose result is
    still to be computed stay: compute and write the result inside ``released()``, or call ``delete`` or
    ``clean_up`` afterwards.  What is left goes when the application ends.
    """

    #: Spark's setting for that.
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        own = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
        self.root = f"{own}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if own not in _left_behind:
            _left_behind.add(own)
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(path)
            files.deleteOnExit(path)
        if (made := _made_here.get()) is not None:
            made.append(self)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.n}-{name}"
        self.n += 1
        was = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, was) if was is not None else self.spark.conf.unset(self.CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strand_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._strand_path)

    def delete(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them must have been written."""
    _delete(spark, f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}")


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


# -- words --------------------------------------------------------------------------------------


class WordHasher(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound; the value never depends on the memory."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` lower-cases A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= MULT
        out += h[j : j + n]
    return mix(out + np.uint64(k))


# -- Arrow --------------------------------------------------------------------------------------


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[list]:
    """Columns of a batch as Python lists, few rows at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield [c.to_pylist() for c in part.columns]


def ints(cells: Iterable[bytes], dtype: str | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype)


def packed(bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One row per bucket: the bucket and each column's values in it as binary."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(bucket)]
    cells = [[int(b) for b in bucket[starts]]] if len(bucket) else [[]]
    for c in columns:
        c = c[order]
        cells.append([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] if len(bucket) else [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal leading columns in sorted batches: (key, the other columns as lists)."""
    key, held = None, None
    for batch in batches:
        for columns in rows_of(batch, 4096):
            names = list(zip(*columns[:keys], strict=True))
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != key:
                    if key is not None:
                        yield key, held
                    key, held = names[at], [[] for _ in columns[keys:]]
                for into, c in zip(held, columns[keys:], strict=True):
                    into.extend(c[at:to])
                at = to
    if key is not None:
        yield key, held


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_bucket(df: DataFrame, *order: str) -> DataFrame:
    """Deal packed rows out by bucket, each partition's buckets one after another."""
    n = shuffle_parts(df.sparkSession)
    return df.repartition(n, "bucket").sortWithinPartitions("bucket", *order)


def salted(big: DataFrame, small: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """``big`` joined with ``small`` on keys of which one may hold a large share of ``big``.

    Rows of ``big`` are dealt by the keys and a salt of column ``by``; ``small`` has one row a key, or few,
    which is copied once a salt.
    """
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    copied = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [*keys, "__salt"]).drop("__salt")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def map_texts(docs: DataFrame, text_col: str, keep: tuple[str, ...], made: dict[str, str], start: Callable[[], Callable[[list], list[list]]], step: int = 256) -> DataFrame:
    """``keep`` columns and the columns ``made`` (name: type) that ``start()`` computes from lists of texts.

    Kept columns may have any names; a made column replaces a kept one of its name.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [c for c in keep if c.lower() not in {m.lower() for m in made}]
    source = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("__text"))
    kept = source.schema.fields[:-1]
    schema = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in kept], *[(f"__m{i}", _KINDS[t]) for i, t in enumerate(made.values())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own = compute(part.column(part.num_columns - 1).to_pylist())
                columns = [part.column(i).cast(schema.types[i]) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, t) for c, t in zip(own, schema.types[len(kept) :], strict=True)]], schema=schema)

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"__m{i} {t}" for i, t in enumerate(made.values())]])
    out = source.mapInArrow(run, ddl)
    return out.toDF(*keep, *made)


def shielded(df: DataFrame, *own: str) -> DataFrame:
    """The table with all columns but the named ones renamed, so that no operator's names clash with them."""
    return df.toDF(*[c if c in own else f"__c{i}" for i, c in enumerate(df.columns)])


def unshielded(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """A table that came from ``shielded``, with just the columns there were, under their names."""
    return df.select(*[c if c in own else f"__c{i}" for i, c in enumerate(columns)]).toDF(*columns)


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)
