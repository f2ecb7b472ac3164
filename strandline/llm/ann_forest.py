"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree splits by random directions, one a level, at the medians of a sample; largest inner product
becomes least distance by one more component that gives all vectors the same length.  The depth follows
the number of vectors, so a leaf holds about ``LEAF`` at every size.  A query walks all trees through one
priority queue, least sum of squared distances to the planes it crosses first, until it has taken the
calibrated number of leaves.  Leaf candidates are then ranked exactly, in double precision, on the
original vectors.

The forest is fitted on at most ``SAMPLE`` vectors (those with the smallest hash of their id), a
documented bound; every vector is indexed.  Nodes with fewer than ``NODE`` sampled vectors are cut where
their last ancestor with as many has its median in the level's direction.  The number of leaves is the least that
finds ``TARGET_RECALL`` of the true neighbours of ``PROBES`` sampled vectors, a fixed number of queries
that are held against all vectors in blocks for this.  So it
follows how hard the data are, not how many they are: few leaves on clustered vectors, a large share of
them on noise.

Leaves are dealt out in blocks of a bounded number of vectors, each visited by its queries in stretches;
a block returns one packed row per query, with its best.  Equal vectors are one entry with its ``k + 1``
smallest ids, which is all that can be among the nearest, so a very common vector fills no leaf.

Vectors that are null, zero, of another length than most, or hold a null or non-finite component, take
no part.  Rows with a null id are ignored.  Rows that repeat an id and vector count once; an id with two
vectors is found by the better.  Ties go to the smaller id.  Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, grouped, shuffle_parts

SAMPLE, PROBES, TARGET_RECALL = 16_384, 256, 0.95
#: Trees, vectors in a leaf, about, and sampled vectors of the smallest node whose median is taken.
TREES, LEAF, NODE = 8, 256, 16
#: Vectors in a block of a leaf, about, and queries that are ranked at a time.
BLOCK, STRETCH = 32_768, 128
#: Repeated vectors that a task gathers before it sends them.
WAITING = 4_096


@dataclass
class Forest:
    planes: np.ndarray  # (tree, level, dim + 1)
    cuts: np.ndarray  # (tree, node from 1) of the upper levels
    deep: np.ndarray  # (tree, node at the last upper level, further level)
    longest: float  # length of the longest vector
    leaves: int = 1  # a query takes so many

    @property
    def depth(self) -> int:
        return self.planes.shape[1]

    @property
    def upper(self) -> int:
        return self.depth - self.deep.shape[2]

    @property
    def first_leaf(self) -> int:
        return 1 << self.depth

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes them equally long."""
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]])

    def cut(self, t: int, level: int, node: np.ndarray) -> np.ndarray:
        if level < self.upper:
            return self.cuts[t, node]
        return self.deep[t, (node >> (level - self.upper)) - (1 << self.upper), level - self.upper]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(vector, tree) -> leaf, from 0."""
        y = self.lifted(x)
        along = (y @ self.planes.reshape(-1, y.shape[1]).T).reshape(len(x), len(self.planes), self.depth)
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (along[:, t, level] > self.cut(t, level, node))
            out[:, t] = node - self.first_leaf
        return out

    def search(self, query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The first leaves (tree, leaf) of a query, by the shared queue."""
        trees = len(self.planes)
        if not self.depth:
            return [(t, 0) for t in range(min(leaves, trees))]
        unit = query / np.sqrt((query * query).sum())
        along = (self.planes[:, :, :-1] @ unit).tolist()
        cuts, deep, upper, depth = self.cuts, self.deep, self.upper, self.depth
        queue, out = [(0.0, t, 1, 0) for t in range(trees)], []
        while queue and len(out) < leaves:
            cost, t, node, level = heapq.heappop(queue)
            while level < depth:
                d = along[t][level] - (cuts.item(t, node) if level < upper else deep.item(t, (node >> (level - upper)) - (1 << upper), level - upper))
                near = 2 * node + (d > 0)
                level += 1
                heapq.heappush(queue, (cost + d * d, t, near ^ 1, level))
                node = near
                if level < depth and queue[0][0] < cost:
                    heapq.heappush(queue, (cost, t, node, level))
                    break
            else:
                out.append((t, node - self.first_leaf))
        return out


def grow(sample: np.ndarray, longest: float, count: int, seed: int = 0) -> Forest:
    """A forest for so many vectors, fitted on a sample of them."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))
    upper = int(np.clip(np.floor(np.log2(max(1, len(sample)) / NODE)), 0, depth))
    planes = rng.standard_normal((TREES, depth, sample.shape[1] + 1))
    planes /= np.sqrt((planes**2).sum(axis=2, keepdims=True))
    forest = Forest(planes, np.zeros((TREES, 1 << upper)), np.zeros((TREES, 1 << upper, depth - upper)), longest)
    y = forest.lifted(sample)
    for t in range(TREES):
        along, node = y @ planes[t].T, np.ones(len(y), np.int64)
        for level in range(upper):
            for n in np.unique(node).tolist():
                forest.cuts[t, n] = np.median(along[node == n, level])
            node = 2 * node + (along[:, level] > forest.cuts[t, node])
        if depth > upper:
            forest.deep[t] = np.median(along[:, upper:], axis=0)
            for n in np.unique(node).tolist():
                forest.deep[t, n - (1 << upper)] = np.median(along[node == n, upper:], axis=0)
    return forest


def calibrated(forest: Forest, probes: np.ndarray, nearest: list[np.ndarray]) -> int:
    """The least number of leaves, of rising steps, that hold the target share of the probes' nearest vectors."""
    total = TREES * forest.first_leaf
    where = [forest.leaf_of(x) + np.arange(TREES) * forest.first_leaf for x in nearest]
    leaves = TREES
    while leaves < total and any(map(len, nearest)):
        found = []
        for q, own in zip(probes, where, strict=True):
            if len(own):
                taken = np.array([t * forest.first_leaf + leaf for t, leaf in forest.search(q, leaves)])
                found.append(np.isin(own, taken).any(axis=1).mean())
        if np.mean(found) >= TARGET_RECALL:
            return leaves
        leaves = leaves + max(1, leaves // 4)
    return total


# -- tables --------------------------------------------------------------------------------------


def usable_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct usable vectors: ``vec`` (doubles as binary) and the k + 1 smallest of their ids."""
    v = F.col("embedding")
    sizes = vectors.where(v.isNotNull()).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dim = sizes[0]["size"] if sizes else 0
    schema = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def entries(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), schema.types[1])], schema=schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[bytes, list[int]] = {}  # a vector that repeats in a batch waits, so a very common one is sent once
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            ids, cells = batch.column(0), batch.column(1)
            x = np.ma.filled(cells.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan).reshape(len(ids), -1) + 0.0
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            for i in np.flatnonzero(good).tolist():
                seen.setdefault(x[i].tobytes(), []).append(ids[i].as_py())
            for vec in [vec for vec, own in seen.items() if len(own) > 1 or vec in common]:
                common[vec] = sorted({*common.get(vec, ()), *seen.pop(vec)})[: k + 1]
            if seen:
                yield entries(seen)
            if len(common) > WAITING:
                yield entries(common)
                common = {}
        if common:
            yield entries(common)

    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == dim) & (F.size(v) > 0)).select(F.col("vec_id").cast("long"), "embedding")
    once = rows.mapInArrow(clean, "vec binary, ids array<long>").groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return once.select("vec", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells)).reshape(len(cells), -1)


def nearest_of(entries: DataFrame, probes: np.ndarray, k: int) -> list[np.ndarray]:
    """The k vectors of largest inner product with each probe, itself aside; a task keeps k + 1 a probe."""
    sent = entries.sparkSession.sparkContext.broadcast(probes)
    schema = pa.schema([("probe", pa.int64()), ("scores", pa.binary()), ("vecs", pa.binary())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scores, vecs = np.empty((len(own), 0)), np.empty((len(own), 0, own.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096).to_pylist())
                new = own @ x.T
                top = np.argpartition(-new, min(k, len(x) - 1), axis=1)[:, : k + 1]
                scores = np.hstack([scores, np.take_along_axis(new, top, axis=1)])
                vecs = np.concatenate([vecs, x[top]], axis=1)
                keep = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                scores, vecs = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(vecs, keep[:, :, None], axis=1)
        if scores.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array([s.tobytes() for s in scores], pa.binary()), pa.array([v.tobytes() for v in vecs], pa.binary())], schema=schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (probe,), (scores, vecs) in grouped(batches, 1):
            score, x = np.frombuffer(b"".join(scores)), _matrix([b"".join(vecs)]).reshape(-1, sent.value.shape[1])
            x = x[np.argsort(-score, kind="stable")[: k + 1]]
            x = x[(x != sent.value[probe]).any(axis=1)][:k]
            yield pa.RecordBatch.from_arrays([pa.array([probe]), pa.array([b""], pa.binary()), pa.array([x.tobytes()], pa.binary())], schema=schema)

    ddl = "probe long, scores binary, vecs binary"
    parts = shuffle_parts(entries.sparkSession)
    rows = entries.select("vec").mapInArrow(best, ddl).repartition(parts, "probe").sortWithinPartitions("probe").mapInArrow(merged, ddl).collect()
    found = {r["probe"]: np.frombuffer(bytes(r["vecs"])).reshape(-1, probes.shape[1]) for r in rows}
    return [found[i] for i in range(len(probes))]


def _place(forest: object, salts: int) -> Callable:
    """Each vector once per tree, in its leaf's block; each query once per leaf it takes and block of that leaf."""
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("query", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Forest = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                kinds, queries, vecs, ids = (c.to_pylist() for c in batch.slice(at, 256).columns)
                x, rows = _matrix(vecs), []
                stored = [i for i, kind in enumerate(kinds) if kind == 0]
                if stored:
                    leaves = own.leaf_of(x[stored])
                    for i, mine in zip(stored, leaves.tolist(), strict=True):
                        salt = (ids[i][0] * 2654435761 >> 7) % salts
                        rows += [((t * own.first_leaf + leaf) * salts + salt, 0, None, vecs[i], ids[i]) for t, leaf in enumerate(mine)]
                for i, kind in enumerate(kinds):
                    if kind == 1:
                        for t, leaf in own.search(x[i], own.leaves):
                            rows += [((t * own.first_leaf + leaf) * salts + s, 1, queries[i], vecs[i], None) for s in range(salts)]
                for to in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[to : to + 4096], strict=True), schema.types, strict=True)], schema=schema)

    return run


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row; of fewer, less than any."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if k < n else np.full(len(scores), -np.inf)


def _rank(k: int) -> Callable:
    """Per block: the k best of each query that visits it, as packed ids and scores."""
    schema = pa.schema([("query", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])

    def best(queries: list[int], q: np.ndarray, x: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        rough, out = q @ x.T, []
        slack = 1e-14 * x.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        slack = np.where(np.isfinite(slack), slack, 0)
        first = _kth(rough, k + 1)
        for i, query in enumerate(queries):
            # ids may share a vector, and an id may have several: as many as hold k others, and all that tie with the last
            take, least = k + 1, first[i]
            while take < len(x) and len({vec for j in np.flatnonzero(rough[i] >= least).tolist() for vec in ids[j]} - {query}) < k:
                take *= 2
                least = _kth(rough[i : i + 1], take)[0]
            near = np.flatnonzero(~(rough[i] < least - slack[i]))
            score = (x[near] * q[i]).sum(axis=1).tolist()
            found, seen = [], {query}
            for s, vec in sorted((-s, vec) for s, j in zip(score, near.tolist(), strict=True) for vec in ids[j]):
                if vec not in seen:
                    seen.add(vec)
                    found.append((s, vec))
                    if len(found) == k:
                        break
            out.append((query, np.array([v for _, v in found], np.int64).tobytes(), np.array([-s for s, _ in found]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, vecs, ids, x, waiting, asked = None, [], [], None, [], []
        for batch in batches:
            for b, kind, query, vec, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket or len(waiting) >= STRETCH:
                    if waiting and x is not None:
                        yield best(waiting, _matrix(asked), x, ids)
                    waiting, asked = [], []
                if b != bucket:
                    bucket, vecs, ids, x = b, [], [], None
                if kind == 0:
                    vecs.append(vec)
                    ids.append(own)
                    continue
                if x is None and vecs:
                    x, vecs = _matrix(vecs), []
                waiting.append(query)
                asked.append(vec)
        if waiting and x is not None:
            yield best(waiting, _matrix(asked), x, ids)

    return run


def _final(k: int) -> Callable:
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query,), (ids, scores) in grouped(batches, 1):
            vec, score = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(scores))
            order = np.lexsort((vec, -score))
            _, first = np.unique(vec[order], return_index=True)
            order = order[np.sort(first)][:k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(order)), pa.array(range(1, len(order) + 1), pa.int32()), pa.array(vec[order]), pa.array(score[order])], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the vectors (vec_id, embedding) whose ``is_query`` holds, against all."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    entries = scratch.keep(usable_vectors(vectors, k), "vectors")
    asked = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query"), "embedding")
    asked = usable_queries(asked, entries)
    count = entries.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], out)
    picked = entries.select("vec", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = _matrix([bytes(r["vec"]) for r in picked.select("vec").collect()])

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096).to_pylist())
                longest = max(longest, float((x * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([longest])], names=["n"])

    longest = entries.select("vec").mapInArrow(length, "n double").agg(F.max("n")).first()[0] ** 0.5
    forest = grow(sample, longest, count)
    probes = sample[:: max(1, len(sample) // PROBES)][:PROBES]
    forest.leaves = calibrated(forest, probes, nearest_of(entries, probes, k))
    salts = 1 + count // (BLOCK << forest.depth)
    sent = spark.sparkContext.broadcast(forest)
    empty = F.lit(None).cast("array<long>")
    both = entries.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "vec", "ids").unionAll(asked.select(F.lit(1).alias("kind"), "query", "vec", empty.alias("ids")))
    parts = shuffle_parts(spark)
    placed = both.repartition(parts).mapInArrow(_place(sent, salts), "bucket long, kind int, query long, vec binary, ids array<long>")
    ranked = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_rank(k), "query long, ids binary, scores binary")
    return ranked.repartition(parts, "query").sortWithinPartitions("query").mapInArrow(_final(k), out)


def usable_queries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, vec) of the queries whose vector is usable; a copy asks with its own id."""
    dim = entries.limit(1).collect()
    width = len(dim[0]["vec"]) // 8 if dim else -1
    schema = pa.schema([("query", pa.int64()), ("vec", pa.binary())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ma.filled(batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan).reshape(batch.num_rows, -1) + 0.0
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)).tolist()
            ids = batch.column(0).to_pylist()
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good]), pa.array([x[i].tobytes() for i in good], pa.binary())], schema=schema)

    rows = asked.where(F.col("query").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == width))
    return rows.mapInArrow(clean, "query long, vec binary").distinct()


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
