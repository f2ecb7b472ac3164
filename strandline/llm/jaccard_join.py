"""N-gram Jaccard join: links between texts whose word-shingle sets overlap enough, and their components.

Exact for the given threshold (up to collisions of 64-bit hashes), without a cap on partners:

1. Each text becomes a sorted array of shingle hashes, its size, a hashed bitmap of it, and its
   *prefix*: the first ``n - ceil(t n) + 1`` shingles of one global order.  Two sets that link share a
   prefix shingle.  The order puts shingles that are frequent in the corpus last, so passages that
   many documents share don't make candidates.  Texts with equal sets become one representative.
2. Representatives that share a prefix shingle, sorted by size, form a run.  The smallest set of each
   size band of a run is its pivot; every other member is first compared with its pivot only, which
   joins large groups of copies by a number of pairs linear in their size.  A shingle that more than
   ``SPLIT`` documents hold is dealt to several tasks, each with pivots of its own; the pivots of a
   shingle and size band are then compared with the smallest of them.
3. Runs that still hold more than one component are cut into blocks by size; every two blocks whose
   size bands fit make a tile.  A tile compares members of different components by their bitmaps, and
   says only which components may belong together.  Components that may, over all tiles, make a family.
4. The sets of each family are dealt into tiles in the same way, each set once per tile, and a tile
   intersects the sorted arrays of what the bitmaps let pass.  It returns links that join components, not
   all pairs, and stops comparing what it has joined.

Bit counts of the bitmaps bound the overlap from above: a bit set in one bitmap and not in the other
stands for at least one shingle that isn't shared.  What passes is decided by intersecting the sorted
arrays, computed again from the text for those documents alone.

Nulls: a null or wordless text has an empty set and links with nothing; rows with a null id are left
out of links and keep a null component.  Rows that repeat an id count as one document.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import MULT, Scratch, WordHasher, by_bucket, grouped, ints, is_empty, mix, packed, rows_of, salted, windows, words_of
from strandline.llm.components import connected_components

#: Shingles in one bucket of a packed shuffle, about.
PER_BUCKET = 250_000
#: Shingles after which a mapper sends what it holds.
FLUSH = 1_000_000
#: A shingle may be called frequent if it makes up one in FREQUENT of all; so there are at most as many.
FREQUENT = 1 << 19
#: Documents that hold a shingle, beyond which its run is dealt to several tasks.
SPLIT = 200_000
#: Members of a block of a run; a tile holds two.
TILE = 2_048
#: Words of 64 bits in the filter that keeps texts out of a shuffle.
FILTER_WORDS = 1 << 16


def shingles(text: str | None, k: int, words: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    found = words.hashes(words_of(text, lower=True))
    if not len(found):
        return found
    return np.unique(windows(found, min(k, len(found))))


def least_overlap(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Shingles of a set of n that any set linked with it must share."""
    return -(-n * num // den)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bits of a set; the width follows its size, and a wider map folds onto a narrower."""
    bits = 1 << int(np.clip((2 * max(len(s), 1) - 1).bit_length(), 6, 13))
    at = (s >> np.uint64(20)) & np.uint64(bits - 1)
    out = np.zeros(bits, np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """No fewer than the shingles that two sets share, from their bitmaps."""
    if len(a) < len(b):
        a, b, n_a, n_b = b, a, n_b, n_a
    folded = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    only_b = int(np.bitwise_count(b & ~folded).sum())
    if len(a) == len(b):
        return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - only_b)
    return min(n_a - int(np.bitwise_count(folded & ~b).sum()), n_b - only_b)


def linked(shared: np.ndarray | int, n_a: np.ndarray | int, n_b: np.ndarray | int, num: int, den: int) -> np.ndarray | bool:
    return den * shared >= num * (n_a + n_b - shared)


def shared_size(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def prefix(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(s) - int(least_overlap(len(s), num, den)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        if often.any():
            return np.concatenate([s[~often], s[often]])[:n]
    return s[:n]


# -- step 1 --------------------------------------------------------------------------------------


def _often(k: int) -> Callable:
    """Shingles that several documents of a stretch of input hold, with counts; and all shingles' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = WordHasher(), [], 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            hit = c >= 4
            return pa.RecordBatch.from_arrays([pa.array([*h[hit].view(np.int64).tolist(), None], pa.int64()), pa.array([*c[hit].tolist(), n], pa.int64())], names=["h", "n"])

        for batch in batches:
            for (texts,) in rows_of(batch):
                for text in texts:
                    held.append(shingles(text, k, words))
                    n += len(held[-1])
                if n >= 2 * FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def frequent_shingles(docs: DataFrame, k: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of frequent shingles, at most FREQUENT, with their counts; and the number of shingles."""
    seen = scratch.keep(docs.select("text").mapInArrow(_often(k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "often")
    total = (seen.where("h is null").agg(F.max("n")).first()[0]) or 0
    least = max(8, -(-total // FREQUENT))
    got = seen.where((F.col("h").isNotNull()) & (F.col("n") >= least)).select("h", "n").toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order], total


def _sets(k: int, num: int, den: int, frequent: object) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bits", pa.binary()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, often = WordHasher(), np.frombuffer(frequent.value, np.uint64)
        for batch in batches:
            for ids, texts in rows_of(batch):
                out = []
                for doc, text in zip(ids, texts, strict=True):
                    s = shingles(text, k, words)
                    if len(s):
                        out.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), bitmap(s).tobytes(), prefix(s, often, num, den).tobytes()))
                    else:
                        out.append((doc, 0, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


# -- step 2 --------------------------------------------------------------------------------------


class _Split:
    """Shingles whose runs are dealt to several tasks, sorted, and to how many each."""

    def __init__(self, h: np.ndarray, n: np.ndarray) -> None:
        self.h, self.ways = h[n > SPLIT], 1 + n[n > SPLIT] // SPLIT

    def ways_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.ways[at], 1)


def _deal_prefixes(buckets: int, split: object) -> Callable:
    schema = pa.schema([("bucket", pa.int64()), ("h", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, own = 0, split.value

        def flush() -> pa.RecordBatch:
            h = ints([p for *_, p in held], np.uint64)
            each = [len(p) // 8 for *_, p in held]
            doc = np.repeat(np.array([d for d, *_ in held], np.int64), each)
            n = np.repeat(np.array([x for _, x, _ in held], np.int32), each)
            way = mix(doc.view(np.uint64)) % own.ways_of(h).astype(np.uint64)
            return packed(((h + way * MULT) % np.uint64(buckets)).astype(np.int64), [h, doc, n], schema)

        for batch in batches:
            for columns in rows_of(batch):
                for row in zip(*columns, strict=True):
                    held.append(row)
                    size += len(row[2]) // 8
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _runs(hs: list[bytes], docs: list[bytes], ns: list[bytes]) -> tuple[np.ndarray, ...]:
    """Members sorted by (shingle, size): their documents and sizes, and each run's shingle, start and length."""
    h, doc, n = ints(hs, np.uint64), ints(docs, np.int64), ints(ns, np.int32).astype(np.int64)
    order = np.lexsort((doc, n, h))
    h, doc, n = h[order], doc[order], n[order]
    starts = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
    return doc, n, h[starts], starts, np.diff(np.r_[starts, len(h)])


def _pivots(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For sizes in rising order, the index of each member's pivot."""
    if den * n[0] >= num * n[-1]:
        return np.zeros(len(n), np.int64)
    out, at = np.zeros(len(n), np.int64), 0
    while at < len(n):
        to = int(np.searchsorted(n, den * n[at] // num, "right"))
        out[at:to] = at
        at = max(to, at + 1)
    return out


def _candidates(num: int, den: int, split: object) -> Callable:
    """Per bucket: pairs (pivot, member), and the runs of three or more members once each, in pieces.

    Of a run that is dealt to several tasks a piece is here: its pairs, its members under the run's own
    key, and its pivots with their size band.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("run", pa.int64()), ("docs", pa.binary()), ("band", pa.int64())])
    width = np.log(den / num) if num < den else None

    def rows(**given: list | np.ndarray) -> pa.RecordBatch:
        size = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = split.value
        for _, cells in grouped(batches, 1):
            doc, n, shingle, starts, sizes = _runs(*cells)
            apart = own.ways_of(shingle) > 1
            two = starts[(sizes == 2) & ~apart]
            near = den * n[two] >= num * n[two + 1]
            pairs = [np.stack([doc[two], doc[two + 1]], axis=1)[near]]
            runs, seen, pivots = [], set(), []
            many = np.flatnonzero((sizes > 2) & ~apart)
            for at, size in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
                mine = doc[at : at + size]
                key = xxhash.xxh3_64_intdigest(mine.tobytes()) - (1 << 63)
                if key in seen:
                    continue
                seen.add(key)
                pivot = _pivots(n[at : at + size], num, den)
                pairs.append(np.stack([mine[pivot], mine], axis=1)[pivot != np.arange(size)])
                runs += [(key, mine[i : i + TILE].tobytes()) for i in range(0, size, TILE)]
            for i in np.flatnonzero(apart).tolist():
                at, size = int(starts[i]), int(sizes[i])
                mine, length = doc[at : at + size], n[at : at + size]
                key = int(mix(shingle[i : i + 1]).view(np.int64)[0])
                band = length if width is None else np.floor(np.log(length) / width).astype(np.int64)
                first = np.r_[0, np.flatnonzero(np.diff(band)) + 1]
                pivot = np.repeat(first, np.diff(np.r_[first, size]))
                pairs.append(np.stack([mine[pivot], mine], axis=1)[pivot != np.arange(size)])
                runs += [(key, mine[j : j + TILE].tobytes()) for j in range(0, size, TILE)]
                pivots += [(int(mine[j]), key, int(band[j])) for j in first.tolist()]
            found = np.unique(np.concatenate(pairs), axis=0)
            if len(found):
                yield rows(a=found[:, 0], b=found[:, 1])
            if runs:
                yield rows(run=[r for r, _ in runs], docs=[d for _, d in runs])
            if pivots:
                yield rows(a=[p for p, _, _ in pivots], run=[r for _, r, _ in pivots], band=[x for *_, x in pivots])

    return run


def _bounded(num: int, den: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows_of(batch, 4096):
                keep = [(a, b) for a, b, na, nb, xa, xb in zip(*columns, strict=True) if linked(overlap_bound(np.frombuffer(xa, "<u8"), np.frombuffer(xb, "<u8"), na, nb), na, nb, num, den)]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], schema=schema)

    return run


def _set_arrays(k: int) -> Callable:
    schema = pa.schema([("doc", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            for ids, texts in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingles(t, k, words).tobytes() for t in texts], pa.binary())], schema=schema)

    return run


def _exact(num: int, den: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows_of(batch):
                keep = []
                for a, b, x, y in zip(*columns, strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if linked(shared_size(x, y), len(x), len(y), num, den):
                        keep.append((a, b))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], schema=schema)

    return run


def _filter_word(c: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(FILTER_WORDS))


def sets_of(wanted: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Sorted arrays (doc, set) of the wanted documents."""
    # a filter of fixed size keeps most other texts out of the shuffle; the join after it is what decides
    word = wanted.groupBy(_filter_word(F.col("doc")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc), 64) as int))")).alias("m"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    maybe = texts.join(F.broadcast(word), _filter_word(F.col("doc")) == F.col("w")).where(F.expr("getbit(m, cast(pmod(xxhash64(doc), 64) as int)) = 1")).select("doc", "text")
    once = maybe.join(wanted, "doc", "left_semi").dropDuplicates(["doc"])
    return scratch.keep(once.select("doc", "text").mapInArrow(_set_arrays(k), "doc long, set binary"), "sets")


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link: bitmap bound first, then the sorted arrays."""
    bits = reps.select("doc", "n", "bits")
    wide = pairs.join(bits.toDF("a", "na", "xa"), "a").join(bits.toDF("b", "nb", "xb"), "b")
    left = scratch.keep(wide.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_bounded(num, den), "a long, b long"), "bounded")
    sets = sets_of(left.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), docs, k, scratch)
    both = left.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    out = scratch.keep(both.select("a", "b", "x", "y").mapInArrow(_exact(num, den), "a long, b long"), "links")
    scratch.drop(sets)
    return out


# -- step 3 --------------------------------------------------------------------------------------


class _Bounds:
    """Bitmaps of a tile by width, to bound the overlap of one set with many."""

    def __init__(self, maps: list[np.ndarray], n: np.ndarray) -> None:
        self.maps, self.n = maps, n
        self.width = np.array([len(m) for m in maps])
        self.place = np.zeros(len(maps), np.int64)
        self.group: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.place[mine] = np.arange(len(mine))
            self.group[w] = np.stack([maps[i] for i in mine.tolist()])

    def passing(self, x: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        out, mine, n_x = [], self.maps[x], int(self.n[x])
        for w in np.unique(self.width[others]).tolist():
            part = others[self.width[others] == w]
            theirs, own = self.group[w][self.place[part]], mine
            if w > len(own):
                theirs = np.bitwise_or.reduce(theirs.reshape(len(part), -1, len(own)), axis=1)
            elif w < len(own):
                own = np.bitwise_or.reduce(own.reshape(-1, w), axis=0)
            shared = np.minimum(n_x - np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64), self.n[part] - np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64))
            out.append(part[linked(shared, n_x, self.n[part], num, den)])
        return np.concatenate(out) if out else others[:0]


def _joined(i: int, j: int, block: np.ndarray, n: np.ndarray, comp: np.ndarray, bounds: _Bounds, holds: Callable | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of a tile that join components: what the bitmaps let pass and ``holds`` confirms."""
    label = comp.copy()
    rows = np.flatnonzero(block == i)
    cols = rows if i == j else np.flatnonzero(block == j)
    for x in rows.tolist():
        fit = cols[(label[cols] != label[x]) & (den * np.minimum(n[cols], n[x]) >= num * np.maximum(n[cols], n[x]))]
        if i == j:
            fit = fit[fit > x]
        if not len(fit):
            continue
        for y in bounds.passing(x, fit, num, den).tolist():
            if label[y] != label[x] and (holds is None or holds(x, y)):
                yield x, y
                label[label == label[y]] = label[x]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_PAIR)


def _family_tiles(num: int, den: int) -> Callable:
    """Per tile of a run: components that may belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (blocks, ns, comps, bits) in grouped(batches, 3):
            block, n, comp = (np.array(c, np.int64) for c in (blocks, ns, comps))
            bounds = _Bounds([np.frombuffer(x, "<u8") for x in bits], n)
            if found := [(int(comp[x]), int(comp[y])) for x, y in _joined(i, j, block, n, comp, bounds, None, num, den)]:
                yield _pairs(found)

    return run


def _set_tiles(num: int, den: int) -> Callable:
    """Per tile of a family: links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (blocks, docs, ns, comps, cells) in grouped(batches, 3):
            block, n, comp = (np.array(c, np.int64) for c in (blocks, ns, comps))
            sets = [np.frombuffer(x, np.uint64) for x in cells]

            def holds(x: int, y: int, sets: list = sets) -> bool:
                return bool(linked(shared_size(sets[x], sets[y]), len(sets[x]), len(sets[y]), num, den))

            bounds = _Bounds([bitmap(x) for x in sets], n)
            if found := [(docs[x], docs[y]) for x, y in _joined(i, j, block, n, comp, bounds, holds, num, den)]:
                yield _pairs(found)

    return run


def tiles_of(members: DataFrame, key: str, num: int, den: int, *carry: str) -> DataFrame:
    """Members (key, size, doc, n, ...) dealt into tiles (key, i, j): two blocks by size whose sizes can link.

    What fits one block is a tile by itself, dealt once by its key.  A larger group is cut into bands by
    size, such that linked sets are in one band or in neighbours, and a band into blocks by a hash of the
    document; nothing is sorted, and no task holds more of a group than two blocks.
    """
    none = F.lit(0).cast("long")
    small = members.where(F.col("size") <= TILE).select(key, none.alias("i"), none.alias("j"), none.alias("block"), *carry)
    # a band is a little wider than the ratio, so that rounding can't put linked sets two bands apart
    band = F.floor(F.log("n") / (1.001 * math.log(den / num))) if num < den else F.col("n")
    large = members.where(F.col("size") > TILE).withColumn("band", band.cast("long"))
    parts = large.groupBy(key, "band").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    blocks = parts.select(key, "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    other = blocks.select(F.col(key).alias("k2"), F.col("band").alias("band2"), F.col("part").alias("part2"))
    meets = ((F.col("band2") == F.col("band")) & (F.col("part2") >= F.col("part"))) | (F.col("band2") == F.col("band") + 1)
    number = lambda band, part: F.col(band) * (1 << 32) + F.col(part)
    fits = blocks.join(other, (F.col(key) == F.col("k2")) & meets).select(key, number("band", "part").alias("i"), number("band2", "part2").alias("j"))
    sides = fits.select(key, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    placed = salted(large, parts, [key, "band"], "doc").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).withColumn("block", number("band", "part"))
    wide = placed.join(sides, [key, "block"]).select(key, "i", "j", "block", *carry)
    return small.unionAll(wide).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _open_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("run", pa.int64()), ("doc", pa.int64())])
    for batch in batches:
        for keys, docs in rows_of(batch):
            for key, cell in zip(keys, docs, strict=True):
                doc = np.frombuffer(cell, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(doc), pa.int64()), pa.array(doc)], schema=schema)


def similar_texts(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: sets link when ``den * shared >= num * united``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent, counts, total = frequent_shingles(docs, k, scratch)
    often = spark.sparkContext.broadcast(frequent.tobytes())
    split = spark.sparkContext.broadcast(_Split(frequent, counts))
    wide = scratch.keep(docs.mapInArrow(_sets(k, num, den, often), "doc_id long, n long, key binary, bits binary, prefix binary"), "sets")
    some = wide.where("n > 0 and doc_id is not null")
    reps = scratch.keep(some.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "reps")
    sets = scratch.keep(wide.select("doc_id", "n", "key"), "keys")
    scratch.drop(wide)

    buckets = 1 + int(total * (1 - num / den) / PER_BUCKET)
    dealt = reps.select("doc", "n", "prefix").mapInArrow(_deal_prefixes(buckets, split), "bucket long, h binary, doc binary, n binary")
    found = scratch.keep(by_bucket(dealt).select("bucket", "h", "doc", "n").mapInArrow(_candidates(num, den, split), "a long, b long, run long, docs binary, band long"), "candidates")
    pairs = found.where("b is not null").select("a", "b")
    pivots = found.where("band is not null").select("run", "band", "a")
    heads = pivots.groupBy("run", "band").agg(F.min("a").alias("head"))
    pairs = pairs.unionAll(pivots.join(heads, ["run", "band"]).where("a <> head").select(F.col("head").alias("a"), F.col("a").alias("b")))
    links = verify(pairs.distinct(), docs, reps, k, num, den, scratch)
    comps = scratch.keep(connected_components(links, scratch), "components")

    # runs whose members are now all in one component need no more work
    runs = found.where("docs is not null").select("run", "docs").dropDuplicates(["run", "docs"])
    members = runs.mapInArrow(_open_docs, "run long, doc long").join(comps, F.col("doc") == F.col("node"), "left").select("run", "doc", F.coalesce("component", "doc").alias("comp"))
    members = scratch.keep(members, "members")
    split = members.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("run", "size")
    opened = salted(members, split, ["run"], "doc").join(reps.select("doc", "n", "bits"), "doc")
    may_join = scratch.keep(tiles_of(opened, "run", num, den, "n", "comp", "bits").mapInArrow(_family_tiles(num, den), "a long, b long").distinct(), "families")
    if not is_empty(may_join):
        family = scratch.keep(connected_components(may_join, scratch), "families").toDF("comp", "family")
        placed = reps.select("doc", "n").join(comps, F.col("doc") == F.col("node"), "left").select("doc", "n", F.coalesce("component", "doc").alias("comp"))
        sizes = placed.join(family, "comp").groupBy("family").agg(F.count(F.lit(1)).alias("size"))
        inside = scratch.keep(placed.join(family, "comp").join(sizes, "family"), "inside")
        arrays = sets_of(inside.select("doc"), docs, k, scratch)
        full = inside.join(arrays, "doc")
        further = scratch.keep(tiles_of(full, "family", num, den, "doc", "n", "comp", "set").mapInArrow(_set_tiles(num, den), "a long, b long"), "links")
        scratch.drop(arrays)
        comps = scratch.keep(connected_components(links.unionByName(further), scratch), "components")

    rep_of = reps.select("key", F.col("doc").alias("rep")).join(comps, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("c"))
    placed = sets.select("doc_id", "n", "key").join(rep_of, "key", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at 85 % over the whole of ``documents``."""
    return similar_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


#: DuckDB's answer for op5_jaccard_join.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN size USING (doc_id) JOIN least ON least.x = w.doc_id
"""
