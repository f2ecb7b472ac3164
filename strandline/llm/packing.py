"""Conflict-constrained best-fit packing of documents into token bins.

Documents are dealt into shards of a bounded number by a hash of their whole row and of its number among
equal rows, so a source, a group of copies, rows without an id or rows that repeat spread evenly whatever
their share.  Each shard is packed by itself, in falling order of length, then by id, source and cluster,
so a task that runs again gives the same bins.  Open bins are held in order of what is left in them, each with a bitmap of the sources and one of the
duplicate clusters inside it.  An item looks up its successor, the tightest bin it fits, and goes on to
the next tightest until a bin holds neither its source nor its cluster; if none does, it opens a bin.

A document longer than a bin is cut: whole bins of its own, then a last piece that is packed with
others.  No words are lost.

Nulls: a document without words, or with a null length, gets one piece of length 0 and no bin.  A null
source or cluster conflicts with nothing; rows with a null id are packed like others.  Repeated rows are
packed as items of their own.  An empty table gives an empty result.  Extra columns are ignored, whatever
their names.  In ``pack_texts`` a cluster is the texts that are equal but for case and blanks; near-copies
are clusters of their own, unless ``pack_documents`` is given other clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in a shard, about: the bound of a task's memory and of its longest search.
SHARD_DOCS = 4_096
#: Equal rows that are numbered by one array.
COPIES = 1 << 16
_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("bin_start", pa.int64())])


def _bits(values: list) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value the word and bit that stand for it; only values that occur twice can conflict."""
    seen: dict = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in seen.items() if n > 1)}
    at = np.array([number.get(v, -1) for v in values], np.int64)
    return at >> 6, np.where(at < 0, 0, 1 << (at & 63).astype(np.uint64)).astype(np.uint64), max(1, -(-len(number) // 64))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, for items no longer than a bin, taken in the order given."""
    n = len(lengths)
    s_word, s_bit, s_words = _bits(sources)
    c_word, c_bit, c_words = _bits(clusters)
    source_map, cluster_map = np.zeros((n, s_words), np.uint64), np.zeros((n, c_words), np.uint64)
    left, order, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    bins, offsets, opened = [0] * n, [0] * n, 0
    for item, length in enumerate(lengths):
        at, found, step = int(np.searchsorted(left[:used], length)), -1, 16
        while at < used:
            near = order[at : min(used, at + step)]
            clash = (source_map[near, s_word[item]] & s_bit[item]) | (cluster_map[near, c_word[item]] & c_bit[item])
            free = np.flatnonzero(clash == 0)
            if len(free):
                found = at + int(free[0])
                break
            at, step = at + step, step * 4
        if found < 0:
            bin_no, rest = opened, capacity
            opened += 1
        else:
            bin_no, rest = int(order[found]), int(left[found])
            left[found : used - 1] = left[found + 1 : used]
            order[found : used - 1] = order[found + 1 : used]
            used -= 1
        bins[item], offsets[item] = bin_no, capacity - rest
        source_map[bin_no, s_word[item]] |= s_bit[item]
        cluster_map[bin_no, c_word[item]] |= c_bit[item]
        rest -= length
        # among equal residuals the older bin comes first
        to = int(np.searchsorted(left[:used], rest))
        while to < used and left[to] == rest and order[to] < bin_no:
            to += 1
        left[to + 1 : used + 1] = left[to:used]
        order[to + 1 : used + 1] = order[to:used]
        left[to], order[to] = rest, bin_no
        used += 1
    return bins, offsets


def pack_shard(shard: int, ids: list, lengths: list, sources: list, clusters: list, capacity: int) -> list[tuple]:
    """Pieces (doc_id, piece, start, length, bin_id, bin_start) of one shard."""
    rows, items, whole = [], [], 0
    for doc, length, source, cluster in sorted(zip(ids, lengths, sources, clusters, strict=True), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r)):
        length = length or 0
        full, rest = divmod(length, capacity)
        for piece in range(full):
            rows.append((doc, piece, piece * capacity, capacity, ("own", whole), 0))
            whole += 1
        if rest:
            items.append((doc, full, full * capacity, rest, source, cluster))
        elif not full:
            rows.append((doc, 0, 0, 0, None, None))
    items.sort(key=lambda r: -r[3])
    bins, offsets = best_fit([r[3] for r in items], [r[4] for r in items], [r[5] for r in items], capacity)
    shared = max(bins, default=-1) + 1
    base = shard << 32
    out = [(*r[:4], base + shared + r[4][1] if r[4] else None, r[5]) for r in rows]
    return out + [(*r[:4], base + b, o) for r, b, o in zip(items, bins, offsets, strict=True)]


def pack_documents(items: DataFrame, capacity: int = 2_048, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Items (doc_id, n_tokens, source, cluster) -> doc_id, piece, start, length, bin_id, bin_start."""
    shards = 1 + items.count() // shard_docs
    rows = items.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("long"))
    # equal rows are counted, with map-side sums, and numbered, so that they don't share a hash
    last = F.least(F.col("count") - 1, F.col("at") + (COPIES - 1))
    each = rows.groupBy(*rows.columns).count().withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(COPIES).cast("long")))).withColumn("copy", F.explode(F.sequence("at", last)))
    dealt = each.select(F.pmod(F.xxhash64(*rows.columns, "copy"), F.lit(shards)).alias("shard"), *rows.columns)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster")]
        rows = pack_shard(key[0].as_py(), *cells, capacity)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, piece long, start long, length long, bin_id long, bin_start long")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[ \t\n\x0B\f\r]+"))).cast("long")


def copy_cluster(text: Column) -> Column:
    """A cluster for texts that are equal but for case and blanks."""
    return F.when(text.isNotNull(), F.xxhash64(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " ")))


def pack_texts(docs: DataFrame, capacity: int = 2_048) -> DataFrame:
    """Pieces of whole texts, in words."""
    return pack_documents(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), "source", copy_cluster(F.col("text")).alias("cluster")), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in bins of 2,048 words."""
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
