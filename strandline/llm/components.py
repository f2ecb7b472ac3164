"""Connected components of a link table.

Links are dealt into parts of a bounded number, and each part is contracted to stars by union-find.  Where
there is more than one part, large-star and small-star steps (aggregations and joins on node ids) move the
links of a node together, and the rounds go on until nothing changes.  Each round is written to the shared
folder; the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import Scratch

#: Links in a part, about: the bound of a task's memory.
PART = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars: each node with the smallest node that the links of this part reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], schema=schema)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A large-star and a small-star step; links point from the larger node to the smaller.

    Each node's least neighbour is written before it is joined back: no aggregate sits under the join, and
    adaptive execution can split a node with very many links.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
    large = scratch.keep(edges.join(least, edges.b == least.n).select("a", F.col("m").alias("b")).where("a <> b").distinct(), "large")
    low = scratch.keep(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "low")
    moved = large.join(low, large.a == low.n).select(F.explode(F.array(F.col("b"), F.col("a"))).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) -> (node, component): each linked node and the smallest node it can reach.

    Repeated links and links of a node to itself change nothing; links with a null end are ignored.
    """
    own = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges, seen = scratch.keep(own, "edges"), None
    while True:
        now = _checksum(edges)
        if not now[0] or now == seen:
            break
        seen, parts = now, 1 + now[0] // PART
        contracted = edges.repartition(parts).mapInArrow(_contract, "a long, b long")
        after = scratch.keep(contracted if parts == 1 else _stars(scratch.keep(contracted.distinct(), "parts"), scratch), "edges")
        scratch.drop(edges)
        edges = after
        if parts == 1:
            break
    star = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return star.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
