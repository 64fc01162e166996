"""Connected components: edges are contracted within partitions, then alternating large-star and small-star steps (joins and
aggregates only) bring the partitions together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Scratch


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node it is connected with) within one partition."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, top(x)) for x in list(parent) if parent[x] != x]
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step on undirected pairs (a, b): each node u links its larger (or smaller) neighbours to the least of its
    neighbourhood. A node's neighbours are never gathered: the minimum is an aggregate, joined back."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    own = both if large else both.filter("v < u")
    least = own.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = own.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b") if large else out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node that can be reached."""
    now, last = scratch.write(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long"), f"{name}-0"), None
    for step in range(1, max_steps):
        now = scratch.write(_star(_star(now, True), False), f"{name}-{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state
        scratch.drop(f"{name}-{step - 1}")
    raise RuntimeError(f"components did not settle in {max_steps} steps")
