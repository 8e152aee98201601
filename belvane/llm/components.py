"""Connected components of links, for the operators that group documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import materialise

#: Links that one task joins, 256 KB of them.
FEW = 1 << 14


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the nodes of all rows, by union and find."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(x) for x in list(root)], pa.int64())], ["node", "component"])


def components(links: DataFrame, *, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b: long).

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest neighbour, then
    its smaller ones are. The links become stars around the smallest nodes within a number of rounds that grows with the
    logarithm of a component's size. Each step is an aggregation to a minimum and a join, so that no task gathers the
    neighbours of a node; every step is written to the shared folder. Up to ``few`` links, whatever the input, are joined in
    one task instead: some ten shuffles a round cost far more than they.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # a > b
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_stars, "node long, component long")
    said = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), "m").where("x <> m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialise(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == tuple(now):
            break
        said = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
