"""Typed relationships (kind, source, target) as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belvane.sources.tables import dealt, growing


def hop(rel: DataFrame, kind: str, nodes: DataFrame, *, back: bool = False) -> DataFrame:
    """node, reached: one step along edges of a kind from ``nodes`` (node), or against them."""
    a, b = ("target", "source") if back else ("source", "target")
    return rel.where(F.col("kind") == kind).join(nodes, F.col(a) == F.col("node")).select("node", F.col(b).alias("reached"))


def dangling(rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node of ``nodes`` (node)."""
    known = growing(dealt(nodes.select("node"), "node"))
    # Spark looks up each kind's table by itself; dealt by number, these tasks stay as many as the session has
    loose = lambda end: dealt(rel, end).join(known, F.col(end) == F.col("node"), "left_anti").withColumn("end", F.lit(end))
    return loose("source").unionByName(loose("target"))


def degree_violations(rel: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """Nodes that aren't the source of exactly one edge of a kind, with ``n``."""
    n = rel.where(F.col("kind") == kind).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def affinity(incidence: DataFrame, strength: float = 0.5) -> DataFrame:
    """a, b, strength and shared: pairs of members (node) that share a place (place), a < b, each once. ``incidence`` lists
    (place, node); places are small by nature (the bounds of a room)."""
    once = incidence.select("place", "node").distinct()  # so that a pair meets once a place, and its places need no set
    x, y = once.select("place", F.col("node").alias("a")), once.select("place", F.col("node").alias("b"))
    return x.join(y, "place").where("a < b and place is not null").groupBy("a", "b").agg(F.lit(strength).alias("strength"), F.count(F.lit(1)).alias("shared"))


def layout(nodes: DataFrame) -> DataFrame:
    """``nodes`` (class, node) in rows by class and columns by node, with the number of nodes of the class.

    Only the distinct classes, of which a model has a few, are ranked in one task; nodes are ranked within their class."""
    ranks = nodes.select("class").distinct().select(F.col("class").alias("__class"), F.row_number().over(Window.orderBy("class")).cast("long").alias("row"))
    by = Window.partitionBy("class")
    placed = nodes.select("node", "class", F.row_number().over(by.orderBy("node")).cast("long").alias("column"), F.count(F.lit(1)).over(by).alias("of_class"))
    return placed.join(ranks, F.col("class").eqNullSafe(F.col("__class"))).select("node", "class", "row", "column", "of_class")


def relabel(nodes: DataFrame, rel: DataFrame, rounds: int = 3) -> DataFrame:
    """node, label: Weisfeiler-Lehman labels, so that alike surroundings get equal labels. ``nodes`` has node and label.

    Each round hashes a node's label with the sorted labels around it; a node's neighbours are summed as hashes, so that
    none is gathered.
    """
    now = nodes.select("node", F.sha2(F.col("label"), 256).alias("label"))
    both = rel.select(F.col("source").alias("x"), F.col("target").alias("y"), F.concat(F.lit("out:"), "kind").alias("k")).unionByName(rel.select(F.col("target").alias("x"), F.col("source").alias("y"), F.concat(F.lit("in:"), "kind").alias("k")))
    for _ in range(rounds):
        part = F.conv(F.substring(F.sha2(F.concat_ws("|", "k", "label"), 256), 1, 13), 16, 10).cast("decimal(38,0)")
        around = both.join(now, F.col("y") == F.col("node")).groupBy("x").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("n"))
        now = now.join(around, F.col("node") == F.col("x"), "left").select("node", F.sha2(F.concat_ws("|", "label", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("s", F.lit(0)).cast("string")), 256).alias("label"))
    return now


def spatial(rel: DataFrame) -> DataFrame:
    """The edges that say what lies in what."""
    return rel.where(F.col("kind").isin("aggregates", "contains"))


def exempt(rel: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """a, b: pairs a < b that may touch, each once: both are sources of an edge to the same target, by the kinds of one of
    ``paths``. A target has the few sources that its record lists."""
    found = None
    for one, two in paths:
        x = rel.where(F.col("kind") == one).select(F.col("source").alias("a"), "target")
        y = rel.where(F.col("kind") == two).select(F.col("source").alias("b"), "target")
        pairs = x.join(y, "target").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def depths(rel: DataFrame, most: int) -> DataFrame:
    """node, depth of all nodes below the roots; a node with several ways counts by the longest, and one deeper than ``most``
    as that deep."""
    from belvane.operators.dag import levels

    return levels(rel.select(F.col("source").alias("parent"), F.col("target").alias("child"))).select("node", F.least("level", F.lit(most)).alias("depth"))
