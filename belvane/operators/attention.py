"""Elements that listen to their neighbours: attention weights, and values that spread along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.sources.tables import materialise


def both_ways(pairs: DataFrame) -> DataFrame:
    """a, b: ``pairs`` in both directions, none twice and none with itself."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def weights(tokens: DataFrame, edges: DataFrame, *, scale: float, length: float, other_class: float) -> DataFrame:
    """a, b, weight: how much ``a`` listens to each neighbour ``b``; the weights of each ``a`` sum to 1.

    ``tokens`` (id, x, y, payload, class) agree in what they carry, how near they are (a Gaussian kernel) and their
    class; the softmax takes off the greatest first. Only ``edges`` (a, b) are scored, so the work grows with them. A
    token without edges listens to nobody and has no row.
    """
    side = lambda s: tokens.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x", "y", "payload", "class")])
    joined = edges.join(side("a"), "a").join(side("b"), "b")
    far = F.pow(F.col("x_a") - F.col("x_b"), F.lit(2)) + F.pow(F.col("y_a") - F.col("y_b"), F.lit(2))
    logit = scale * F.col("payload_a") * F.col("payload_b") - far / (2 * length * length) + F.when(F.col("class_a") == F.col("class_b"), 0.0).otherwise(F.log(F.lit(other_class)))
    scored = joined.select("a", "b", logit.alias("l"))
    # maxima and sums are partial aggregates, so no task gathers a token's neighbours
    lifted = scored.join(scored.groupBy("a").agg(F.max("l").alias("top")), "a").select("a", "b", F.exp(F.col("l") - F.col("top")).alias("e"))
    return lifted.join(lifted.groupBy("a").agg(F.sum("e").alias("s")), "a").select("a", "b", (F.col("e") / F.col("s")).alias("weight"))


def uniform(edges: DataFrame) -> DataFrame:
    """a, b, weight: every neighbour heard alike, to compare with :func:`weights`."""
    return edges.join(edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").select("a", "b", (1 / F.col("n")).alias("weight"))


def spread(values: DataFrame, heard: DataFrame, *, rounds: int, rate: float) -> DataFrame:
    """id, v after ``rounds`` in which each value (id, v) moves by ``rate`` towards what it hears (a, b, weight).

    A value that hears nothing stays. Each round is a join and a sum, written to the shared folder.
    """
    heard = materialise(heard)
    for _ in range(rounds):
        told = heard.join(values.withColumnsRenamed({"id": "b", "v": "vb"}), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("weight") * F.col("vb")).alias("h"), F.sum("weight").alias("w"))
        values = materialise(values.join(told, "id", "left").select("id", (F.col("v") + rate * F.coalesce(F.col("h") - F.col("w") * F.col("v"), F.lit(0.0))).alias("v")))
    return values
