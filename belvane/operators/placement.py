"""Chains of placements: where each node of a model is, from where it is in its parent.

A chain of any depth takes a number of joins that grows with the depth's logarithm: in each round, every node that isn't
placed yet joins the node that it is known from, and is then known from that node's own reference, twice as far up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.sources.tables import materialise

POSE = ("x", "y", "z", "yaw")


def composed(outer: dict[str, Column], inner: dict[str, Column]) -> dict[str, Column]:
    """The pose of ``inner``, given in the frame of ``outer``, in the frame of which ``outer`` is: turned, then moved."""
    c, s = F.cos(outer["yaw"]), F.sin(outer["yaw"])
    return {
        "x": outer["x"] + c * inner["x"] - s * inner["y"],
        "y": outer["y"] + s * inner["x"] + c * inner["y"],
        "z": outer["z"] + inner["z"],
        "yaw": outer["yaw"] + inner["yaw"],
    }


def inverse(pose: dict[str, Column]) -> dict[str, Column]:
    """The pose that undoes ``pose``."""
    c, s = F.cos(pose["yaw"]), F.sin(pose["yaw"])
    return {"x": -c * pose["x"] - s * pose["y"], "y": s * pose["x"] - c * pose["y"], "z": -pose["z"], "yaw": -pose["yaw"]}


def wrapped(angle: Column) -> Column:
    """An angle within -pi and pi."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def resolved(placements: DataFrame) -> DataFrame:
    """model, node, x, y, z, yaw, depth and status of ``placements`` (model, node, parent, x, y, z, yaw, and tilted where there
    is a turn about another axis than the vertical). A null parent is a root.

    A node whose chain ends nowhere is CYCLE, one whose chain names a node that the model lacks DANGLING, one with a tilted
    node in its chain OUT_OF_PLANE; these have no pose. The others are PLACED, with a yaw between -pi and pi. A node that
    is listed twice is AMBIGUOUS in each of its rows, and so is all that hangs on it.
    """
    tilted = F.col("tilted") if "tilted" in placements.columns else F.lit(False)
    rows = placements.select("model", "node", "parent", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in POSE], F.coalesce(tilted, F.lit(False)).alias("tilted"))
    known = rows.groupBy("model", "node").agg(F.count(F.lit(1)).alias("times"))
    parents = known.select("model", F.col("node").alias("parent"), F.col("times").alias("above"))
    rows = rows.join(known, ["model", "node"]).join(parents, ["model", "parent"], "left")
    fault = F.when((F.col("times") > 1) | (F.col("above") > 1), "AMBIGUOUS").when(F.col("parent").isNotNull() & F.col("above").isNull(), "DANGLING").when(F.col("tilted"), "OUT_OF_PLANE")
    # ``up``: the node in whose frame the pose is given; null: the model's own
    rows = rows.select("model", "node", F.when(F.coalesce(fault, F.lit("")).isin("", "OUT_OF_PLANE"), F.col("parent")).alias("up"), *POSE, F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), fault.alias("fault"))
    open_ = materialise(rows)
    done = open_.where("up is null")
    open_, left = open_.where("up is not null"), None
    while True:
        n = open_.count()
        if n == 0 or n == left:  # no node came to its root: the rest runs in circles
            break
        left = n
        last = open_.unionByName(done)
        above = last.dropDuplicates(["model", "node"]).select("model", F.col("node").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"up_{c}") for c in POSE], F.col("depth").alias("up_depth"), F.col("fault").alias("up_fault"))
        pose = composed({c: F.col(f"up_{c}") for c in POSE}, {c: F.col(c) for c in POSE})
        # a parent has many children: Spark splits the rows of one with very many
        moved = open_.join(above, ["model", "up"]).select("model", "node", F.col("next").alias("up"), *[v.alias(c) for c, v in pose.items()], (F.col("depth") + F.col("up_depth")).alias("depth"), F.coalesce("up_fault", "fault").alias("fault"))
        moved = materialise(moved)
        done, open_ = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    all_ = done.unionByName(open_.withColumn("fault", F.lit("CYCLE")))
    told = F.coalesce("fault", F.lit("PLACED"))
    value = lambda c: F.when(F.col("fault").isNull(), wrapped(F.col(c)) if c == "yaw" else F.col(c)).alias(c)
    return all_.select("model", "node", *[value(c) for c in POSE], F.when(F.col("fault").isNull(), F.col("depth")).alias("depth"), told.alias("status"))
