"""Boxes, clashes between them, and mixtures of Gaussians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.sources.tables import growing


def aabb(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """``boxes`` with x0, x1, y0, y1, z0, z1: the box around each turned box, with a margin."""
    c, s = F.cos("yaw"), F.sin("yaw")
    a, b = F.col("ex") * c, -F.col("ey") * s
    e, f = F.col("ex") * s, F.col("ey") * c
    zero = F.lit(0.0)
    return boxes.withColumns({
        "x0": F.col("ox") + F.least(zero, a) + F.least(zero, b) - margin, "x1": F.col("ox") + F.greatest(zero, a) + F.greatest(zero, b) + margin,
        "y0": F.col("oy") + F.least(zero, e) + F.least(zero, f) - margin, "y1": F.col("oy") + F.greatest(zero, e) + F.greatest(zero, f) + margin,
        "z0": F.col("oz") - margin, "z1": F.col("oz") + F.col("ez") + margin,
    })


def overlapping(boxes: DataFrame, cell: float = 2.0) -> DataFrame:
    """a, b: ids of boxes whose surrounding boxes (x0 ...) overlap, a < b, each pair once.

    Boxes are dealt to the grid cells that they touch, and meet in their cells; a pair that meets in several counts in
    the cell of the lower corner of its overlap alone, so no distinct is needed.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    dealt = boxes.select("id", "x0", "x1", "y0", "y1", "z0", "z1", F.explode(span("x0", "x1")).alias("gx"), span("y0", "y1").alias("ys")).withColumn("gy", F.explode("ys")).drop("ys")
    p, q = dealt.alias("p"), dealt.alias("q")
    meet = [F.col(f"p.{k}0") <= F.col(f"q.{k}1") for k in "xyz"] + [F.col(f"q.{k}0") <= F.col(f"p.{k}1") for k in "xyz"]
    here = [F.floor(F.greatest(F.col(f"p.{k}0"), F.col(f"q.{k}0")) / cell) == F.col(f"p.g{k}") for k in "xy"]
    on = (F.col("p.gx") == F.col("q.gx")) & (F.col("p.gy") == F.col("q.gy")) & (F.col("p.id") < F.col("q.id"))
    for c in (*meet, *here):
        on = on & c
    return p.join(growing(q), on).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


def moments(points: DataFrame, by: list[str], dims: list[str], weight: str | None = None) -> DataFrame:
    """Weight, mean and covariance of points by group: sums alone, so that levels of detail merge exactly."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w).alias("weight"), *[F.sum(w * F.col(x)).alias(f"s_{x}") for x in dims], *[F.sum(w * F.col(x) * F.col(y)).alias(f"s_{x}_{y}") for i, x in enumerate(dims) for y in dims[i:]]]
    out = points.groupBy(*by).agg(*sums) if by else points.agg(*sums)
    mean = {x: F.col(f"s_{x}") / F.col("weight") for x in dims}
    return out.select(*by, "weight", *[mean[x].alias(f"m_{x}") for x in dims], *[(F.col(f"s_{x}_{y}") / F.col("weight") - mean[x] * mean[y]).alias(f"c_{x}_{y}") for i, x in enumerate(dims) for y in dims[i:]])


def responsibilities(points: DataFrame, parts: DataFrame, dims: list[str], *, most: int = 4096) -> DataFrame:
    """id, part, log_p and share: each point against each of a mixture's parts (part, weight, mean_*, var_*). The parts are a
    model's, at most ``most`` of them, which is checked; they go to every task as one row, and a point meets them there."""
    from belvane.operators.scan import one_row

    def density(p: Column) -> Column:
        total = F.log(p["weight"]) - 0.5 * len(dims) * math.log(2 * math.pi)
        for x in dims:
            total = total - 0.5 * F.log(p[f"var_{x}"]) - 0.5 * F.pow(F.col(x) - p[f"mean_{x}"], F.lit(2)) / p[f"var_{x}"]
        return total

    scored = points.join(F.broadcast(one_row(parts, dims, most))).withColumn("__l", F.transform("parts", density)).withColumn("__top", F.array_max("__l"))
    scored = scored.withColumn("__sum", F.aggregate("__l", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("__top"))))
    return scored.select("id", F.inline(F.zip_with("parts", "__l", lambda p, v: F.struct(p["part"].alias("part"), v.alias("log_p"), (F.exp(v - F.col("__top")) / F.col("__sum")).alias("share")))))


def polygon(points: DataFrame, key: str, order: str) -> DataFrame:
    """key, area, cx, cy: a polygon's signed area and centroid by the shoelace sums, from its points (x, y) in order."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(w), F.first("x").over(whole))
    ny = F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    p = points.withColumns({"nx": nx, "ny": ny}).withColumn("cross", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    s = p.groupBy(key).agg((F.sum("cross") / 2).alias("area"), F.sum((F.col("x") + F.col("nx")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("cross")).alias("sy"))
    return s.select(key, "area", *[F.when(F.col("area") != 0, F.col(f"s{k}") / (6 * F.col("area"))).alias(f"c{k}") for k in "xy"])


def primitives(boxes: DataFrame, spacing: float) -> DataFrame:
    """id, i, j, k, mean_x .. mean_z, and the covariance s_xx, s_xy, s_yy, s_zz of the tiles of each turned box.

    An extent is cut into the fewest equal tiles not longer than ``spacing``; a tile has the moments of a uniform box.
    """
    n = {k: F.greatest(F.ceil(F.col(f"e{k}") / spacing), F.lit(1)) for k in "xyz"}
    cut = boxes.select("*", *[n[k].alias(f"n{k}") for k in "xyz"])
    for axis, at in zip("xyz", "ijk", strict=True):
        cut = cut.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{axis}") - 1)))
    u, v, w = [(F.col(at) + 0.5) * F.col(f"e{axis}") / F.col(f"n{axis}") for axis, at in zip("xyz", "ijk", strict=True)]
    a, b, h = [F.pow(F.col(f"e{k}") / F.col(f"n{k}"), F.lit(2)) / 12 for k in "xyz"]
    c, s = F.cos("yaw"), F.sin("yaw")
    return cut.select(
        "id", "i", "j", "k",
        (F.col("ox") + u * c - v * s).alias("mean_x"), (F.col("oy") + u * s + v * c).alias("mean_y"), (F.col("oz") + w).alias("mean_z"),
        (a * c * c + b * s * s).alias("s_xx"), ((a - b) * c * s).alias("s_xy"), (a * s * s + b * c * c).alias("s_yy"), h.alias("s_zz"),
    )


def levels_of_detail(points: DataFrame, levels: list[str], dims: list[str]) -> DataFrame:
    """Weight, means and variances at every level of ``levels`` and over all, in one pass; a level that is summed over is
    null, and ``level`` tells how many are."""
    sums = [F.count(F.lit(1)).alias("weight"), *[F.avg(x).alias(f"mean_{x}") for x in dims], *[F.var_pop(x).alias(f"var_{x}") for x in dims]]
    gone = F.lit(0)
    for c in levels:
        gone = gone + F.grouping(c).cast("int")
    return points.rollup(*levels).agg(gone.alias("level"), *sums)


def distances(parts: DataFrame, dims: list[str]) -> DataFrame:
    """a, b, bhattacharyya, log_overlap, kl: pairs a < b of a mixture's parts (part, mean_*, var_*), whose covariances are
    diagonal. ``log_overlap`` is the log of the integral of the product. The parts are those of a model, a few."""
    names = [f"{m}_{x}" for m in ("mean", "var") for x in dims]
    p = parts.select(F.col("part").alias("a"), *[F.col(c).alias(f"p_{c}") for c in names])
    q = parts.select(F.col("part").alias("b"), *[F.col(c).alias(f"q_{c}") for c in names])
    far, over, kl = F.lit(0.0), F.lit(-0.5 * len(dims) * math.log(2 * math.pi)), F.lit(-0.5 * len(dims))
    for x in dims:
        gap, s, t = F.pow(F.col(f"p_mean_{x}") - F.col(f"q_mean_{x}"), F.lit(2)), F.col(f"p_var_{x}"), F.col(f"q_var_{x}")
        far = far + gap / (4 * (s + t)) + 0.5 * F.log((s + t) / 2) - 0.25 * F.log(s * t)
        over = over - 0.5 * F.log(s + t) - gap / (2 * (s + t))
        kl = kl + 0.5 * (s / t + gap / t + F.log(t / s))
    return p.join(q, F.col("a") < F.col("b")).select("a", "b", far.alias("bhattacharyya"), over.alias("log_overlap"), kl.alias("kl"))


def evidence(scored: DataFrame, outlier_share: float, outlier_density: float) -> DataFrame:
    """part, effective_points, fraction, confidence from ``scored`` (id, part, log_p: log weight and density).

    A point belongs to the parts and to outliers of a flat density in proportion; what the parts don't take is the
    outliers', so that the mass of each point stays 1. ``confidence`` is the mean share of points in the part, weighted
    by these shares.
    """
    w = Window.partitionBy("id")
    flat = math.log(outlier_share * outlier_density)
    top = F.greatest(F.max("log_p").over(w) + math.log(1 - outlier_share), F.lit(flat))
    shifted = scored.withColumn("top", top).withColumn("e", F.exp(F.col("log_p") + math.log(1 - outlier_share) - F.col("top")))
    share = shifted.select("part", (F.col("e") / (F.sum("e").over(w) + F.exp(F.lit(flat) - F.col("top")))).alias("share"))
    return share.groupBy("part").agg(F.sum("share").alias("effective_points"), F.avg("share").alias("fraction"), (F.sum(F.col("share") * F.col("share")) / F.sum("share")).alias("confidence"))


def path_length(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key``, points and length of the line through a key's points (x, y) in order; 0 for a single point."""
    w = Window.partitionBy(key).orderBy(*order)
    step = points.select(key, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step"))
    return step.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def in_frame(parts: DataFrame, yaw: float, shift: tuple[float, float], scale: float) -> DataFrame:
    """``parts`` (part, weight, m_x, m_y, c_x_x, c_x_y, c_y_y) in another frame: turned, scaled and then moved.

    Means go to A m + b, covariances to A C A', weights grow by the determinant of A.
    """
    a, b = scale * math.cos(yaw), scale * math.sin(yaw)  # A = [[a, -b], [b, a]]
    x, y, xx, xy, yy = (F.col(c) for c in ("m_x", "m_y", "c_x_x", "c_x_y", "c_y_y"))
    return parts.select(
        "part", (F.col("weight") * scale * scale).alias("weight"), (a * x - b * y + shift[0]).alias("m_x"), (b * x + a * y + shift[1]).alias("m_y"),
        (a * a * xx - 2 * a * b * xy + b * b * yy).alias("c_x_x"), (a * b * (xx - yy) + (a * a - b * b) * xy).alias("c_x_y"), (b * b * xx + 2 * a * b * xy + a * a * yy).alias("c_y_y"),
    )


def invalid_parts(parts: DataFrame) -> DataFrame:
    """``parts`` of a planar mixture that aren't finite, or without a positive weight or a positive definite covariance."""
    names = ("weight", "m_x", "m_y", "c_x_x", "c_x_y", "c_y_y")
    finite = F.lit(True)
    for c in names:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return parts.where(~(finite & (F.col("weight") > 0) & (F.col("c_x_x") > 0) & (F.col("c_x_x") * F.col("c_y_y") - F.col("c_x_y") * F.col("c_x_y") > 0)))


def sections(points: DataFrame, key: str, order: str) -> DataFrame:
    """``key``, area, cx, cy, ix, iy, sx, sy: a polygon's area and centroid, its second moments about axes through the
    centroid, and its elastic moduli, whichever way its points (x, y) go round. One without area has nulls."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
    p = p.withColumn("c", x * ny - nx * y)
    s = p.groupBy(key).agg(
        (F.sum("c") / 2).alias("a"), F.sum((x + nx) * F.col("c")).alias("sx"), F.sum((y + ny) * F.col("c")).alias("sy"),
        F.sum((y * y + y * ny + ny * ny) * F.col("c")).alias("ix"), F.sum((x * x + x * nx + nx * nx) * F.col("c")).alias("iy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    ).where("a <> 0")
    s = s.withColumns({"cx": F.col("sx") / (6 * F.col("a")), "cy": F.col("sy") / (6 * F.col("a"))})
    s = s.withColumns({"area": F.abs("a"), "ix": F.abs(F.col("ix") / 12 - F.col("a") * F.col("cy") * F.col("cy")), "iy": F.abs(F.col("iy") / 12 - F.col("a") * F.col("cx") * F.col("cx"))})
    far = lambda c: F.greatest(F.col(f"{c}1") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"{c}0"))
    return s.select(key, "area", "cx", "cy", "ix", "iy", (F.col("ix") / far("y")).alias("sx"), (F.col("iy") / far("x")).alias("sy"))


def arc(curves: DataFrame, n: int) -> DataFrame:
    """id, k, x, y: n + 1 points on each circular arc (id, cx, cy, radius, start, sweep in radians), ends included."""
    at = F.col("start") + F.col("sweep") * F.col("k") / n
    dealt = curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return dealt.select("id", "k", (F.col("cx") + F.col("radius") * F.cos(at)).alias("x"), (F.col("cy") + F.col("radius") * F.sin(at)).alias("y"))


def derived_lengths(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """id, length, error, status from lengths (id, length) at two tolerances: COMPLETE, LENGTH_ONLY (no coarse one) or
    BLOCKED (no fine one). The error is their difference, a trillionth of the length at least."""
    both = fine.join(coarse.withColumnRenamed("length", "__c"), "id", "full")
    error = F.when(F.col("__c").isNotNull(), F.greatest(F.abs(F.col("length") - F.col("__c")), 1e-12 * F.abs("length")))
    return both.select("id", "length", error.alias("error"), F.when(F.col("length").isNull(), "BLOCKED").when(F.col("__c").isNull(), "LENGTH_ONLY").otherwise("COMPLETE").alias("status"))


def mahalanobis2(parts: DataFrame, dims: list[str]) -> DataFrame:
    """a, b, m2: the squared distance of pairs a < b of a mixture's parts (part, mean_*, var_*) under their summed
    covariances, which are diagonal."""
    p = parts.select(F.col("part").alias("a"), *[F.col(f"{m}_{x}").alias(f"p_{m}_{x}") for m in ("mean", "var") for x in dims])
    q = parts.select(F.col("part").alias("b"), *[F.col(f"{m}_{x}").alias(f"q_{m}_{x}") for m in ("mean", "var") for x in dims])
    m2 = sum([F.pow(F.col(f"p_mean_{x}") - F.col(f"q_mean_{x}"), F.lit(2)) / (F.col(f"p_var_{x}") + F.col(f"q_var_{x}")) for x in dims], F.lit(0.0))
    return p.join(q, F.col("a") < F.col("b")).select("a", "b", m2.alias("m2"))


def overlap_mass(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, mass, nearest_a, nearest_b: for pairs of elements (a, b) the sum over their primitives (id, n, mean_x .. mean_z,
    var_x .. var_z, weight) of both weights times the integral of the product, and the nearest primitives of the two. Pairs
    come from a broad phase, so the work grows with what is near."""
    side = lambda df, s: df.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "weight", *[f"{m}_{x}" for m in ("mean", "var") for x in "xyz"])])
    joined = pairs.select("a", "b").join(side(left, "a"), "a").join(side(right, "b"), "b")
    far = sum([F.pow(F.col(f"mean_{x}_a") - F.col(f"mean_{x}_b"), F.lit(2)) for x in "xyz"], F.lit(0.0))
    log = sum([F.pow(F.col(f"mean_{x}_a") - F.col(f"mean_{x}_b"), F.lit(2)) / (F.col(f"var_{x}_a") + F.col(f"var_{x}_b")) + F.log(F.col(f"var_{x}_a") + F.col(f"var_{x}_b")) for x in "xyz"], F.lit(0.0))
    mass = F.col("weight_a") * F.col("weight_b") * F.exp(-0.5 * (3 * math.log(2 * math.pi) + log))
    found = joined.groupBy("a", "b").agg(F.sum(mass).alias("mass"), F.min(F.struct(far.alias("far"), "n_a", "n_b")).alias("__n"))
    return found.select("a", "b", "mass", F.col("__n.n_a").alias("nearest_a"), F.col("__n.n_b").alias("nearest_b"))


def pair_risk(pairs: DataFrame, tol: float = 0.01) -> DataFrame:
    """``pairs`` (clearance, variance) with ``p``, the chance that the clearance is below ``tol``, and ``significance``, the
    clearance in deviations; a pair without variance is sure, and its significance null."""
    from belvane.functions import scalars

    sigma = F.sqrt("variance")
    p = F.when(sigma > 1e-12, scalars.normal_cdf((tol - F.col("clearance")) / sigma)).otherwise(F.when(F.col("clearance") < tol, 1.0).otherwise(0.0))
    return pairs.withColumns({"p": F.round(p, 9), "significance": F.when(sigma > 1e-12, F.col("clearance") / sigma)})


def payload_means(tokens: DataFrame) -> DataFrame:
    """element, label, payload: the mean payload of each element's tokens (element, name, weight, payload) by weight; of
    elements that share a name, all but the first have their place behind it."""
    found = tokens.groupBy("element", "name").agg((F.sum(F.col("weight") * F.col("payload")) / F.sum("weight")).alias("payload"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("element"))
    return found.select("element", F.when(k == 1, F.col("name")).otherwise(F.concat_ws("#", "name", k.cast("string"))).alias("label"), "payload")


def transmittance(rays: DataFrame, parts: DataFrame) -> DataFrame:
    """ray, depth, transmittance of rays along x (ray, y, z, x0, x1) through round Gaussians (part, mean_x .. mean_z, var,
    weight): each adds its weight times what lies between the ends. Rays come with the parts that are near (ray, part)
    already joined, as ``near`` of a broad phase."""
    from belvane.functions import scalars

    joined = rays.join(parts, "part")
    s = F.sqrt("var")
    across = F.exp(-(F.pow(F.col("y") - F.col("mean_y"), F.lit(2)) + F.pow(F.col("z") - F.col("mean_z"), F.lit(2))) / (2 * F.col("var"))) / (2 * math.pi * F.col("var"))
    along = scalars.normal_cdf((F.col("x1") - F.col("mean_x")) / s) - scalars.normal_cdf((F.col("x0") - F.col("mean_x")) / s)
    found = joined.groupBy("ray").agg(F.sum(F.col("weight") * across * along).alias("depth"))
    return found.withColumn("transmittance", F.exp(-F.col("depth")))


def sided(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with each side's box, as ox_a .. ez_a and ox_b .. ez_b."""
    side = lambda s: boxes.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ox", "oy", "oz", "yaw", "ex", "ey", "ez")])
    return pairs.select("a", "b").join(growing(side("a")), "a").join(growing(side("b")), "b")


def centre_gradient(boxes: DataFrame) -> DataFrame:
    """id, component, extent, v: the derivatives of the centres of ``boxes`` by their extents; the origin stays."""
    c, s = F.cos("yaw") / 2, F.sin("yaw") / 2
    cells = (("x", "x", c), ("x", "y", -s), ("y", "x", s), ("y", "y", c), ("z", "z", F.lit(0.5)))
    return boxes.select("id", F.inline(F.array(*[F.struct(F.lit(p).alias("component"), F.lit(e).alias("extent"), v.alias("v")) for p, e, v in cells])))
