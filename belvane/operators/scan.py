"""Scans against a mixture: points, their likelihood, the sums of a registration step, and what they say of a face."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(parts: DataFrame, dims: list[str], most: int) -> DataFrame:
    """parts: the mixture (part, weight, mean_*, var_*) as one array in one row. More than ``most`` parts are an error."""
    names = ["part", "weight", *[f"{m}_{x}" for m in ("mean", "var") for x in dims]]
    if parts.limit(most + 1).count() > most:
        raise ValueError(f"a mixture of more than {most} parts")
    return parts.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts"))


def with_parts(points: DataFrame, parts: DataFrame, dims: list[str], *, most: int = 4096) -> DataFrame:
    """``points`` with ``parts``: the mixture as an array in every row. A mixture is a model's and has at most ``most`` parts,
    which is checked, so that its one row can go to every task."""
    return points.join(F.broadcast(one_row(parts, dims, most)))


def _log(p: Column, dims: list[str]) -> Column:
    far = sum([F.log(p[f"var_{x}"]) + F.pow(F.col(x) - p[f"mean_{x}"], F.lit(2)) / p[f"var_{x}"] for x in dims], F.lit(0.0))
    return F.log(p["weight"]) - 0.5 * (len(dims) * math.log(2 * math.pi) + far)


def scored(points: DataFrame, dims: list[str], outlier_share: float = 0.05, outlier_density: float = 0.1) -> DataFrame:
    """``points`` of :func:`with_parts` with ``nll`` and ``shares``, each part's share of the point; outliers of a flat
    density have the rest. All within the row: nothing is shuffled and a point meets its parts in memory."""
    flat, inlier = math.log(outlier_share * outlier_density), math.log(1 - outlier_share)
    logs = points.withColumn("__l", F.transform("parts", lambda p: _log(p, dims) + inlier))
    top = logs.withColumn("__top", F.greatest(F.array_max("__l"), F.lit(flat)))
    total = top.withColumn("__sum", F.aggregate("__l", F.exp(flat - F.col("__top")), lambda a, v: a + F.exp(v - F.col("__top"))))
    return total.withColumns({"nll": -(F.log("__sum") + F.col("__top")), "shares": F.transform("__l", lambda v: F.exp(v - F.col("__top")) / F.col("__sum"))}).drop("__l", "__top", "__sum")


def translation_sums(points: DataFrame, dims: list[str]) -> DataFrame:
    """n, nll (mean) and, for each axis, a and b of a translation step: the shift that fits best is b / a, a being the summed
    precision of what each point is held to, and b the same times its distance. Partial sums only."""
    cell = lambda x, f: F.aggregate(F.zip_with("parts", "shares", lambda p, s: F.struct(p.alias("p"), s.alias("s"))), F.lit(0.0), lambda a, y: a + y["s"] / y["p"][f"var_{x}"] * f(y["p"]))
    sums = [y for x in dims for y in (F.sum(cell(x, lambda p: F.lit(1.0))).alias(f"a_{x}"), F.sum(cell(x, lambda p, x=x: p[f"mean_{x}"] - F.col(x))).alias(f"b_{x}"))]
    return points.agg(F.count(F.lit(1)).alias("n"), F.avg("nll").alias("nll"), *sums)


def registered(points: DataFrame, parts: DataFrame, dims: list[str], *, rounds: int = 6, tol: float = 1e-9) -> tuple[dict[str, float], list[float]]:
    """The translation that fits ``points`` to ``parts``, by expectation-maximisation, and the mean negative log likelihood
    before each step. Each round is one pass that returns one row of sums; it ends when the likelihood stands still."""
    shift, trace = dict.fromkeys(dims, 0.0), []
    for _ in range(rounds):
        moved = points.withColumns({x: F.col(x) + F.lit(shift[x]) for x in dims})
        s = translation_sums(scored(with_parts(moved, parts, dims), dims), dims).first()
        if not s["n"]:
            break
        trace.append(s["nll"])
        if len(trace) > 1 and abs(trace[-2] - trace[-1]) < tol:
            break
        shift = {x: shift[x] + (s[f"b_{x}"] / s[f"a_{x}"] if s[f"a_{x}"] else 0.0) for x in dims}
    return shift, trace


def pose_information(points: DataFrame, dims: list[str]) -> DataFrame:
    """n, for each axis its information (the summed precision that points have of it) and sigma, its deviation."""
    s = translation_sums(points, dims)
    return s.select("n", *[y for x in dims for y in (F.col(f"a_{x}").alias(f"info_{x}"), F.when(F.col(f"a_{x}") > 0, 1 / F.sqrt(f"a_{x}")).alias(f"sigma_{x}"))])


def valid_points(points: DataFrame, dims: list[str], least: int = 3) -> DataFrame:
    """scan, n, bad (points with a coordinate that isn't finite) and a status: OK, NOT_FINITE or TOO_FEW."""
    bad = sum([(F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int") for x in dims], F.lit(0)) > 0
    found = points.groupBy("scan").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    return found.withColumn("status", F.when(F.col("bad") > 0, "NOT_FINITE").when(F.col("n") < least, "TOO_FEW").otherwise("OK"))


def face_offset(support: DataFrame, *, band: float, noise: float, least_mass: float, most_spread: float) -> DataFrame:
    """face, points, mass, offset, variance and a reason, null where the face's reading may be used, from ``support`` (face,
    share, gap: the signed distance of a point to the face, pose_var): points within ``band`` of a face count by their
    share. The noise of the reading is the spread of its points over their mass, the sensor's, and that of the pose."""
    near = support.where(F.abs("gap") <= band)
    found = near.groupBy("face").agg(F.count(F.lit(1)).alias("points"), F.sum("share").alias("mass"), F.sum(F.col("share") * F.col("gap")).alias("__g"), F.sum(F.col("share") * F.col("gap") * F.col("gap")).alias("__gg"), F.max("pose_var").alias("__pose"))
    mean = F.col("__g") / F.col("mass")
    spread = F.greatest(F.col("__gg") / F.col("mass") - mean * mean, F.lit(0.0))
    reason = F.when(F.col("mass") < least_mass, "TOO_LITTLE_SUPPORT").when(F.sqrt("__spread") > most_spread, "SPREAD")
    shown = found.withColumns({"offset": mean, "__spread": spread}).withColumn("variance", (F.col("__spread") + noise * noise) / F.col("mass") + F.col("__pose"))
    return shown.select("face", "points", "mass", "offset", "variance", reason.alias("reason"))
