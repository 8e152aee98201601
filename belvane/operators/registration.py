"""Scans laid over a mixture by a turn about the vertical and a shift, from several starts at once.

``points`` are (id, x, y, z), a mixture's parts (part, weight, mean_x .. mean_z, and s_xx, s_xy, s_xz, s_yy, s_yz, s_zz of its
covariance). A pass over the points returns a few sums for each pose that is tried, whatever their number; poses are four
numbers each, kept on the driver. Parts are a model's, at most ``most`` of them, which is checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "yaw")
_CELLS = [(i, j) for i in range(4) for j in range(i, 4)]
SUMS = ["n", "nll", *[f"g_{a}" for a in AXES], *[f"h_{AXES[i]}_{AXES[j]}" for i, j in _CELLS]]
#: Points times parts that a task holds at once.
_CHUNK = 1 << 18


class Mixture(NamedTuple):
    names: list
    means: np.ndarray
    precisions: np.ndarray
    logs: np.ndarray
    outlier: float


class Pose(NamedTuple):
    x: float
    y: float
    z: float
    yaw: float


class Fit(NamedTuple):
    pose: Pose
    nll: float
    trace: list[float]
    starts: list[float]
    information: np.ndarray
    accepted: bool


def mixture(parts: DataFrame, *, smooth: float, outliers: float = 0.05, most: int = 4096) -> Mixture:
    """The parts with ``smooth`` (a length) added to their spread; outliers have a flat density over the box of the means and
    one unit around it."""
    names = ["part", "weight", *[f"mean_{a}" for a in "xyz"], "s_xx", "s_xy", "s_xz", "s_yy", "s_yz", "s_zz"]
    rows = sorted(parts.select(names).limit(most + 1).collect(), key=lambda r: str(r["part"]))
    if not rows or len(rows) > most:
        raise ValueError(f"a mixture of no parts, or of more than {most}")
    s = np.array([[[r["s_xx"], r["s_xy"], r["s_xz"]], [r["s_xy"], r["s_yy"], r["s_yz"]], [r["s_xz"], r["s_yz"], r["s_zz"]]] for r in rows], dtype=float) + smooth**2 * np.eye(3)
    means, weights = np.array([[r[f"mean_{a}"] for a in "xyz"] for r in rows], dtype=float), np.array([r["weight"] for r in rows], dtype=float)
    logs = math.log(1 - outliers) + np.log(weights / weights.sum()) - 0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(s)[1])
    box = np.prod(means.max(axis=0) - means.min(axis=0) + 2)
    return Mixture([r["part"] for r in rows], means, np.linalg.inv(s), logs, math.log(outliers) - math.log(box))


def _moved(p: np.ndarray, pose: Pose) -> tuple[np.ndarray, np.ndarray]:
    """The points at a pose, and their derivative by the turn."""
    c, s = math.cos(pose.yaw), math.sin(pose.yaw)
    turned = np.stack([c * p[:, 0] - s * p[:, 1], s * p[:, 0] + c * p[:, 1], p[:, 2]], axis=1)
    return turned + np.array(pose[:3]), np.stack([-turned[:, 1], turned[:, 0], np.zeros(len(p))], axis=1)


def _shares(q: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the parts in each point, distances to them (as vectors and squared), and the negative log likelihoods."""
    d = q[:, None, :] - m.means[None, :, :]
    m2 = np.einsum("nki,kij,nkj->nk", d, m.precisions, d)
    logs = m.logs - 0.5 * m2
    top = np.maximum(logs.max(axis=1), m.outlier)
    e = np.exp(logs - top[:, None])
    total = e.sum(axis=1) + np.exp(m.outlier - top)
    return e / total[:, None], d, m2, -(np.log(total) + top)


def _points(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1).astype(float)


def _sums(batches: Iterator[pa.RecordBatch], m: Mixture, poses: list[Pose]) -> Iterator[pa.RecordBatch]:
    out = np.zeros((len(poses), len(SUMS)))
    for b in batches:
        p = _points(b)
        for at in range(0, len(p), max(1, _CHUNK // len(m.means))):
            part = p[at : at + max(1, _CHUNK // len(m.means))]
            for k, pose in enumerate(poses):
                q, turn = _moved(part, pose)
                r, d, _, nll = _shares(q, m)
                weight = np.einsum("nk,kij->nij", r, m.precisions)
                pull = np.einsum("nk,kij,nkj->ni", r, m.precisions, d)
                j = np.concatenate([np.broadcast_to(np.eye(3), (len(part), 3, 3)), turn[:, :, None]], axis=2)
                g, h = np.einsum("nia,ni->a", j, pull), np.einsum("nia,nij,njb->ab", j, weight, j)
                out[k] += np.concatenate([[len(part), nll.sum()], g, [h[i, l] for i, l in _CELLS]])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(poses)), pa.int32()), *[pa.array(out[:, k]) for k in range(len(SUMS))]], ["pose", *SUMS])


def pose_sums(points: DataFrame, m: Mixture, poses: list[Pose]) -> DataFrame:
    """pose (its number), n, nll (mean), and the gradient g and Gauss-Newton matrix h of the summed nll by x, y, z and yaw."""
    schema = "pose int, " + ", ".join(f"{c} double" for c in SUMS)
    found = points.select(*"xyz").mapInArrow(partial(_sums, m=m, poses=poses), schema).groupBy("pose").agg(*[F.sum(c).alias(c) for c in SUMS])
    return found.withColumns({"nll": F.col("nll") / F.col("n"), "n": F.col("n").cast("long")})


def _matrix(row) -> np.ndarray:  # noqa: ANN001
    h = np.zeros((4, 4))
    for i, j in _CELLS:
        h[i, j] = h[j, i] = row[f"h_{AXES[i]}_{AXES[j]}"]
    return h


def _descend(points: DataFrame, m: Mixture, starts: list[Pose], rounds: int, tol: float, tries: tuple[float, ...] = (1.0, 0.25, 0.0625)) -> list[tuple[Pose, list[float], np.ndarray]]:
    """For each start its pose, the nll before and after each step, and the matrix at the end. A pass tries a few lengths of
    every start's step at once, and the longest that doesn't raise the nll is taken; where none is, the start rests."""
    at = {r["pose"]: r for r in pose_sums(points, m, starts).collect()}
    state = [[s, [at[k]["nll"]], at[k]] for k, s in enumerate(starts)]
    live = set(range(len(starts)))
    for _ in range(rounds):
        tried = []
        for k in sorted(live):
            pose, _, row = state[k]
            step = -np.linalg.lstsq(_matrix(row), np.array([row[f"g_{a}"] for a in AXES]), rcond=1e-12)[0]
            tried += [(k, Pose(*(np.array(pose) + f * step))) for f in tries]
        if not tried:
            break
        found = {r["pose"]: r for r in pose_sums(points, m, [p for _, p in tried]).collect()}
        for k in sorted(live):
            best = next((i for i, (s, _) in enumerate(tried) if s == k and found[i]["nll"] <= state[k][1][-1]), None)
            if best is None:
                live.discard(k)
                continue
            state[k][1].append(found[best]["nll"])
            state[k][0], state[k][2] = tried[best][1], found[best]
            if state[k][1][-2] - state[k][1][-1] < tol:
                live.discard(k)
    return [(p, trace, _matrix(row)) for p, trace, row in state]


def registered(points: DataFrame, parts: DataFrame, *, starts: int = 8, coarse: float = 0.08, fine: float = 0.03, gate: float = 6.0, first: int = 6, rounds: int = 30, tol: float = 1e-9) -> Fit:
    """The pose that lays ``points`` over ``parts``: ``starts`` turns, each with the centres laid on one another, go ``first``
    rounds together over the smoothed mixture, the best of them (the first of equal ones) goes on, and then over the mixture
    with less smoothing. It is accepted if its mean nll is below ``gate``. Fewer than ten points, or any that isn't finite,
    are an error."""
    bad = sum([(F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf"))).cast("int") for a in "xyz"], F.lit(0))
    told = points.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"), *[F.avg(a).alias(a) for a in "xyz"]).first()
    if told["n"] < 10 or told["bad"]:
        raise ValueError(f"{told['n']} points, {told['bad'] or 0} coordinates that aren't finite")
    wide, narrow = mixture(parts, smooth=coarse), mixture(parts, smooth=fine)
    centre, own = wide.means.mean(axis=0), np.array([told[a] for a in "xyz"])
    poses = []
    for k in range(starts):
        yaw = 2 * math.pi * k / starts
        turned, _ = _moved(own[None, :], Pose(0.0, 0.0, 0.0, yaw))
        poses.append(Pose(*(centre - turned[0]), yaw))
    begun = _descend(points, wide, poses, first, tol)
    best = min(range(starts), key=lambda k: (round(begun[k][1][-1], 12), k))
    (pose, trace, _), = _descend(points, wide, [begun[best][0]], rounds, tol)
    (pose, fine_trace, information), = _descend(points, narrow, [pose], rounds, tol)
    yaw = (pose.yaw + math.pi) % (2 * math.pi) - math.pi
    return Fit(pose._replace(yaw=yaw), fine_trace[-1], begun[best][1] + trace[1:] + fine_trace, [b[1][-1] for b in begun], information, fine_trace[-1] < gate)


def _posterior(batches: Iterator[pa.RecordBatch], m: Mixture, pose: Pose, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p, ids = _points(b), b.column("id")
        for at in range(0, len(p), max(1, _CHUNK // len(m.means))):
            q, _ = _moved(p[at : at + max(1, _CHUNK // len(m.means))], pose)
            r, _, m2, _ = _shares(q, m)
            n, k = np.nonzero(r > least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(n + at)), pa.array([m.names[x] for x in k.tolist()], pa.string()), *[pa.array(q[n, i]) for i in range(3)], pa.array(r[n, k]), pa.array(m2[n, k])], ["id", "part", *"xyz", "share", "m2"])


def posterior_at(points: DataFrame, parts: DataFrame, fit: Fit, *, pose: Pose | None = None, smooth: float = 0.03, least: float = 0.0, scan: str | None = None, fitted_scan: str | None = None, scene: str | None = None, fitted_scene: str | None = None) -> DataFrame:
    """id, part, x, y, z, share, m2: where each point lies at ``pose`` (that of the fit, if none is given: a pose from a survey
    keeps the two apart), and what share of it each part has, with the squared distance to the part. Shares of ``least`` or
    less have no row. Refused, as an error: a fit that wasn't accepted, and digests of scan or scene that aren't the fit's."""
    if not fit.accepted:
        raise ValueError("the fit was not accepted")
    if scene != fitted_scene:
        raise ValueError("the fit is of another scene")
    if scan != fitted_scan:
        raise ValueError("the fit is of another scan")
    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", *"xyz").mapInArrow(partial(_posterior, m=mixture(parts, smooth=smooth), pose=pose or fit.pose, least=least), f"id {kind}, part string, x double, y double, z double, share double, m2 double")


#: The upper half of a symmetric matrix over x, y, z and yaw, as columns.
HALF = [f"c_{AXES[i]}_{AXES[j]}" for i, j in _CELLS]


def _full(rows: pd.DataFrame) -> np.ndarray:
    c = np.zeros((len(rows), 4, 4))
    for name, (i, j) in zip(HALF, _CELLS, strict=True):
        c[:, i, j] = c[:, j, i] = rows[name]
    return c


def disagreement(fits: DataFrame, poses: DataFrame) -> DataFrame:
    """scan, m2, status: how far an independent pose of each scan (``poses``: scan, x, y, z, yaw and the covariance
    ``HALF``) is from the fitted one (``fits``, the same columns with h_.. of the information), squared and under both
    covariances; turns are compared around the circle. SINGULAR where these have no inverse, and null then."""
    theirs = poses.select("scan", *[F.col(a).alias(f"p_{a}") for a in AXES], *HALF)
    joined = fits.select("scan", *AXES, *[f"h_{c[2:]}" for c in HALF]).join(theirs, "scan")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, c = _full(b.drop(columns=HALF).rename(columns={f"h_{n[2:]}": n for n in HALF})), _full(b)
            delta = np.stack([b[f"p_{a}"] - b[a] for a in AXES], axis=1)
            delta[:, 3] = (delta[:, 3] + np.pi) % (2 * np.pi) - np.pi
            m2 = []
            for k in range(len(b)):
                try:
                    m2.append(float(delta[k] @ np.linalg.solve(np.linalg.inv(h[k]) + c[k], delta[k])))
                except np.linalg.LinAlgError:
                    m2.append(None)
            yield pd.DataFrame({"scan": b["scan"], "m2": pd.array(m2, dtype="Float64")})

    kind = fits.schema["scan"].dataType.simpleString()
    found = joined.mapInPandas(solve, f"scan {kind}, m2 double")
    return found.withColumn("status", F.when(F.col("m2").isNull(), "SINGULAR").otherwise("OK"))


def support_pose_variance(support: DataFrame, poses: DataFrame) -> DataFrame:
    """scan, face, mass, pose_var: what the uncertainty of a pose adds to a face's offset. ``support`` (scan, face, x, y, z, share,
    nx, ny, nz) has the scan's own points with their shares and the face's direction, ``poses`` (scan, yaw, ``HALF``)."""
    turned = support.join(poses.select("scan", "yaw"), "scan")
    c, s = F.cos("yaw"), F.sin("yaw")
    by_turn = (-s * F.col("x") - c * F.col("y")) * F.col("nx") + (c * F.col("x") - s * F.col("y")) * F.col("ny")
    sums = turned.groupBy("scan", "face").agg(F.sum("share").alias("mass"), F.sum(F.col("share") * by_turn).alias("t"), *[F.max(f"n{a}").alias(f"n{a}") for a in "xyz"])
    j = {"x": F.col("nx"), "y": F.col("ny"), "z": F.col("nz"), "yaw": F.col("t") / F.col("mass")}
    var = sum([(1 if i == k else 2) * j[AXES[i]] * j[AXES[k]] * F.col(n) for n, (i, k) in zip(HALF, _CELLS, strict=True)], F.lit(0.0))
    return sums.join(poses.select("scan", *HALF), "scan").select("scan", "face", "mass", F.greatest(var, F.lit(0.0)).alias("pose_var"))
