"""Splats: each primitive's covariance as three lengths and a turn, with a colour and an opacity, as columns alone.

Eigenvalues of a symmetric 3x3 matrix are the roots of a cubic, in closed form by an angle; their vectors are cross products
of rows. Where two roots are as good as equal, any vectors across the third do, and where all are, the axes themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The zeroth spherical harmonic.
C0 = 0.28209479177387814
_S = ("xx", "xy", "xz", "yy", "yz", "zz")


def logit(p: float) -> float:
    """The inverse of the sigmoid, within a millionth of 0 and 1."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _columns(df: DataFrame, name: str, vector: list[Column]) -> tuple[DataFrame, list[Column]]:
    df = df.withColumns({f"{name}{k}": v for k, v in enumerate(vector)})
    return df, [F.col(f"{name}{k}") for k in range(3)]


def _unit(df: DataFrame, name: str, candidates: list[list[Column]]) -> tuple[DataFrame, list[Column]]:
    """The longest of some vectors, at length 1."""
    longest = F.array_max(F.array(*[F.struct(_dot(v, v).alias("n"), F.array(*v).alias("v")) for v in candidates]))
    df = df.withColumn(f"{name}__", longest)
    return _columns(df, name, [F.get(F.col(f"{name}__.v"), F.lit(k)) / F.sqrt(f"{name}__.n") for k in range(3)])


def scaled_and_turned(parts: DataFrame) -> DataFrame:
    """``parts`` (s_xx, s_xy, s_xz, s_yy, s_yz, s_zz) with scale_0 to scale_2, the deviations along the main axes from the
    least up, and rot_0 to rot_3, the turn to them as a unit quaternion (w first, not negative)."""
    s = {c: F.col(f"s_{c}") for c in _S}
    keep = parts.columns
    # scaled by its mean, so that "as good as equal" doesn't depend on the unit
    mean = (s["xx"] + s["yy"] + s["zz"]) / 3
    df = parts.withColumn("__m", F.when(F.abs(mean) > 1e-300, F.abs(mean)).otherwise(1.0)).withColumns({f"__{c}": s[c] / F.col("__m") for c in _S})
    a = {c: F.col(f"__{c}") for c in _S}
    q = (a["xx"] + a["yy"] + a["zz"]) / 3
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    df = df.withColumns({"__q": q, "__p": F.sqrt(((a["xx"] - q) * (a["xx"] - q) + (a["yy"] - q) * (a["yy"] - q) + (a["zz"] - q) * (a["zz"] - q) + 2 * off) / 6)})
    q, p = F.col("__q"), F.col("__p")
    b = {c: (a[c] - q if c in ("xx", "yy", "zz") else a[c]) / F.when(p > 0, p).otherwise(1.0) for c in _S}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    df = df.withColumn("__phi", F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3)
    phi = F.col("__phi")
    df = df.withColumns({"__high": q + 2 * p * F.cos(phi), "__low": q + 2 * p * F.cos(phi + 2 * math.pi / 3)})
    df = df.withColumns({"__mid": 3 * q - F.col("__high") - F.col("__low")})
    # the end that is farther from the middle has the surer vector
    alone = F.when(F.col("__high") - F.col("__mid") >= F.col("__mid") - F.col("__low"), F.col("__high")).otherwise(F.col("__low"))
    df = df.withColumns({"__alone": alone, "__flat": p < 1e-14})
    rows = [[a["xx"] - F.col("__alone"), a["xy"], a["xz"]], [a["xy"], a["yy"] - F.col("__alone"), a["yz"]], [a["xz"], a["yz"], a["zz"] - F.col("__alone")]]
    unit = lambda k: [F.lit(1.0 if i == k else 0.0) for i in range(3)]
    one_way = [_cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    flat = lambda v, k: [F.when(F.col("__flat"), e).otherwise(x) for x, e in zip(v, unit(k), strict=True)]
    df, u = _unit(df, "__u", [flat(v, 2) for v in one_way])
    # in the plane across it, two vectors, and the 2x2 matrix there, which one turn makes diagonal
    df, e = _unit(df, "__e", [_cross(u, unit(k)) for k in range(3)])
    df, f = _columns(df, "__f", _cross(u, e))
    times = lambda v: [a["xx"] * v[0] + a["xy"] * v[1] + a["xz"] * v[2], a["xy"] * v[0] + a["yy"] * v[1] + a["yz"] * v[2], a["xz"] * v[0] + a["yz"] * v[1] + a["zz"] * v[2]]
    df = df.withColumn("__t", 0.5 * F.atan2(2 * _dot(e, times(f)), _dot(e, times(e)) - _dot(f, times(f))))
    c, n = F.cos("__t"), F.sin("__t")
    df, more = _columns(df, "__g", [c * x + n * y for x, y in zip(e, f, strict=True)])  # of the greater value of the two
    df, less = _columns(df, "__h", [c * y - n * x for x, y in zip(e, f, strict=True)])
    top = F.col("__alone") == F.col("__high")
    low = [F.when(top, x).otherwise(y) for x, y in zip(less, u, strict=True)]
    mid = [F.when(top, x).otherwise(y) for x, y in zip(more, less, strict=True)]
    df, low = _columns(df, "__l", low)
    df, mid = _columns(df, "__k", mid)
    df, high = _columns(df, "__o", _cross(low, mid))  # a turn, no reflection
    axes = [low, mid, high]
    length = lambda v: F.sqrt(F.greatest(_dot(v, times(v)) * F.col("__m"), F.lit(1e-12)))
    df = df.withColumns({f"scale_{k}": length(v) for k, v in enumerate(axes)})
    r = lambda i, j: axes[j][i]
    trace = r(0, 0) + r(1, 1) + r(2, 2)
    # of the four forms of a quaternion, the one with the greatest part of its own
    forms = [
        (1 + trace, lambda t: [t, r(2, 1) - r(1, 2), r(0, 2) - r(2, 0), r(1, 0) - r(0, 1)]),
        (1 + 2 * r(0, 0) - trace, lambda t: [r(2, 1) - r(1, 2), t, r(0, 1) + r(1, 0), r(0, 2) + r(2, 0)]),
        (1 + 2 * r(1, 1) - trace, lambda t: [r(0, 2) - r(2, 0), r(0, 1) + r(1, 0), t, r(1, 2) + r(2, 1)]),
        (1 + 2 * r(2, 2) - trace, lambda t: [r(1, 0) - r(0, 1), r(0, 2) + r(2, 0), r(1, 2) + r(2, 1), t]),
    ]
    best = F.array_max(F.array(*[F.struct(t.alias("t"), F.array(*make(t)).alias("q")) for t, make in forms]))
    df = df.withColumn("__best", best)
    part = lambda k: F.get(F.col("__best.q"), F.lit(k)) / (2 * F.sqrt("__best.t"))
    sign = F.when(part(0) < 0, -1.0).otherwise(1.0)
    df = df.withColumns({f"rot_{k}": sign * part(k) for k in range(4)})
    return df.select(*keep, *[f"scale_{k}" for k in range(3)], *[f"rot_{k}" for k in range(4)])


def table(parts: DataFrame, colours: dict[str, tuple[float, float, float]], *, other: tuple[float, float, float] = (0.8, 0.8, 0.8), opacity: float = 0.85, clear: dict[str, float] | None = None) -> DataFrame:
    """x, y, z, f_dc_0 to f_dc_2 (colour about grey, in units of the zeroth harmonic), opacity (as a logit), scale_0 to scale_2
    (logarithms) and rot_0 to rot_3 of ``parts`` (id, class, mean_x .. mean_z and the covariance). Colours go by class, from 0 to
    1; ``clear`` has the opacity of classes that have their own."""
    def by_class(values: dict[str, float], rest: float) -> Column:
        out = F.lit(rest)
        for name, v in values.items():
            out = F.when(F.col("class") == name, v).otherwise(out)
        return out

    made = scaled_and_turned(parts)
    dc = [by_class({k: (v[i] - 0.5) / C0 for k, v in colours.items()}, (other[i] - 0.5) / C0).alias(f"f_dc_{i}") for i in range(3)]
    seen = by_class({k: logit(v) for k, v in (clear or {}).items()}, logit(opacity)).alias("opacity")
    return made.select("id", *[F.col(f"mean_{a}").alias(a) for a in "xyz"], *dc, seen, *[F.log(F.greatest(F.col(f"scale_{k}"), F.lit(1e-9))).alias(f"scale_{k}") for k in range(3)], *[f"rot_{k}" for k in range(4)])
