"""Margins, samples, clearances and capacity claims, and what they decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.functions import scalars


def margins(mean: DataFrame, jacobian: DataFrame, sigma: DataFrame, *, pass_p: float = 0.9987, fail_p: float = 0.5) -> DataFrame:
    """model, out_var, mean, p, status of margins that should not be negative.

    ``mean`` (model, out_var, mu) and ``jacobian`` (model, out_var, var_id, v) are of the margins themselves, so that what
    both sides of one share cancels before the variance is summed. PASS at ``pass_p``, FAIL below ``fail_p``, else MARGINAL;
    ``p`` is compared at nine digits. A margin without variance is sure.
    """
    from belvane.operators.belief import variance_of

    joined = mean.join(variance_of(jacobian, sigma), ["model", "out_var"], "left")
    return judged_margins(joined, pass_p=pass_p, fail_p=fail_p).select("model", "out_var", F.col("mu").alias("mean"), "p", "status")


def judged_margins(rows: DataFrame, *, pass_p: float = 0.9987, fail_p: float = 0.5) -> DataFrame:
    """``rows`` (mu, var) of margins with p and status, as :func:`margins` gives them."""
    sure = F.when(F.col("mu") >= 0, 1.0).otherwise(0.0)
    p = F.round(F.when(F.col("var") > 0, scalars.normal_cdf(F.col("mu") / F.sqrt("var"))).otherwise(sure), 9)
    status = F.when(F.col("p") >= pass_p, "PASS").when(F.col("p") < fail_p, "FAIL").otherwise("MARGINAL")
    return rows.withColumn("p", p).withColumn("status", status)


def _uniform(key: Column, at: int) -> Column:
    """A number in (0, 1] from 48 bits of a digest."""
    return (F.conv(F.substring(key, at, 12), 16, 10).cast("long") + 1) / float(1 << 48)


#: No draw is farther from its mean, in deviations: the least number of :func:`_uniform` is 2^-48; and some for rounding.
REACH = math.sqrt(2 * 48 * math.log(2)) + 0.01


def samples(slots: DataFrame, n: int, seed: int) -> DataFrame:
    """``slots`` (model, var_id, mu, sigma) drawn ``n`` times: with ``sample`` (0 to n - 1), and ``mu`` the drawn value.

    A draw depends on the seed, its number and the variable alone, so it is the same however the rows are partitioned
    and when a lost task runs again.
    """
    drawn = _numbered(slots, n).withColumn("__key", _draw_key(seed))
    return drawn.withColumn("mu", F.col("mu") + F.col("sigma") * _normal(F.col("__key"))).drop("__key")


def sampled_negatives(slots: DataFrame, n: int, seed: int) -> DataFrame:
    """``slots`` (model, var_id, mu, sigma) with ``sample`` (0 to n - 1) and ``bad``: whether the value that :func:`samples`
    draws is below 0. What lies farther above 0 than any draw reaches needs no digest to tell."""
    sure = F.coalesce(F.col("mu") > REACH * F.abs("sigma"), F.lit(False))
    drawn = _numbered(slots, n).withColumn("__key", F.when(~sure, _draw_key(seed)))
    below = F.col("mu") + F.col("sigma") * _normal(F.col("__key")) < 0
    return drawn.withColumn("bad", F.when(F.col("__key").isNull(), F.lit(False)).otherwise(below)).drop("__key")


def _numbered(slots: DataFrame, n: int) -> DataFrame:
    return slots.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _draw_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), F.col("model").cast("string"), F.col("var_id")))


def _normal(key: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(key, 1))) * F.cos(2 * math.pi * _uniform(key, 13))


def violation_rates(drawn: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``by``, rate, pass_rate of ``drawn`` (sample, bad): bad values over all, and samples without any."""
    each = drawn.groupBy(*by, "sample").agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col("bad"), 1)).alias("__bad"))
    return each.groupBy(*by).agg((F.sum("__bad") / F.sum("__n")).alias("rate"), (F.count(F.when(F.col("__bad") == 0, 1)) / n).alias("pass_rate"))


def separation(pairs: DataFrame) -> DataFrame:
    """``pairs`` of boxes (each side's ox, oy, oz, yaw, ex, ey, ez with suffix _a or _b) with ``clearance`` and ``axis``.

    Boxes turned about the vertical are apart if they are on one of five axes: two of each box and the vertical. The
    widest gap is the clearance; it is negative for boxes that meet. Ties go to the first axis.
    """
    def centre(s: str) -> tuple[Column, Column]:
        x, y, yaw = F.col(f"ex_{s}") / 2, F.col(f"ey_{s}") / 2, F.col(f"yaw_{s}")
        return F.col(f"ox_{s}") + x * F.cos(yaw) - y * F.sin(yaw), F.col(f"oy_{s}") + x * F.sin(yaw) + y * F.cos(yaw)

    (ax, ay), (bx, by) = centre("a"), centre("b")
    dx, dy = bx - ax, by - ay

    def reach(s: str, nx: Column, ny: Column) -> Column:
        yaw = F.col(f"yaw_{s}")
        return F.abs(nx * F.cos(yaw) + ny * F.sin(yaw)) * F.col(f"ex_{s}") / 2 + F.abs(ny * F.cos(yaw) - nx * F.sin(yaw)) * F.col(f"ey_{s}") / 2

    flat = [(F.cos(F.col(f"yaw_{s}") + t), F.sin(F.col(f"yaw_{s}") + t)) for s in "ab" for t in (0.0, math.pi / 2)]
    gaps = [F.abs(dx * nx + dy * ny) - reach("a", nx, ny) - reach("b", nx, ny) for nx, ny in flat]
    gaps.append(F.abs((F.col("oz_b") + F.col("ez_b") / 2) - (F.col("oz_a") + F.col("ez_a") / 2)) - (F.col("ez_a") + F.col("ez_b")) / 2)
    return pairs.withColumn("__gaps", F.array(*gaps)).withColumn("clearance", F.array_max("__gaps")).withColumn("axis", F.array_position("__gaps", F.col("clearance")) - 1).drop("__gaps")


def flat_clearance(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and each side's box, as ``geometry.sided`` gives them) with pair (the text a:b), clearance, axis (0 to 3:
    two of a, two of b), its direction nx, ny and side (1 where b lies along it, else -1). The widest gap is the clearance,
    compared at nine digits; ties go to the first axis, so the gradient is that of one axis."""
    across = [(F.cos(F.col(f"yaw_{s}") + t), F.sin(F.col(f"yaw_{s}") + t)) for s in "ab" for t in (0.0, math.pi / 2)]
    middle = lambda s: (F.col(f"ox_{s}") + F.col(f"ex_{s}") / 2 * F.cos(f"yaw_{s}") - F.col(f"ey_{s}") / 2 * F.sin(f"yaw_{s}"), F.col(f"oy_{s}") + F.col(f"ex_{s}") / 2 * F.sin(f"yaw_{s}") + F.col(f"ey_{s}") / 2 * F.cos(f"yaw_{s}"))
    (ax, ay), (bx, by) = middle("a"), middle("b")
    options = []
    for k, (nx, ny) in enumerate(across):
        along = (bx - ax) * nx + (by - ay) * ny
        side = F.when(along >= 0, 1.0).otherwise(-1.0)
        gap = side * along - sum([r * F.col(f"e{e}_{s}") for s in "ab" for e, r in _reach(s, nx, ny).items()], F.lit(0.0))
        options.append(F.struct((-F.round(gap, 9)).alias("less"), F.lit(k).alias("axis"), gap.alias("clearance"), nx.alias("nx"), ny.alias("ny"), side.alias("side")))
    best = pairs.withColumn("__best", F.array_min(F.array(*options)))
    return best.select("*", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), *[f"__best.{c}" for c in ("clearance", "axis", "nx", "ny", "side")]).drop("__best")


def _reach(s: str, nx: Column, ny: Column) -> dict[str, Column]:
    """How far box ``s`` reaches along a direction for each unit of its extents."""
    yaw = F.col(f"yaw_{s}")
    return {"x": F.abs(nx * F.cos(yaw) + ny * F.sin(yaw)) / 2, "y": F.abs(ny * F.cos(yaw) - nx * F.sin(yaw)) / 2}


def clearance_gradient(apart: DataFrame) -> DataFrame:
    """pair, id, extent, v: the derivatives of each clearance of :func:`flat_clearance` by both boxes' extents. An extent moves
    the box's centre, as the origin stays, and its reach."""
    nx, ny, cells = F.col("nx"), F.col("ny"), []
    for s, sign in (("a", -1), ("b", 1)):
        yaw = F.col(f"yaw_{s}")
        along = {"x": (nx * F.cos(yaw) + ny * F.sin(yaw)) / 2, "y": (ny * F.cos(yaw) - nx * F.sin(yaw)) / 2}
        cells += [F.struct(F.col(s).alias("id"), F.lit(e).alias("extent"), (sign * F.col("side") * along[e] - r).alias("v")) for e, r in _reach(s, nx, ny).items()]
    return apart.select("pair", F.inline(F.array(*cells)))


def assess_clearance(risks: DataFrame, key: str, required: float, sigma: float, *, confidence: float = 0.95) -> DataFrame:
    """``key``, elements, p_lower, p_upper, verdict from ``risks`` (key, clearance).

    The chance that any element is nearer than ``required`` lies between the largest single chance and their sum, however
    they depend on each other; the verdict holds for both ends or is UNRESOLVED.
    """
    p = risks.select(key, scalars.normal_cdf((required - F.col("clearance")) / sigma).alias("p"))
    found = p.groupBy(key).agg(F.count(F.lit(1)).alias("elements"), F.round(F.max("p"), 9).alias("p_lower"), F.round(F.least(F.lit(1.0), F.sum("p")), 9).alias("p_upper"))
    verdict = F.when(F.col("p_upper") <= round(1 - confidence, 9), "SATISFIED").when(F.col("p_lower") >= confidence, "VIOLATED").otherwise("UNRESOLVED")
    return found.withColumn("verdict", verdict)


def capacity_claim(beams: DataFrame, factor_ppm: int = 900_000) -> DataFrame:
    """id, nominal, available, verdict, digest of ``beams`` (id, strength, modulus, demand: whole numbers) in fixed point.

    The factor, in parts of a million, is applied by whole-number division with ties to even. Products beyond 38 digits
    give null figures and the verdict OVERFLOW.
    """
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    nominal = beams.withColumn("nominal", (whole("strength") * whole("modulus")).cast("decimal(38,0)"))
    scaled = nominal.withColumn("__n", F.expr(f"try_multiply(nominal, cast({factor_ppm} as decimal(7,0)))").cast("decimal(38,0)"))
    rest = scaled.withColumn("__r", (F.col("__n") % F.lit(1_000_000)).cast("long")).withColumn("__q", ((F.col("__n") - F.col("__r")) / F.lit(1_000_000)).cast("decimal(31,0)"))
    up = (F.col("__r") > 500_000) | ((F.col("__r") == 500_000) & ((F.col("__q") % 2) == 1))
    found = rest.withColumn("available", (F.col("__q") + up.cast("int")).cast("decimal(32,0)"))
    verdict = F.when(F.col("available").isNull(), "OVERFLOW").when(F.col("available") >= F.col("demand"), "PASS").otherwise("FAIL")
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("strength", "modulus", "demand", "nominal", "available")], verdict)
    return found.select("id", F.col("nominal").cast("string").alias("nominal"), F.col("available").cast("string").alias("available"), verdict.alias("verdict"), F.sha2(line, 256).alias("digest"))


def evidence_plan(decided: DataFrame, options: DataFrame) -> DataFrame:
    """model, disposition, var_id, gain: stop where the decision (model, verdict) is made, else read what tells most.

    ``options`` (model, var_id, gain) hold the best reading of each model, its cost taken off; one that gains nothing
    isn't worth while. Only a reading that is to be made is named.
    """
    joined = decided.join(options, "model", "left")
    worth = F.coalesce(F.col("gain") > 1e-15, F.lit(False))
    found = F.when(F.col("verdict") != "UNRESOLVED", "DECISION_RESOLVED").when(worth, "OBSERVE").otherwise("NO_WORTHWHILE_EVIDENCE")
    told = joined.withColumn("disposition", found)
    only = lambda c: F.when(F.col("disposition") == "OBSERVE", F.col(c)).alias(c)
    return told.select("model", "disposition", only("var_id"), only("gain"))


def route_inspections(risks: DataFrame, evidence: DataFrame, *, enough: float, sigma: float, required: float) -> DataFrame:
    """``risks`` (id, element, clearance) with entropy, deficit, action and priority.

    ``evidence`` (element, mass) is what scans hold of an element. Its deficit is the share missing of ``enough``; without
    one there is a measurement to extract, else the element is scanned again. The priority is the entropy of the decision
    times 1 + deficit, a rule of thumb.
    """
    p = scalars.normal_cdf((required - F.col("clearance")) / sigma)
    joined = risks.join(evidence, "element", "left").withColumn("deficit", F.greatest(F.lit(0.0), 1 - F.coalesce("mass", F.lit(0.0)) / enough)).withColumn("entropy", scalars.binary_entropy(p))
    action = F.when(F.col("deficit") == 0, "EXTRACT_SCAN_MEASUREMENT").otherwise("RESCAN_ELEMENT")
    return joined.select("id", "element", "entropy", "deficit", action.alias("action"), (F.col("entropy") * (1 + F.col("deficit"))).alias("priority"))


def _resting_on(columns: list[str]) -> Column:
    """A digest of columns; each part comes with its length, so none can be read as two."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *[x for c, p in zip(columns, parts, strict=True) for x in (F.when(F.col(c).isNull(), "-").otherwise(F.length(p).cast("string")), p)]), 256)


def decided(cases: DataFrame, passed: Column, rests_on: list[str]) -> DataFrame:
    """digest, verdict of ``cases``: the digest of what each rests on, and PASS or FAIL."""
    return cases.select(_resting_on(rests_on).alias("digest"), F.when(passed, "PASS").otherwise("FAIL").alias("verdict"))


def with_reuse(cases: DataFrame, known: DataFrame, passed: Column, rests_on: list[str]) -> DataFrame:
    """``cases`` with digest, verdict and ``reused``: a verdict that is ``known`` (:func:`decided`) for the same digest is
    taken over, only the others are worked out."""
    marked = cases.withColumn("digest", _resting_on(rests_on))
    told = known.groupBy("digest").agg(F.max("verdict").alias("__known"))
    joined = marked.join(told, "digest", "left")
    verdict = F.when(F.col("__known").isNotNull(), F.col("__known")).when(passed, "PASS").otherwise("FAIL")
    return joined.withColumns({"verdict": verdict, "reused": F.col("__known").isNotNull()}).drop("__known")
