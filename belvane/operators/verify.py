"""Invariants over a model's tables, their registry, and what may be committed.

An invariant is a function from a world (tables by name) to rows (model, rule, subject, status, detail), with FAIL or WARN
as the status; what holds has no row. ``REGISTRY`` is the list that :func:`report` runs; a user appends to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

World = dict[str, DataFrame]
Invariant = Callable[[World], DataFrame]


def _rows(found: DataFrame, rule: str, status: Column, detail: Column) -> DataFrame:
    return found.select("model", F.lit(rule).alias("rule"), F.col("subject").cast("string").alias("subject"), status.alias("status"), detail.cast("double").alias("detail")).where("status is not null")


def non_negative(world: World) -> DataFrame:
    """CONS-01: a mean of ``slots`` (model, var_id, mu, sigma) below 0 fails; one within two deviations of it warns."""
    s = world["slots"].withColumn("subject", F.col("var_id"))
    return _rows(s, "CONS-01", F.when(F.col("mu") < 0, "FAIL").when(F.col("mu") - 2 * F.col("sigma") < 0, "WARN"), F.col("mu"))


def at_most(world: World) -> DataFrame:
    """CONS-02: ``pairs`` (model, subject, gap: right less left, sigma: of the gap, what both share cancelled out)."""
    return _rows(world["pairs"], "CONS-02", F.when(F.col("gap") < 0, "FAIL").when(F.col("gap") < 2 * F.col("sigma"), "WARN"), F.col("gap"))


def restated(world: World) -> DataFrame:
    """CONS-03: ``restatements`` (model, subject, value, again), the same quantity by its definition and by another, equal
    to a billionth."""
    return _rows(world["restatements"], "CONS-03", F.when(F.abs(F.col("value") - F.col("again")) > 1e-9 * F.greatest(F.abs("value"), F.lit(1.0)), "FAIL"), F.col("value") - F.col("again"))


def rolled_up(world: World) -> DataFrame:
    """QTY-01: ``totals`` (model, total) against the sum of ``members`` (model, value) through the graph."""
    again = world["members"].groupBy("model").agg(F.sum("value").alias("again"))
    joined = world["totals"].join(again, "model", "left").withColumns({"subject": F.lit("total"), "again": F.coalesce("again", F.lit(0.0))})
    return _rows(joined, "QTY-01", F.when(F.abs(F.col("total") - F.col("again")) > 1e-9 * F.greatest(F.abs("total"), F.lit(1.0)), "FAIL"), F.col("total") - F.col("again"))


def symmetric(world: World) -> DataFrame:
    """GAUSS-01: ``cov`` (model, i, j, v) equals itself turned over, to a billionth of its largest entry."""
    far = asymmetry(world["cov"]).withColumn("subject", F.lit("covariance"))
    return _rows(far, "GAUSS-01", F.when(F.col("asymmetry") > 1e-9 * F.greatest("largest", F.lit(1.0)), "FAIL"), F.col("asymmetry"))


def variances(world: World) -> DataFrame:
    """GAUSS-02, its part that needs no factors: no variance of ``cov`` below -1e-12."""
    return _rows(world["cov"].where("i = j").withColumn("subject", F.col("i")), "GAUSS-02", F.when(F.col("v") < -1e-12, "FAIL"), F.col("v"))


def both_ends(world: World) -> DataFrame:
    """STRUCT-01: both ends of each of ``rel`` (model, kind, source, target) are among the ``nodes`` (model, node) of its
    model."""
    from belvane.sources.tables import materialise

    rel = world["rel"]
    ends = rel.select("model", F.explode(F.array("source", "target")).alias("node")).distinct()
    gone = materialise(ends.join(world["nodes"].select("model", "node").distinct(), ["model", "node"], "left_anti"))  # a few, so edges are met by what lacks alone
    met = lambda end: F.col("r.model").eqNullSafe(F.col("g.model")) & F.col(f"r.{end}").eqNullSafe(F.col("g.node"))
    found = [rel.alias("r").join(gone.alias("g"), met(end)).select("r.*").withColumn("subject", F.concat_ws(" ", "kind", "source", "target")) for end in ("source", "target")]
    return _rows(found[0].unionByName(found[1]), "STRUCT-01", F.lit("FAIL"), F.lit(None))


def acyclic(world: World) -> DataFrame:
    """STRUCT-02: nodes of ``rel`` that lie on a cycle of spatial edges of their model or behind one; no cycle, no row."""
    from belvane.operators.dag import on_cycles

    spatial = world["rel"].where(F.col("kind").isin("aggregates", "contains"))
    end = lambda c: F.struct("model", F.col(c).alias("node"))
    found = on_cycles(spatial.select(end("source").alias("parent"), end("target").alias("child"))).select("node.model", "node.node")
    return _rows(found.withColumn("subject", F.col("node")), "STRUCT-02", F.lit("FAIL"), F.lit(None))


def exactly_one(world: World) -> DataFrame:
    """STRUCT-03: each of ``single`` (model, node, kind), such as an opening that voids a wall, is the source of exactly one
    edge of ``rel`` of that kind; ``detail`` is how many it has."""
    n = world["rel"].groupBy("model", F.col("source").alias("node"), "kind").agg(F.count(F.lit(1)).alias("n"))
    found = world["single"].join(n, ["model", "node", "kind"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "subject": F.concat_ws(" ", "kind", "node")})
    return _rows(found, "STRUCT-03", F.when(F.col("n") != 1, "FAIL"), F.col("n"))


def factors(world: World) -> DataFrame:
    """GAUSS-02: each model's ``cov`` has a Cholesky factor, with a small jitter at most; a jitter that it took warns. A
    model's covariance must fit a task."""
    from belvane.operators.belief import positive

    found = positive(world["cov"], "model").withColumn("subject", F.lit("covariance"))
    return _rows(found, "GAUSS-02", F.when(~F.col("positive"), "FAIL").when(F.col("jitter") > 0, "WARN"), F.col("jitter"))


def reevaluated(world: World) -> DataFrame:
    """GAUSS-03: ``derived`` (model, subject, value, again), the stored mean of a derived quantity and its definition at the
    raw means, equal to a billionth; the worst of each model only."""
    gap = F.abs(F.col("value") - F.col("again")) / F.greatest(F.abs("value"), F.lit(1.0))
    worst = world["derived"].groupBy("model").agg(F.max_by(F.struct("subject", gap.alias("gap")), F.struct(gap, F.col("subject"))).alias("w")).select("model", "w.*")
    return _rows(worst, "GAUSS-03", F.when(F.col("gap") > 1e-9, "FAIL"), F.col("gap"))


#: Each invariant with the tables that it reads; one whose tables a world lacks is not run.
REGISTRY: list[tuple[Invariant, tuple[str, ...]]] = [
    (both_ends, ("rel", "nodes")), (acyclic, ("rel",)), (exactly_one, ("rel", "single")), (symmetric, ("cov",)), (variances, ("cov",)), (factors, ("cov",)), (reevaluated, ("derived",)), (non_negative, ("slots",)), (at_most, ("pairs",)), (restated, ("restatements",)), (rolled_up, ("totals", "members")),
]


def findings(world: World, registry: list[tuple[Invariant, tuple[str, ...]]] | None = None) -> DataFrame:
    """The rows of all invariants whose tables are there."""
    run = [f(world) for f, needs in (registry or REGISTRY) if all(n in world for n in needs)]
    if not run:
        raise ValueError("no invariant has the tables that it reads")
    return reduce(DataFrame.unionByName, run)


def report(found: DataFrame, models: DataFrame) -> DataFrame:
    """model, failed, warned, passed (a flag: nothing failed) of ``models`` (model) by their :func:`findings`. A finding
    about a model that ``models`` lacks, a null one among them, is a row of its own, so that none is lost."""
    n = found.groupBy("model").agg(F.count(F.when(F.col("status") == "FAIL", 1)).alias("failed"), F.count(F.when(F.col("status") == "WARN", 1)).alias("warned"))
    joined = models.alias("m").join(n.alias("n"), F.col("m.model").eqNullSafe(F.col("n.model")), "full")
    return joined.select(F.coalesce("m.model", "n.model").alias("model"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("warned", F.lit(0)).alias("warned"), (F.coalesce("failed", F.lit(0)) == 0).alias("passed"))


def asymmetry(cov: DataFrame) -> DataFrame:
    """model, asymmetry, largest: how far ``cov`` (model, i, j, v) is from its transpose, a missing entry being 0."""
    turned = cov.select("model", F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("w"))
    both = cov.join(turned, ["model", "i", "j"], "full")
    gap = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))
    return both.groupBy("model").agg(F.max(gap).alias("asymmetry"), F.max(F.abs(F.coalesce("v", "w"))).alias("largest"))


def symmetrised(cov: DataFrame) -> DataFrame:
    """The mean of ``cov`` and its transpose, entries that are missing on one side halved."""
    turned = cov.select("model", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return cov.unionByName(turned).groupBy("model", "i", "j").agg((F.sum("v") / 2).alias("v"))


def deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, before, after, delta of means (keys, mu) that differ; a missing side is null."""
    b, a = before.select(*keys, F.col("mu").alias("before")), after.select(*keys, F.col("mu").alias("after"))
    return b.join(a, keys, "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("delta", F.col("after") - F.col("before"))


def strays(moved: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """What moved (:func:`deltas`) though it is neither a target of the change nor rests on one (``allowed``, keys)."""
    return moved.join(allowed.select(*keys).distinct(), keys, "left_anti")


def committed(before: DataFrame, candidate: DataFrame, found: DataFrame, stray: DataFrame | None = None) -> DataFrame:
    """The rows of ``candidate`` (model, ...) for models in which nothing failed and nothing strayed, those of ``before``
    for the others, with ``committed``. All of a model goes or stays."""
    bad = found.where("status = 'FAIL'").select("model")
    bad = (bad if stray is None else bad.unionByName(stray.select("model"))).distinct()
    kept = candidate.join(bad, "model", "left_anti").withColumn("committed", F.lit(True))
    return kept.unionByName(before.join(bad, "model", "left_semi").withColumn("committed", F.lit(False)))


def composite(before: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``before`` (keys, mu, ...) after all of ``steps`` (keys, seq, op, value) in order, as one change: what lies between
    two steps is never verified, so judge the result by :func:`findings` and :func:`committed`. A row without steps stays
    as it is; a step without a row is left out."""
    from belvane.operators.ledger import composed

    done = composed(steps, keys).withColumnsRenamed({"a": "__a", "b": "__b"})
    moved = F.coalesce(F.col("__a") * F.col("mu") + F.col("__b"), F.col("mu"))
    return before.join(done, keys, "left").withColumn("mu", moved).select(*before.columns)


def composite_rows(before: DataFrame, steps: str) -> DataFrame:
    """:func:`composite` for rows of ``before`` (mu, ...) that bring their few steps along, in the array column ``steps`` of
    (seq, op, value): a row's change is worked out in it, and no step is dealt. A value that comes out as null leaves the
    row as it was."""
    put = lambda mu, s: F.when(s["op"] == "set", s["value"]).when(s["op"] == "shift", mu + s["value"]).when(s["op"] == "scale", mu * s["value"]).otherwise(mu)
    mu = F.col("mu").cast("double")
    return before.withColumn("mu", F.coalesce(F.aggregate(F.array_sort(steps), mu, put), mu)).drop(steps)
