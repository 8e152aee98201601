"""Gaussian beliefs as tables: means (model, var_id, mu) and covariances in coordinate form (model, i, j, v)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belvane.sources.tables import growing


def push_forward(jacobian: DataFrame, cov: DataFrame) -> DataFrame:
    """model, i, j, v: J S J' by two joins and two sums. Only entries that aren't zero are stored or made."""
    half = jacobian.alias("a").join(cov.alias("s"), (F.col("a.model") == F.col("s.model")) & (F.col("a.var_id") == F.col("s.i")))
    half = half.groupBy(F.col("a.model").alias("model"), F.col("a.out_var").alias("i"), F.col("s.j").alias("k")).agg(F.sum(F.col("a.v") * F.col("s.v")).alias("v"))
    full = half.alias("h").join(jacobian.alias("b"), (F.col("h.model") == F.col("b.model")) & (F.col("h.k") == F.col("b.var_id")))
    return full.groupBy(F.col("h.model").alias("model"), F.col("h.i").alias("i"), F.col("b.out_var").alias("j")).agg(F.sum(F.col("h.v") * F.col("b.v")).alias("v"))


def variance_of(jacobian: DataFrame, sigma: DataFrame) -> DataFrame:
    """model, out_var, var: the variance of each output for independent raw variables; the diagonal of J S J' alone."""
    return jacobian.join(sigma, ["model", "var_id"]).groupBy("model", "out_var").agg(F.sum(F.pow(F.col("v") * F.col("sigma"), F.lit(2))).alias("var"))


def set_parameter(env: DataFrame, changes: DataFrame) -> DataFrame:
    """``env`` (model, var_id, mu, sigma) with the variables in ``changes`` (model, var_id, value, design_sigma) set."""
    return env.join(changes, ["model", "var_id"], "left").select("model", "var_id", F.coalesce("value", "mu").alias("mu"), F.coalesce("design_sigma", "sigma").alias("sigma"))


def shift_parameter(env: DataFrame, changes: DataFrame) -> DataFrame:
    """Means moved by ``delta``; the covariance stays."""
    return env.join(changes, ["model", "var_id"], "left").select("model", "var_id", (F.col("mu") + F.coalesce("delta", F.lit(0.0))).alias("mu"), "sigma")


def scale_parameter(env: DataFrame, changes: DataFrame) -> DataFrame:
    """Means and standard deviations times ``factor``. A factor of 0 or null is refused: its variable stays as it is, and
    :func:`refused_factors` tells of it."""
    f = F.coalesce(F.when(F.col("factor") != 0, F.col("factor")), F.lit(1.0))
    return env.join(changes, ["model", "var_id"], "left").select("model", "var_id", (F.col("mu") * f).alias("mu"), (F.col("sigma") * F.abs(f)).alias("sigma"))


def refused_factors(changes: DataFrame) -> DataFrame:
    """``changes`` (model, var_id, factor) that :func:`scale_parameter` refuses, with the reason."""
    bad = F.col("factor").isNull() | (F.col("factor") == 0) | F.isnan("factor") | (F.abs("factor") == float("inf"))
    return changes.where(bad).withColumn("reason", F.when(F.col("factor") == 0, "FACTOR_IS_ZERO").otherwise("FACTOR_IS_NOT_FINITE"))


def posterior(observations: DataFrame, key: str, prior_mu: float, prior_var: float) -> DataFrame:
    """``key``, n, mu, var: a scalar after any number of noisy readings (y, r: the noise variance), by sums of precisions.

    Readings whose variance isn't positive can't be summed this way and are counted in ``rejected``.
    """
    good = F.col("r") > 0
    sums = observations.groupBy(key).agg(
        F.count(F.when(good, 1)).alias("n"), F.count(F.when(~good | F.col("r").isNull(), 1)).alias("rejected"),
        F.coalesce(F.sum(F.when(good, 1 / F.col("r"))), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.when(good, F.col("y") / F.col("r"))), F.lit(0.0)).alias("wy"),
    )
    precision = F.col("w") + 1 / prior_var
    return sums.select(key, "n", "rejected", ((F.col("wy") + prior_mu / prior_var) / precision).alias("mu"), (1 / precision).alias("var"))


#: A stretch of readings as one map of beliefs: from a belief before them (mean m, variance P) to the one after, which has
#: mean ``a`` (m + P ``eta``) / (1 + P ``info``) + ``b`` and variance ``a``^2 P / (1 + P ``info``) + ``c``. Such maps compose.
_MAP = ("a", "b", "c", "eta", "info")


def _after(first: tuple[float, ...], then: tuple[float, ...]) -> tuple[float, ...]:
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, then
    t = 1 / (1 + c1 * j2)
    return a2 * t * a1, a2 * t * (b1 + c1 * e2) + b2, a2 * t * c1 * a2 + c2, a1 * t * (e2 - j2 * b1) + e1, a1 * t * j2 * a1 + j1


def _reading(y: float, r: float, a: float, b: float, q: float) -> tuple[float, ...]:
    """One step x' = a x + b with noise q and a reading of it."""
    s = q + r
    if s == 0:  # an exact reading of a sure step: nothing before it matters
        return 0.0, y, 0.0, 0.0, 0.0
    return a * r / s, b + q * (y - b) / s, q * r / s, a * (y - b) / s, a * a / s


def _stretches(batches: Iterator[pa.RecordBatch], key: str, q: float, a: float, b: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and place; a row for each key of a task, with the map of its readings there. A null reading
    makes the mean unknown, a null variance both."""
    kind, began, now, n, no_mu, no_var, f = None, False, None, 0, False, False, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.bool_(), pa.bool_(), *[pa.float64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [key, "n", "no_mu", "no_var", *_MAP])

    for rows in batches:
        kind, out = rows.schema.field(key).type, []
        for k, y, r in zip(*[rows.column(c).to_pylist() for c in (key, "__y", "__r")], strict=True):
            if not began or k != now:
                if began:
                    out.append((now, n, no_mu, no_var, *f))
                began, now, n, no_mu, no_var, f = True, k, 0, False, False, (1.0, 0.0, 0.0, 0.0, 0.0)
            no_mu, no_var, n = no_mu or y is None, no_var or r is None, n + 1
            if not no_var:
                f = _after(f, _reading(0.0 if y is None else y, r, a, b, q))
        yield told(out)
    if began:
        yield told([(now, n, no_mu, no_var, *f)])


def predict_update(readings: DataFrame, key: str, order: list[str], *, mu0: float, var0: float, q: float, a: float = 1.0, b: float = 0.0) -> DataFrame:
    """``key``, n, mu, var: a scalar process x' = a x + b with noise variance ``q``, corrected by each reading (y, r) in
    order. From a null y on the mean is null, from a null r on the variance too.

    The steps compose, so the readings are cut into ranges of key and order, whatever a key's share of them; each range gives
    one map for each of its keys, and a key's maps, one a range at most, are applied in turn."""
    rows = readings.select(key, *order, F.col("y").cast("double").alias("__y"), F.col("r").cast("double").alias("__r"))
    places = [key, *order, "__y", "__r"]
    dealt = rows.repartitionByRange(*places).sortWithinPartitions(*places).select(key, "__y", "__r")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, no_mu boolean, no_var boolean, " + ", ".join(f"{c} double" for c in _MAP)
    maps = dealt.mapInArrow(partial(_stretches, key=key, q=q, a=a, b=b), schema).withColumn("part", F.spark_partition_id())
    turn = F.array_sort(F.collect_list(F.struct("part", *_MAP)))

    def apply(s: Column, f: Column) -> Column:
        t = 1 + s["var"] * f["info"]
        return F.struct((f["a"] * (s["mu"] + s["var"] * f["eta"]) / t + f["b"]).alias("mu"), (f["a"] * f["a"] * s["var"] / t + f["c"]).alias("var"))

    start = F.struct(F.lit(float(mu0)).alias("mu"), F.lit(float(var0)).alias("var"))
    found = maps.groupBy(key).agg(F.sum("n").alias("n"), F.bool_or("no_mu").alias("no_mu"), F.bool_or("no_var").alias("no_var"), turn.alias("maps"))
    found = found.withColumn("__s", F.aggregate("maps", start, apply))
    return found.select(key, "n", F.when(~F.col("no_mu") & ~F.col("no_var"), F.col("__s.mu")).alias("mu"), F.when(~F.col("no_var"), F.col("__s.var")).alias("var"))


def forecast(state: DataFrame, steps: int, *, a: float, b: float, q: float) -> DataFrame:
    """``state`` (key, mu, var) and its forecasts for steps 1 to ``steps``; the state itself isn't changed."""
    def ahead(s: Column, _: Column) -> Column:
        last = F.element_at(s, -1)
        return F.concat(s, F.array(F.struct((last["step"] + 1).alias("step"), (a * last["mu"] + b).alias("mu"), (a * a * last["var"] + q).alias("var"))))

    zero = F.array(F.struct(F.lit(0).alias("step"), F.col("mu").cast("double").alias("mu"), F.col("var").cast("double").alias("var")))
    return state.select("key", F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, ahead)))


def conditioned_by_joint(cov: DataFrame, observed: DataFrame) -> DataFrame:
    """One joint update by model: ``cov`` (model, i, j, v; both triangles), ``observed`` (model, var_id, innovation, r).

    Returns model, var_id, shift, var. The solve is dense over a model's variables, so a model must fit a task; models
    are spread over the cluster. The Joseph form keeps the covariance positive.
    """
    import numpy as np
    import pandas as pd

    def solve(key: tuple, s: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(s["i"]) | set(s["j"]))
        at = {x: k for k, x in enumerate(names)}
        c = np.zeros((len(names), len(names)))
        c[s["i"].map(at), s["j"].map(at)] = s["v"]
        o = o[o["var_id"].isin(names)]
        h = np.zeros((len(o), len(names)))
        h[np.arange(len(o)), o["var_id"].map(at).astype(int)] = 1
        r = np.diag(o["r"].to_numpy(float))
        if len(o):
            gain = np.linalg.solve(h @ c @ h.T + r, h @ c).T
            keep = np.eye(len(names)) - gain @ h
            shift, c = gain @ o["innovation"].to_numpy(float), keep @ c @ keep.T + gain @ r @ gain.T
        else:
            shift = np.zeros(len(names))
        return pd.DataFrame({"model": [key[0]] * len(names), "var_id": names, "shift": shift, "var": np.diag(c)})

    return cov.groupBy("model").cogroup(observed.groupBy("model")).applyInPandas(solve, "model long, var_id string, shift double, var double")


def strongest(cov: DataFrame, least: float = 0.2, most: int = 200) -> DataFrame:
    """The strongest correlations of each model: |corr| >= ``least``, ``most`` of them at most (a report)."""
    d = cov.where("i = j").select("model", F.col("i").alias("x"), F.col("v").alias("d"))
    c = cov.where("i < j").join(d.withColumnsRenamed({"x": "i", "d": "di"}), ["model", "i"]).join(d.withColumnsRenamed({"x": "j", "d": "dj"}), ["model", "j"])
    root = F.sqrt(F.col("di") * F.col("dj"))
    c = c.withColumn("corr", F.when(root < 1e-150, 0.0).otherwise(F.col("v") / root)).where(F.abs("corr") >= least)
    return c.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.abs("corr")), "i", "j"))).where(F.col("place") <= most).select("model", "i", "j", "corr", "place")


def observation_plan(jacobian: DataFrame, sigma: DataFrame, noise: float, cost: float = 0.0) -> DataFrame:
    """model, out_var, var_id, gain, place: what one reading of each raw variable would tell about an output, best first.

    The variables are independent; ``noise`` is a reading's standard deviation as a share of the variable's. ``gain`` is
    half the log of the output's variance before over after, less ``cost``; ties go by var_id. A place of 1 is the choice.
    """
    each = Window.partitionBy("model", "out_var")
    part = jacobian.join(sigma, ["model", "var_id"]).withColumn("part", F.pow(F.col("v") * F.col("sigma"), F.lit(2)))
    left = 1 - F.col("part") / (F.sum("part").over(each) * (1 + noise * noise))
    gained = part.select("model", "out_var", "var_id", (-0.5 * F.log(left) - cost).alias("gain"))
    return gained.withColumn("place", F.row_number().over(each.orderBy(F.desc("gain"), "var_id")))


def best_reading(rows: DataFrame, parts: dict[str, Column], names: dict[str, Column], noise: float, cost: float = 0.0) -> DataFrame:
    """model, entity, var_id, gain: the one raw variable of each row whose reading would tell most about its output, ties by
    var_id. ``parts`` has each raw variable's part of the output's variance, ``names`` its var_id. See
    :func:`observation_plan`, of which this is the first place, within the row."""
    total = sum(parts.values(), F.lit(0.0))
    options = [F.struct((-(-0.5 * F.log(1 - p / (F.col("__total") * (1 + noise * noise))) - cost)).alias("loss"), names[r].alias("var_id")) for r, p in parts.items()]
    best = rows.withColumn("__total", total).withColumn("__best", F.array_min(F.array(*options)))
    return best.select("model", "entity", "__best.var_id", (-F.col("__best.loss")).alias("gain"))


def correlations(cov: DataFrame, by: list[str]) -> DataFrame:
    """``by``, i, j, cov, corr (0 where a deviation is below 1e-150) of ``cov`` (by, i, j, v), i < j."""
    d = cov.where("i = j")
    one = d.select(*by, F.col("i"), F.col("v").alias("__di"))
    two = d.select(*by, F.col("i").alias("j"), F.col("v").alias("__dj"))
    root = F.sqrt(F.col("__di")) * F.sqrt(F.col("__dj"))
    small = (F.sqrt("__di") < 1e-150) | (F.sqrt("__dj") < 1e-150)
    return cov.where("i < j").join(one, [*by, "i"]).join(two, [*by, "j"]).select(*by, "i", "j", F.col("v").alias("cov"), F.when(small, 0.0).otherwise(F.col("v") / root).alias("corr"))


def marginal(cov: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The entries of ``cov`` (by, i, j, v) of which both sides are among ``wanted`` (by, var_id)."""
    w = wanted.select(*by, "var_id").distinct()
    return cov.join(w.withColumnRenamed("var_id", "i"), [*by, "i"], "left_semi").join(w.withColumnRenamed("var_id", "j"), [*by, "j"], "left_semi")


def observation_rows(jacobian: DataFrame, raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """model, var_id, raw, h: the rows of H for ``wanted`` (model, var_id): the derivatives of a derived variable
    (``jacobian``: model, out_var, var_id, v), and a single 1 for a raw one (``raw``: model, var_id)."""
    w = wanted.select("model", "var_id").distinct()
    derived = jacobian.select("model", F.col("out_var").alias("var_id"), F.col("var_id").alias("raw"), F.col("v").alias("h"))
    same = raw.select("model", "var_id", F.col("var_id").alias("raw"), F.lit(1.0).alias("h"))
    return derived.unionByName(same).join(w, ["model", "var_id"], "left_semi")


def observed(evidence: DataFrame, slots: DataFrame, kinds: list[str]) -> DataFrame:
    """``evidence`` (model, var_id, unit, kind, y, r) with a reason, null where it may be used: the subject must be a raw
    variable of ``slots`` (model, var_id, unit), in its unit, of a known kind, and with a noise variance above 0."""
    joined = evidence.join(slots.select("model", "var_id", F.col("unit").alias("__unit")), ["model", "var_id"], "left")
    reason = F.when(F.col("__unit").isNull(), "NOT_RAW").when(F.col("unit") != F.col("__unit"), "UNIT").when(~F.col("kind").isin(kinds), "KIND").when(F.coalesce(F.col("r") <= 0, F.lit(True)), "NOISE")
    return joined.withColumn("reason", reason).drop("__unit")


def conditioned(cov: DataFrame, row: DataFrame, by: list[str]) -> DataFrame:
    """``by``, i, j, v: the covariance after one observation of each block: ``row`` (by, var_id, h, r; the noise variance is
    the same in a block's rows). S - S h' h S / (h S h' + r), by joins and sums; a block without a row stays."""
    h = row.select(*by, F.col("var_id").alias("j"), "h", "r")
    sh = cov.join(h, [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("h")).alias("g"), F.max("r").alias("r"))
    s = sh.join(row.select(*by, F.col("var_id").alias("i"), "h"), [*by, "i"]).groupBy(*by).agg((F.sum(F.col("g") * F.col("h")) + F.max("r")).alias("s"))
    left, right = sh.select(*by, "i", F.col("g").alias("gi")), sh.select(*by, F.col("i").alias("j"), F.col("g").alias("gj"))
    joined = cov.join(s, by, "left").join(left, [*by, "i"], "left").join(right, [*by, "j"], "left")
    less = F.coalesce(F.col("gi") * F.col("gj") / F.col("s"), F.lit(0.0))
    return joined.select(*by, "i", "j", (F.col("v") - less).alias("v"))


def evolved(cov: DataFrame, step: DataFrame, noise: DataFrame, by: list[str]) -> DataFrame:
    """``by``, i, j, v: F S F' + Q for ``step`` (by, i, k, f) and ``noise`` (by, i, j, v), in coordinate form; a variable that
    ``step`` has no row of stays as it is."""
    named = step.select(*by, "i").distinct()
    same = cov.select(*by, "i").distinct().join(named, [*by, "i"], "left_anti").select(*by, "i", F.col("i").alias("k"), F.lit(1.0).alias("f"))
    full = step.select(*by, "i", "k", "f").unionByName(same)
    half = full.join(cov.select(*by, F.col("i").alias("k"), F.col("j").alias("m"), "v"), [*by, "k"]).groupBy(*by, "i", "m").agg(F.sum(F.col("f") * F.col("v")).alias("v"))
    whole = half.join(full.select(*by, F.col("i").alias("j"), F.col("k").alias("m"), "f"), [*by, "m"]).select(*by, "i", "j", (F.col("v") * F.col("f")).alias("v"))
    return whole.unionByName(noise.select(*by, "i", "j", "v")).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def energy(cov: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n, trace: the sum of the variances."""
    return cov.where("i = j").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("trace"))


def positive(cov: DataFrame, block: str) -> DataFrame:
    """``block``, n, jitter, positive: whether each block of ``cov`` (block, i, j, v) has a Cholesky factor, with the first
    of 0, 1e-12 and 1e-10 times the mean variance (1 at least) added to its diagonal that gives one; jitter is null if none
    does. A block must fit a task; blocks are spread over the cluster."""
    def factor(cells: list[tuple]) -> tuple[int, float | None]:
        import numpy as np

        names = sorted({i for i, _, _ in cells} | {j for _, j, _ in cells})
        at = {x: k for k, x in enumerate(names)}
        c = np.zeros((len(names), len(names)))
        c[[at[i] for i, _, _ in cells], [at[j] for _, j, _ in cells]] = [np.nan if v is None else v for _, _, v in cells]
        c, unit = (c + c.T) / 2, max(float(np.trace(c)) / len(names), 1.0)
        for jitter in (0.0, 1e-12 * unit, 1e-10 * unit):
            try:
                np.linalg.cholesky(c + jitter * np.eye(len(names)))
                return len(names), jitter
            except np.linalg.LinAlgError:
                continue
        return len(names), None

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, cells = None, None, []

        def told(done: list[tuple]) -> pa.RecordBatch:
            keys, ns, jitters = [k for k, _, _ in done], [n for _, n, _ in done], [x for _, _, x in done]
            return pa.record_batch([pa.array(keys, kind), pa.array(ns, pa.int64()), pa.array(jitters, pa.float64()), pa.array([x is not None for x in jitters], pa.bool_())], names=[block, "n", "jitter", "positive"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for key, *cell in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cells and key != last:
                    done.append((last, *factor(cells)))
                    cells = []
                last = key
                cells.append(tuple(cell))
            yield told(done)
        if cells:
            yield told([(last, *factor(cells))])

    schema = T.StructType([cov.schema[block], T.StructField("n", T.LongType()), T.StructField("jitter", T.DoubleType()), T.StructField("positive", T.BooleanType())])
    # a task's blocks come one after the other; a call for each block would take longer than small blocks do
    return cov.select(block, "i", "j", "v").repartition(block).sortWithinPartitions(block).mapInArrow(factors, schema)


def belief_digest(env: DataFrame) -> DataFrame:
    """model, n, digest of a belief's means and deviations (model, var_id, mu, sigma), in whole millionths."""
    from belvane.functions.scalars import quantised
    from belvane.operators.lowering import module_digest

    return module_digest(env.select("model", F.concat_ws("|", "var_id", quantised(F.col("mu")).cast("string"), quantised(F.col("sigma")).cast("string")).alias("line")))


def difference(pairs: DataFrame, least: float, confidence: float) -> DataFrame:
    """``pairs`` (..., lhs, rhs, var_lhs, var_rhs, cov) with p, the chance that lhs - rhs is at least ``least``, and a
    verdict; a difference without variance is sure."""
    from belvane.functions import scalars

    var = F.col("var_lhs") + F.col("var_rhs") - 2 * F.col("cov")
    gap = F.col("lhs") - F.col("rhs") - least
    p = F.when(var > 1e-30, scalars.normal_cdf(gap / F.sqrt(var))).otherwise(F.when(gap >= 0, 1.0).otherwise(0.0))
    return pairs.withColumn("p", F.round(p, 9)).withColumn("verdict", scalars.verdict(F.col("p"), confidence))


def pair_covariances(jacobian: DataFrame, cov: DataFrame, pairs: DataFrame) -> DataFrame:
    """model, a, b, var_a, var_b, cov of the ``pairs`` (model, a, b) of derived variables, of any entities: the entries of
    J S J' that are asked for. ``jacobian`` is (model, out_var, var_id, v), ``cov`` (model, i, j, v; both triangles).

    J S is made once for each variable that a pair names; then only what a pair's two rows have in common is multiplied, so
    pairs that share nothing cost nothing but their row. A raw variable that all share is no hot key, as rows meet by
    pair."""
    p = pairs.select("model", "a", "b").distinct()
    named = p.select("model", F.col("a").alias("out_var")).unionByName(p.select("model", F.col("b").alias("out_var"))).distinct()
    j = jacobian.join(growing(named), ["model", "out_var"], "left_semi").groupBy("model", "out_var", "var_id").agg(F.sum("v").alias("v"))
    half = j.join(growing(cov.select("model", F.col("i").alias("var_id"), "j", F.col("v").alias("s"))), ["model", "var_id"]).groupBy("model", "out_var", "j").agg(F.sum(F.col("v") * F.col("s")).alias("h"))
    own = half.join(growing(j.select("model", "out_var", F.col("var_id").alias("j"), "v")), ["model", "out_var", "j"]).groupBy("model", "out_var").agg(F.sum(F.col("h") * F.col("v")).alias("var"))
    left = p.join(growing(half.select("model", F.col("out_var").alias("a"), "j", "h")), ["model", "a"])
    both = left.join(growing(j.select("model", F.col("out_var").alias("b"), F.col("var_id").alias("j"), "v")), ["model", "b", "j"]).groupBy("model", "a", "b").agg(F.sum(F.col("h") * F.col("v")).alias("cov"))
    found = p.join(growing(both), ["model", "a", "b"], "left")
    for end in ("a", "b"):
        found = found.join(growing(own.select("model", F.col("out_var").alias(end), F.col("var").alias(f"var_{end}"))), ["model", end], "left")
    return found.select("model", "a", "b", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("var_a", "var_b", "cov")])


def relative_covariances(jacobian: DataFrame, cov: DataFrame, pairs: DataFrame) -> DataFrame:
    """model, a, b, p, q, v: the covariance of the difference of two entities in each pair of components, (Ja - Jb) S
    (Ja - Jb)', for ``pairs`` (model, a, b) and ``jacobian`` (model, entity, component, var_id, v), such as those of centres
    by x, y and z. What both share cancels before it is squared; components without any variance have no row."""
    side = lambda end, sign: pairs.select("model", "a", "b").join(growing(jacobian.withColumnRenamed("entity", end)), ["model", end]).select("model", "a", "b", "component", "var_id", (sign * F.col("v")).alias("v"))
    d = side("a", 1).unionByName(side("b", -1)).groupBy("model", "a", "b", "component", "var_id").agg(F.sum("v").alias("v")).where("v <> 0")
    half = d.join(growing(cov.select("model", F.col("i").alias("var_id"), "j", F.col("v").alias("s"))), ["model", "var_id"]).groupBy("model", "a", "b", "component", "j").agg(F.sum(F.col("v") * F.col("s")).alias("h"))
    right = d.select("model", "a", "b", F.col("component").alias("q"), F.col("var_id").alias("j"), "v")
    return half.join(growing(right), ["model", "a", "b", "j"]).groupBy("model", "a", "b", F.col("component").alias("p"), "q").agg(F.sum(F.col("h") * F.col("v")).alias("v"))


def conditioned_jointly(cov: DataFrame, rows: DataFrame, readings: DataFrame, *, tol: float = 1e-10, rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """The shift of every variable's mean by any number of joint observations, of models of any size: S H' (H S H' + R)^-1 e.

    ``cov`` is (model, i, j, v; both triangles), ``rows`` the observations' rows (model, obs, var_id, h), ``readings`` (model,
    obs, innovation, r; r is a noise variance, 0 for an exact reading). Returns model, var_id, shift for the variables that
    move, and model, rounds, residual, status.

    Conjugate gradients: the matrix of the observations is made once, as entries; a product with a vector is a join and a
    sum, and all models step together, each until its residual is below ``tol`` of the beginning's. A model whose matrix
    isn't positive, as where an exact reading is repeated, is REDUNDANT, one with a negative or missing r INVALID, one that
    has not settled after ``rounds`` rounds OPEN; these shift nothing.
    """
    from belvane.sources.tables import materialise

    bad = readings.groupBy("model").agg(F.bool_or(F.coalesce(F.col("r") < 0, F.lit(True)) | F.col("innovation").isNull() | F.isnan("r") | F.isnan("innovation")).alias("bad"))
    h = materialise(rows.groupBy("model", "obs", "var_id").agg(F.sum("h").alias("h")))
    hs = materialise(h.join(cov.select("model", F.col("i").alias("var_id"), "j", "v"), ["model", "var_id"]).groupBy("model", "obs", "j").agg(F.sum(F.col("h") * F.col("v")).alias("g")))
    made = hs.join(h.select("model", F.col("obs").alias("other"), F.col("var_id").alias("j"), "h"), ["model", "j"]).select("model", "obs", "other", (F.col("g") * F.col("h")).alias("v"))
    noise = readings.where("r <> 0").select("model", "obs", F.col("obs").alias("other"), F.col("r").alias("v"))
    matrix = materialise(made.unionByName(noise).groupBy("model", "obs", "other").agg(F.sum("v").alias("v")))
    zero, keys = F.lit(0.0), ["model", "probe"]
    good = readings.join(bad.where("not bad"), "model", "left_semi").select("model", "obs", F.col("innovation").cast("double").alias("e"), "r")
    # where readings are exact, a second right side by chance: dependent readings may agree on the first, not on this
    exact = good.where("r = 0").select("model").distinct()
    chance = good.join(exact, "model", "left_semi").select("model", "obs", (F.pmod(F.xxhash64(F.col("obs").cast("string")), F.lit(1 << 20)) / float(1 << 19) - 1).alias("e"), F.lit(True).alias("probe"))
    sides = good.select("model", "obs", "e", F.lit(False).alias("probe")).unionByName(chance)
    vec = materialise(sides.select(*keys, "obs", zero.alias("x"), "e", F.col("e").alias("p")))
    # the largest diagonal entry, against which a pivot counts as nothing
    scale = matrix.where("obs = other").groupBy("model").agg(F.max("v").alias("largest"))
    begun = vec.groupBy(*keys).agg(F.sum(F.col("e") * F.col("e")).alias("ee")).join(scale, "model", "left")
    state = materialise(begun.select(*keys, "ee", F.col("ee").alias("ee0"), F.coalesce("largest", zero).alias("largest"), F.lit(0).alias("rounds"), F.when(F.col("ee") == 0, "SOLVED").alias("status")))
    for k in range(1, rounds + 1):
        live = state.where("status is null")
        if live.isEmpty():
            break
        going = vec.join(live.select(*keys), keys, "left_semi")
        product = matrix.join(going.select(*keys, F.col("obs").alias("other"), F.col("p").alias("w")), ["model", "other"]).groupBy(*keys, "obs").agg(F.sum(F.col("v") * F.col("w")).alias("ap"))
        step = materialise(going.join(product, [*keys, "obs"], "left").withColumn("ap", F.coalesce("ap", zero)))
        sums = step.groupBy(*keys).agg(F.sum(F.col("p") * F.col("ap")).alias("pap"), F.sum(F.col("p") * F.col("p")).alias("pp"))
        sized = live.join(sums, keys).withColumn("flat", F.col("pap") <= 1e-11 * F.col("largest") * F.col("pp"))
        alpha = F.when(F.col("flat"), zero).otherwise(F.col("ee") / F.col("pap"))
        # a row or two for each model, joined to its observations
        moved = materialise(step.join(sized.select(*keys, alpha.alias("alpha")), keys).select(*keys, "obs", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), (F.col("e") - F.col("alpha") * F.col("ap")).alias("e"), "p"))
        told = sized.join(moved.groupBy(*keys).agg(F.sum(F.col("e") * F.col("e")).alias("now")), keys)
        status = F.when(F.col("flat"), "REDUNDANT").when(F.col("now") <= tol * tol * F.col("ee0"), "SOLVED")
        told = materialise(told.select(*keys, F.col("now").alias("ee"), (F.col("now") / F.col("ee")).alias("beta"), "ee0", "largest", F.lit(k).alias("rounds"), status.alias("status")))
        new = moved.join(told.select(*keys, "beta"), keys).select(*keys, "obs", "x", "e", (F.col("e") + F.col("beta") * F.col("p")).alias("p"))
        vec = materialise(new.unionByName(vec.join(live.select(*keys), keys, "left_anti")))
        state = materialise(told.drop("beta").unionByName(state.where("status is not null")))
    part = F.when(F.col("ee0") > 0, F.sqrt(F.col("ee") / F.col("ee0"))).otherwise(zero)
    worst = F.max(F.when(F.col("status") == "REDUNDANT", 2).when(F.col("status").isNull(), 1).otherwise(0))
    told = state.groupBy("model").agg(F.max(F.when(~F.col("probe"), F.col("rounds"))).alias("rounds"), F.max(F.when(~F.col("probe"), part)).alias("residual"), worst.alias("worst"))
    told = materialise(told.select("model", "rounds", "residual", F.when(F.col("worst") == 2, "REDUNDANT").when(F.col("worst") == 1, "OPEN").otherwise("SOLVED").alias("status")))
    solved = vec.where("not probe").join(told.where("status = 'SOLVED'").select("model"), "model", "left_semi").select("model", "obs", "x")
    shift = hs.join(solved, ["model", "obs"]).groupBy("model", F.col("j").alias("var_id")).agg(F.sum(F.col("g") * F.col("x")).alias("shift"))
    return shift, told.unionByName(bad.where("bad").select("model", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("residual"), F.lit("INVALID").alias("status")))
