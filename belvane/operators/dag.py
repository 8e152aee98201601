"""Derived quantities: definitions as sums of monomials, their values, derivatives and order.

``terms``: model, out_var, term_id, coef, factors array<struct<var_id, pow>>. ``env``: model, var_id, mu. A definition
that refers to a derived variable is evaluated a level at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _valued(terms: DataFrame, env: DataFrame) -> DataFrame:
    """Each term with its factors' values, as an array; a term whose variable is unknown is missing a factor."""
    wide = terms.select("model", "out_var", "term_id", "coef", F.size("factors").alias("n"), F.explode_outer("factors").alias("f"))
    joined = wide.select("*", "f.var_id", "f.pow").drop("f").join(env.select("model", "var_id", "mu"), ["model", "var_id"], "left")
    return joined


def _evaluate_level(terms: DataFrame, env: DataFrame) -> DataFrame:
    each = _valued(terms, env).withColumn("x", F.when(F.col("n") == 0, 1.0).otherwise(F.pow("mu", "pow")))
    per_term = each.groupBy("model", "out_var", "term_id", "coef").agg(F.product("x").alias("x"), F.bool_or((F.col("n") > 0) & F.col("mu").isNull()).alias("unknown"))
    value = F.when(~F.bool_or("unknown"), F.sum(F.col("coef") * F.col("x")))
    return per_term.groupBy("model", "out_var").agg(value.alias("mu"))


def _partials_level(terms: DataFrame, env: DataFrame) -> DataFrame:
    each = _valued(terms, env).where("n > 0")
    arrays = each.groupBy("model", "out_var", "term_id", "coef").agg(F.collect_list(F.struct("var_id", "pow", "mu")).alias("fs"))  # a term has a few factors

    def lowered(f, i):  # noqa: ANN001, ANN202
        others = F.aggregate(F.filter("fs", lambda g: g["var_id"] != f["var_id"]), F.lit(1.0), lambda a, g: a * F.pow(g["mu"], g["pow"]))
        return F.struct(f["var_id"].alias("var_id"), (F.col("coef") * f["pow"] * F.pow(f["mu"], f["pow"] - 1) * others).alias("v"))

    return arrays.select("model", "out_var", F.inline(F.transform("fs", lowered))).groupBy("model", "out_var", "var_id").agg(F.sum("v").alias("v"))


def _levels_of(terms: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """The terms of each level of definitions, and those of definitions on a cycle or behind one; None if none is nested."""
    from belvane.sources.tables import materialise

    uses = terms.select("model", "out_var", F.explode("factors.var_id").alias("var_id"))
    nested = materialise(uses.join(terms.select("model", F.col("out_var").alias("var_id")).distinct(), ["model", "var_id"], "left_semi").distinct())
    if nested.isEmpty():
        return [terms], None
    rank = materialise(levels(nested.select(F.struct("model", F.col("var_id").alias("out_var")).alias("parent"), F.struct("model", "out_var").alias("child"))).select("node.*", "level"))
    behind = nested.select("model", "out_var").distinct().withColumn("nested", F.lit(True))
    marked = terms.join(rank, ["model", "out_var"], "left").join(behind, ["model", "out_var"], "left")
    marked = materialise(marked.withColumn("level", F.coalesce("level", F.when(F.col("nested").isNull(), 0))).drop("nested"))
    deepest = rank.agg(F.max("level")).first()[0] or 0
    return [marked.where(F.col("level") == k).drop("level") for k in range(deepest + 1)], marked.where("level is null").drop("level")


def _values(terms: DataFrame, env: DataFrame) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame], DataFrame]:
    """What :func:`_levels_of` returns, the values of each level, and those of all variables that its levels know."""
    from belvane.sources.tables import materialise

    parts, cyclic = _levels_of(terms)
    if cyclic is None:
        return parts, None, [_evaluate_level(terms, env)], env
    known = env.select("model", "var_id", "mu").join(terms.select("model", F.col("out_var").alias("var_id")).distinct(), ["model", "var_id"], "left_anti")
    values = []
    for part in parts:
        values.append(materialise(_evaluate_level(part, known)))
        known = known.unionByName(values[-1].select("model", F.col("out_var").alias("var_id"), "mu"))
    return parts, cyclic, values, known


def evaluate(terms: DataFrame, env: DataFrame) -> DataFrame:
    """model, out_var, mu: each definition's value. Null if a variable is unknown, or the definition is on a cycle or behind
    one."""
    _, cyclic, values, _ = _values(terms, env)
    found = reduce(DataFrame.unionByName, values)
    return found if cyclic is None else found.unionByName(cyclic.select("model", "out_var", F.lit(None).cast("double").alias("mu")).distinct())


def partials(terms: DataFrame, env: DataFrame) -> DataFrame:
    """model, out_var, var_id, v: derivatives of each definition with respect to the raw variables, by the chain rule over
    the levels. Definitions on a cycle or behind one have none."""
    from belvane.sources.tables import materialise

    parts, cyclic, _, known = _values(terms, env)
    if cyclic is None:
        return _partials_level(terms, env)
    derived = terms.select("model", F.col("out_var").alias("var_id")).distinct().withColumn("derived", F.lit(True))
    found = None
    for part in parts:
        own = _partials_level(part, known)
        if found is not None:
            inner = found.select("model", F.col("out_var").alias("var_id"), F.col("var_id").alias("raw"), F.col("v").alias("w"))
            own = own.join(derived, ["model", "var_id"], "left").join(inner, ["model", "var_id"], "left").where("derived is null or raw is not null")
            own = own.groupBy("model", "out_var", F.coalesce("raw", "var_id").alias("var_id")).agg(F.sum(F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))
        own = materialise(own)
        found = own if found is None else found.unionByName(own)
    return found


def levels(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """node, level: the longest path to each node of ``edges`` (parent, child); nodes on a cycle or behind one are missing.

    Nodes without parents are level 0. Each round takes the nodes whose last parents the round before took, so a node is
    handled once whatever the number of its paths; it writes what it meets and no node that still waits. More than
    ``max_depth`` rounds are an error.
    """
    from belvane.sources.tables import materialise

    edges = materialise(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    parents = materialise(edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    fresh = materialise(edges.select(F.col("parent").alias("node")).distinct().join(parents, "node", "left_anti"))
    done, met = [fresh.select("node", F.lit(0).alias("level"))], []
    while not fresh.isEmpty():
        if len(done) > max_depth:
            raise RuntimeError(f"levels are deeper than {max_depth}")
        now = materialise(edges.join(fresh, edges.parent == fresh.node, "left_semi").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("met")))
        met.append(now)
        sums = reduce(DataFrame.unionByName, met).join(now.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("met").alias("met"))
        fresh = materialise(sums.join(parents, "node").where("met = n").select("node"))
        done.append(fresh.select("node", F.lit(len(done)).alias("level")))
        if len(met) == 32:  # keeps the plan short
            met = [materialise(reduce(DataFrame.unionByName, met).groupBy("node").agg(F.sum("met").alias("met")))]
        if len(done) % 64 == 0:
            first = materialise(reduce(DataFrame.unionByName, [x for x in done if x is not None]))
            done = [first, *[None] * (len(done) - 1)]
    return reduce(DataFrame.unionByName, [x for x in done if x is not None])


def on_cycles(edges: DataFrame, trims: int = 2) -> DataFrame:
    """node: the nodes of ``edges`` (parent, child) that lie on a cycle or behind one, those that :func:`levels` lacks.

    An edge to a node without children is on no cycle, so such edges go first, ``trims`` times: a hierarchy that is no deeper
    than that needs no levels. This is done on pairs of hashes; nodes of equal hash can only keep an edge too many. An edge
    goes or stays with all others to its child, so the levels of what stays are right. What is left without a level, and all
    behind it, is the result."""
    from belvane.sources.tables import materialise

    whole = edges.select("parent", "child").where("parent is not null and child is not null")
    none = whole.select(F.col("child").alias("node")).where("false")
    core = whole.select(F.xxhash64("parent").alias("p"), F.xxhash64("child").alias("c"))
    for _ in range(trims):
        core = materialise(core.join(core.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c"))
        if core.isEmpty():
            return none
    left = materialise(whole.withColumn("c", F.xxhash64("child")).join(core.select("c").distinct(), "c", "left_semi").drop("c"))
    ends = left.select(F.col("parent").alias("node")).unionByName(left.select(F.col("child").alias("node"))).distinct()
    stuck = materialise(ends.join(levels(left), "node", "left_anti"))
    return none if stuck.isEmpty() else stuck.unionByName(affected(whole, stuck))


def affected(edges: DataFrame, changed: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node: all that can be reached from ``changed`` (node) along ``edges`` (parent, child), without these themselves.

    Each round joins and writes the newly found nodes only; a cycle ends the search as it finds nothing new. More than
    ``rounds`` rounds are an error.
    """
    from belvane.sources.tables import materialise

    fresh = materialise(changed.select("node").distinct())
    seen = [fresh]
    for _ in range(rounds):
        reached = edges.join(fresh, edges.parent == fresh.node, "left_semi").select(F.col("child").alias("node")).distinct()
        fresh = materialise(reached.join(reduce(DataFrame.unionByName, seen), "node", "left_anti"))
        if fresh.isEmpty():
            break
        seen.append(fresh)
        if len(seen) == 32:  # keeps the plan short
            seen = [materialise(reduce(DataFrame.unionByName, seen))]
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    return reduce(DataFrame.unionByName, seen).join(changed.select("node"), "node", "left_anti")


def jacobian_of_sum(jacobian: DataFrame, members: DataFrame) -> DataFrame:
    """Derivatives of rollups: ``members`` (model, parent, out_var) sum the rows of ``jacobian`` (model, out_var, var_id, v)."""
    return jacobian.join(members, ["model", "out_var"]).groupBy("model", F.col("parent").alias("out_var"), "var_id").agg(F.sum("v").alias("v"))


def shares(jacobian: DataFrame, sigma: DataFrame) -> DataFrame:
    """model, out_var, var_id, sensitivity and share of the variance, for independent raw variables (model, var_id, sigma)."""
    part = jacobian.join(sigma, ["model", "var_id"]).withColumn("part", F.pow(F.col("v") * F.col("sigma"), F.lit(2)))
    return part.select("model", "out_var", "var_id", F.col("v").alias("sensitivity"), (F.col("part") / F.sum("part").over(Window.partitionBy("model", "out_var"))).alias("share"))


def free_variables(terms: DataFrame) -> DataFrame:
    """model, out_var, variables: those that each definition names, in order, each once."""
    return terms.select("model", "out_var", F.explode_outer("factors.var_id").alias("v")).groupBy("model", "out_var").agg(F.array_sort(F.collect_set("v")).alias("variables"))
