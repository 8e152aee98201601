"""Scalars against the standard library, and beliefs against the hand-worked cases."""

from __future__ import annotations

import math

import pytest

from belvane.functions import scalars
from belvane.operators import belief, dag, geometry


def test_normal_cdf(spark):
    xs = [k / 10 for k in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", scalars.normal_cdf(df.x).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-12)
    got = df.selectExpr("x", f"{scalars.normal_cdf_sql('x')} as p").collect()
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-12) for r in got)


def test_smooth_functions(spark):
    df = spark.createDataFrame([(800.0,), (0.0,), (-800.0,)], "x double")
    got = df.select(scalars.softplus(df.x).alias("s"), scalars.sigmoid(df.x).alias("g")).collect()
    assert [r["s"] for r in got] == [800.0, pytest.approx(math.log(2)), 0.0] and [r["g"] for r in got] == [1.0, 0.5, 0.0]


def test_joint_update(spark):
    cov = spark.createDataFrame([(1, "a", "a", 0.04), (1, "a", "b", 0.01), (1, "b", "a", 0.01), (1, "b", "b", 0.09)], "model long, i string, j string, v double")
    seen = spark.createDataFrame([(1, "a", 0.5, 0.01)], "model long, var_id string, innovation double, r double")
    got = {r["var_id"]: r for r in belief.conditioned_by_joint(cov, seen).collect()}
    assert got["a"]["shift"] == pytest.approx(0.4) and got["a"]["var"] == pytest.approx(0.008)
    assert got["b"]["shift"] == pytest.approx(0.1) and got["b"]["var"] == pytest.approx(0.09 - 0.01**2 / 0.05)


def test_push_forward_and_strongest(spark):
    j = spark.createDataFrame([(1, "s", "a", 1.0), (1, "s", "b", 1.0), (1, "t", "a", 2.0)], "model long, out_var string, var_id string, v double")
    cov = spark.createDataFrame([(1, "a", "a", 4.0), (1, "b", "b", 1.0)], "model long, i string, j string, v double")
    full = belief.push_forward(j, cov)
    assert {(r["i"], r["j"]): r["v"] for r in full.collect()} == {("s", "s"): 5.0, ("s", "t"): 8.0, ("t", "s"): 8.0, ("t", "t"): 16.0}
    assert belief.strongest(full).first()["corr"] == pytest.approx(8 / math.sqrt(80))


def test_levels_leave_out_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "parent string, child string")
    assert {r["node"]: r["level"] for r in dag.levels(e).collect()} == {"a": 0, "b": 1, "c": 2}


def test_rectangle(spark):
    p = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (0.2, 0.0), (0.2, 0.4), (0.0, 0.4)])], "id long, k int, x double, y double")
    r = geometry.polygon(p, "id", "k").first()
    assert (r["area"], r["cx"], r["cy"]) == (pytest.approx(0.08), pytest.approx(0.1), pytest.approx(0.2))
