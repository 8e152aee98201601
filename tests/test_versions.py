"""Snapshots, overlays and registration on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from belvane.operators import registration, rules
from belvane.sources import snapshots

STOREY = {"Area": [(1, ("H", "H"))], "Volume": [(1, ("Area", "H"))]}


def test_snapshots_find_what_differs(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("m"), (F.col("id") / 3).alias("v"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("t"))
    one = snapshots.write(rows, ["k"], f"{tmp_path}/one", depth=2)
    assert one == snapshots.write(rows.repartition(7), ["k"], f"{tmp_path}/same", depth=2) == snapshots.digest(spark, f"{tmp_path}/one")
    assert snapshots.changed_leaves(spark, f"{tmp_path}/one", f"{tmp_path}/same") == [] and snapshots.changes(spark, f"{tmp_path}/one", f"{tmp_path}/same", ["k"]).count() == 0
    other = rows.where("k <> 11").withColumn("v", F.when(F.col("k") == 42, None).otherwise(F.col("v"))).unionByName(rows.where("k = 3").withColumn("k", F.lit(1000).cast("long")))
    two = snapshots.write(other, ["k"], f"{tmp_path}/two", depth=2)
    assert two != one and {tuple(r) for r in snapshots.changes(spark, f"{tmp_path}/one", f"{tmp_path}/two", ["k"]).collect()} == {(11, "REMOVED"), (42, "CHANGED"), (1000, "ADDED")}
    assert len(snapshots.changed_leaves(spark, f"{tmp_path}/one", f"{tmp_path}/two")) <= 3
    assert sorted(map(repr, snapshots.read(spark, f"{tmp_path}/two").collect())) == sorted(map(repr, other.collect()))
    # a null and an empty text, and values that run into one another, are not alike
    texts = [spark.createDataFrame([(1, a, b)], "k long, a string, b string") for a, b in ((None, ""), ("", None), ("x|1", "y"), ("x", "1|y"))]
    assert len({snapshots.write(t, ["k"], f"{tmp_path}/t{n}", depth=1) for n, t in enumerate(texts)}) == 4


def test_snapshots_find_damage_and_refuse_gaps(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("m"), F.floor(F.col("id") / 2).alias("seq"), F.lit("x").alias("line"))
    top = f"{tmp_path}/one"
    snapshots.write(rows, ["m", "seq"], top, depth=2, log=("m", "seq"))
    assert snapshots.damaged(spark, top).count() == 0
    flipped = spark.read.parquet(f"{top}/rows").withColumn("line", F.when((F.col("m") == 1) & (F.col("seq") == 7), "y").otherwise(F.col("line")))
    flipped.write.partitionBy("folder").parquet(f"{tmp_path}/two/rows")
    for part in ("tree", "schema"):
        spark.read.parquet(f"{top}/{part}").write.parquet(f"{tmp_path}/two/{part}")
    assert {r["level"] for r in snapshots.damaged(spark, f"{tmp_path}/two").collect()} == {0, 1, 2} and snapshots.damaged(spark, f"{tmp_path}/two").count() == 3
    for bad in (rows.where("seq <> 5"), rows.where("seq > 0"), rows.unionByName(rows.limit(1)), rows.withColumn("seq", F.when(F.col("seq") == 3, 4).otherwise(F.col("seq")))):
        with pytest.raises(ValueError, match="not a sequence"):
            snapshots.write(bad, ["m", "seq"], f"{tmp_path}/bad", log=("m", "seq"))
    assert snapshots.write(rows.where("false"), ["m", "seq"], f"{tmp_path}/none") is None


def test_snapshots_shuffle_rows_once_and_meet_few(spark, tmp_path):
    """Rows were shuffled with their digests, stored with them, shuffled by them again, and all rows of a leaf that differs met."""
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") / 3).alias("v"), F.lit("part").alias("parts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = snapshots._kept(rows, ["k"], 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2  # one, named again where it is reused
    other = rows.where("k <> 11").withColumn("v", F.when(F.col("k") == 42, None).otherwise(F.col("v")))
    for name, version in (("one", rows), ("two", other)):
        snapshots.write(version, ["k"], f"{tmp_path}/{name}", depth=1)
    kept = spark.read.parquet(f"{tmp_path}/one/rows").where("folder >= 0")
    assert kept.count() == 4000 and "row_digest" not in kept.columns
    leaves = snapshots.changed_leaves(spark, f"{tmp_path}/one", f"{tmp_path}/two")
    parts = [p for r in snapshots._changed_parts(spark, f"{tmp_path}/one", f"{tmp_path}/two", leaves).collect() for p in r["__differs"]]
    assert 1 <= sum(parts) <= 2 and len(parts) >= 16 * len(leaves)
    found = snapshots.changes(spark, f"{tmp_path}/one", f"{tmp_path}/two", ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(11, "REMOVED"), (42, "CHANGED")]
    # a leaf that one version divides into more parts, repeated keys and null ones
    more = other.unionByName(rows.withColumn("k", F.col("k") + 4000)).unionByName(rows.where("k = 7"))
    none = spark.createDataFrame([(None, 1.0, "x")], "k long, v double, parts string")
    snapshots.write(more.unionByName(none), ["k"], f"{tmp_path}/more", depth=1)
    found = {r["k"]: r["change"] for r in snapshots.changes(spark, f"{tmp_path}/two", f"{tmp_path}/more", ["k"]).collect()}
    assert found == {7: "CHANGED", None: "ADDED"} | {k: "ADDED" for k in range(4000, 8000)}
    # a version without what its leaves tell, as written before
    spark.read.parquet(f"{tmp_path}/one/rows").where("folder >= 0").write.partitionBy("folder").parquet(f"{tmp_path}/before/rows")
    for part in ("tree", "schema"):
        spark.read.parquet(f"{tmp_path}/one/{part}").write.parquet(f"{tmp_path}/before/{part}")
    found = snapshots.changes(spark, f"{tmp_path}/before", f"{tmp_path}/two", ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(11, "REMOVED"), (42, "CHANGED")]


def test_an_overlay_has_the_changed_entities_alone(spark, tmp_path):
    wide = spark.range(300).select((F.col("id") % 3).alias("model"), F.col("id").cast("string").alias("entity"), (1 + F.col("id") / 7).alias("H"))
    rules.write_base(wide, STOREY, str(tmp_path), buckets=8)
    changes = spark.createDataFrame([(1, "7", 5.0), (2, "8", None), (0, "no such", 1.0)], "model long, entity string, H double")
    work = rules.write_overlay(spark, str(tmp_path), changes, STOREY, "a", buckets=8)
    assert {tuple(r) for r in work.collect()} == {(1, 1), (2, 1)}
    now = wide.withColumn("H", F.when(F.col("entity") == "7", 5.0).otherwise(F.col("H")))
    values = lambda df: {(r["model"], r["entity"], r["H"], r["Area"], r["Volume"]) for r in df.collect()}
    assert values(rules.read_version(spark, str(tmp_path), "a")) == values(rules.evaluated(now, STOREY))
    assert values(rules.read_version(spark, str(tmp_path))) == values(rules.evaluated(wide, STOREY))


def test_interventions_side_by_side(spark):
    wide = spark.createDataFrame([(1, "a", 2.0, 0.1), (2, "a", 3.0, 0.2), (1, "b", 4.0, 0.3)], "model int, entity string, H double, s_H double")
    change = lambda v: spark.createDataFrame([(1, "a", v, 0.5)], "model int, entity string, value double, design_sigma double")
    rest = {(2, "a", 3.0, 0.2), (1, "b", 4.0, 0.3)}
    for op, v, want in (("set", 9.0, (9.0, 0.5)), ("shift", 1.0, (3.0, 0.1)), ("scale", -2.0, (-4.0, 0.2)), ("scale", 0.0, (2.0, 0.1))):
        assert {tuple(r) for r in rules.with_changes(wide, "H", change(v), op).collect()} == rest | {(1, "a", *want)}
    with pytest.raises(ValueError):
        rules.with_changes(wide, "H", change(1.0), "fly")


def room(spark):
    """The parts of an uneven room, and points on it."""
    r = random.Random(4)
    spots = [(0, 0, 1.0), (4, 0, 1.5), (4, 2, 0.5), (1, 3, 2.0), (0, 5, 1.0), (2.5, 1, 0.2)]
    parts = [(f"p{k}", 1.0 + k % 2, float(x), float(y), z, 0.04, 0.01, 0.0, 0.03, 0.0, 0.05) for k, (x, y, z) in enumerate(spots)]
    points = [tuple(c + r.gauss(0, 0.15) for c in spots[k % 6]) for k in range(600)]
    schema = "part string, weight double, mean_x double, mean_y double, mean_z double, s_xx double, s_xy double, s_xz double, s_yy double, s_yz double, s_zz double"
    return spark.createDataFrame(parts, schema), points


def test_registration_recovers_a_turn_and_a_shift(spark):
    parts, points = room(spark)
    turn, shift = 2.4, (1.0, -2.0, 0.3)
    # the scan lies elsewhere: its pose takes it back
    c, s = math.cos(turn), math.sin(turn)
    scan = [(k, c * (x - shift[0]) + s * (y - shift[1]), -s * (x - shift[0]) + c * (y - shift[1]), z - shift[2]) for k, (x, y, z) in enumerate(points)]
    df = spark.createDataFrame(scan, "id long, x double, y double, z double")
    fit = registration.registered(df, parts)
    assert fit.accepted and len(fit.starts) == 8 and abs(math.cos(fit.pose.yaw - turn) - 1) < 1e-4
    assert fit.pose[:3] == pytest.approx(shift, abs=0.06)
    here = registration.Pose(*fit.pose)
    row = registration.pose_sums(df, registration.mixture(parts, smooth=0.03), [here, *[here._replace(**{a: getattr(here, a) + 1e-5}) for a in registration.AXES]]).orderBy("pose").collect()
    for k, a in enumerate(registration.AXES):  # the gradient, by finite differences of the summed nll
        assert (row[k + 1]["nll"] - row[0]["nll"]) * 600 / 1e-5 == pytest.approx((row[0][f"g_{a}"] + row[k + 1][f"g_{a}"]) / 2, abs=0.05)
    told = registration.posterior_at(df, parts, fit).collect()
    assert sum(r["share"] for r in told) <= 600 and {r["part"] for r in told} == {f"p{k}" for k in range(6)}
    best = {}
    for r in told:
        best[r["id"]] = max(best.get(r["id"], (0, "")), (r["share"], r["part"]))
    assert sum(best[k][1] == f"p{k % 6}" for k in range(600)) > 590
    for kw in ({"scan": "a", "fitted_scan": "b"}, {"scene": "a", "fitted_scene": "b"}):
        with pytest.raises(ValueError):
            registration.posterior_at(df, parts, fit, **kw)
    with pytest.raises(ValueError):
        registration.posterior_at(df, parts, fit._replace(accepted=False))
    with pytest.raises(ValueError):
        registration.registered(df.limit(9), parts)
    with pytest.raises(ValueError):
        registration.registered(df.withColumn("x", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("x"))), parts)


def test_pose_disagreement_and_variance(spark):
    rng = np.random.default_rng(3)
    half = [f"{i}{j}" for i in range(4) for j in range(i, 4)]
    fits, poses, want = [], [], {}
    for k in range(5):
        h, c = (m @ m.T + np.eye(4) for m in rng.normal(size=(2, 4, 4)))
        a, b = rng.normal(size=(2, 4))
        a[3], b[3] = 3.1, -3.1  # near one another around the circle
        upper = lambda m: [float(m[int(x[0]), int(x[1])]) for x in half]
        if k == 4:
            h = np.zeros((4, 4))
        fits.append((k, *map(float, a), *upper(h)))
        poses.append((k, *map(float, b), *upper(c)))
        if k < 4:
            d = b - a
            d[3] = (d[3] + np.pi) % (2 * np.pi) - np.pi
            want[k] = float(d @ np.linalg.solve(np.linalg.inv(h) + c, d))
    columns = lambda names: "scan long, " + ", ".join(f"{n} double" for n in (*registration.AXES, *names))
    f, p = spark.createDataFrame(fits, columns([f"h_{n[2:]}" for n in registration.HALF])), spark.createDataFrame(poses, columns(registration.HALF))
    found = {r["scan"]: (r["m2"], r["status"]) for r in registration.disagreement(f, p).collect()}
    assert found[4] == (None, "SINGULAR") and all(found[k] == (pytest.approx(v), "OK") for k, v in want.items())
    support = [(k, "f", *map(float, rng.normal(size=3)), float(rng.random()), 0.6, 0.8, 0.0) for k in range(4) for _ in range(5)]
    got = {r["scan"]: r["pose_var"] for r in registration.support_pose_variance(spark.createDataFrame(support, "scan long, face string, x double, y double, z double, share double, nx double, ny double, nz double"), p).collect()}
    for k in range(4):
        rows, yaw = [x for x in support if x[0] == k], poses[k][4]
        mass = sum(x[5] for x in rows)
        t = sum(x[5] * ((-math.sin(yaw) * x[2] - math.cos(yaw) * x[3]) * 0.6 + (math.cos(yaw) * x[2] - math.sin(yaw) * x[3]) * 0.8) for x in rows) / mass
        j, c = np.array([0.6, 0.8, 0.0, t]), np.zeros((4, 4))
        for x, v in zip(half, poses[k][5:], strict=True):
            c[int(x[0]), int(x[1])] = c[int(x[1]), int(x[0])] = v
        assert got[k] == pytest.approx(float(j @ c @ j))


def test_lengths_and_turns_of_covariances(spark):
    """Against numpy: random covariances, flat and round ones, and those with two equal lengths."""
    from belvane.operators import splats

    rng = np.random.default_rng(7)
    all_ = [m @ m.T * 10.0**k for k, m in zip(rng.integers(-6, 7, 200), rng.normal(size=(200, 3, 3)), strict=True)]
    for values in ((1, 1, 1), (2, 1, 1), (1, 1, 2), (1, 2, 3), (5, 1e-9, 1e-9), (1, 1, 1 + 1e-9), (1, 1, 1e-7)):
        for _ in range(5):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            all_ += [q @ np.diag(values) @ q.T, np.diag(rng.permutation(values)).astype(float)]
    rows = [(k, *[float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]) for k, m in enumerate(all_)]
    found = splats.scaled_and_turned(spark.createDataFrame(rows, "id long, s_xx double, s_xy double, s_xz double, s_yy double, s_yz double, s_zz double"))
    for r in found.collect():
        m = (all_[r["id"]] + all_[r["id"]].T) / 2
        size = np.abs(m).max()
        want = np.sqrt(np.clip(np.linalg.eigvalsh(m), 1e-12, None))
        scale, (w, x, y, z) = np.array([r[f"scale_{k}"] for k in range(3)]), (r[f"rot_{k}"] for k in range(4))
        assert np.abs(scale**2 - want**2).max() <= 1e-9 * size + 1e-12
        assert w >= 0 and w * w + x * x + y * y + z * z == pytest.approx(1, abs=1e-9)
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert np.abs(turn @ np.diag(scale**2) @ turn.T - m).max() <= 1e-8 * size + 1e-11


def test_layouts_descend_together(spark):
    """Values and gradients in tasks are those of the columns; the descent of many scenarios is that of each by itself."""
    from belvane.operators import layout

    rule = {"Opening": [(1, ("W", "H"))], "Cost": [(1000, ("W",)), (50, ("F",))], "Wall": [(4, ("F",)), (-1, ("W", "H"))]}
    aim = layout.Objective("Cost", "Opening", "F", {"Wall": 0.5}, (("Opening", "F"), ("H", "W")))
    r = random.Random(2)
    rows = [(1, k, r.uniform(0.5, 3), 0.05, r.uniform(1.5, 2.5), 0.02, r.uniform(5, 20), 0.1) for k in range(40)] + [(1, 99, float("nan"), 0.1, 2.0, 0.1, 9.0, 0.1)]
    schema = "model long, entity long, W double, s_W double, H double, s_H double, F double, s_F double"
    df = spark.createDataFrame(rows, schema)
    told = {x["entity"]: x for x in layout.evaluated(df, rule, aim, ["W", "H"]).collect()}
    found = {x["entity"]: x for x in layout.optimised(df, rule, aim, ["W", "H"], rounds=200).collect()}
    sure = [(*x[:3], 0.0, x[4], 0.0, x[6], 0.0) for x in rows]  # the derivative holds deviations fixed
    here, step = ({x["entity"]: x for x in layout.evaluated(spark.createDataFrame([(*x[:2], x[2] + e, *x[3:]) for x in sure], schema), rule, aim, ["W", "H"]).collect()} for e in (0.0, 1e-6))
    for k in range(40):
        assert found[k]["before"] == pytest.approx(told[k]["objective"], rel=1e-12) and found[k]["after"] < found[k]["before"]
        assert (step[k]["objective"] - here[k]["objective"]) / 1e-6 == pytest.approx(here[k]["g_W"], rel=1e-3, abs=1e-2)
    alone = layout.optimised(df.where("entity = 7"), rule, aim, ["W", "H"], rounds=200).first()
    assert alone.asDict() == found[7].asDict()
    assert not found[99]["converged"] and math.isnan(found[99]["W"])
    assert layout.optimised(df.where("false"), rule, aim, ["W", "H"]).count() == 0
