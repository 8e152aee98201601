"""Placements, streams with state, covariances across entities and joint conditioning on small and on long tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from belvane.operators import belief, decision, geometry, graph, lowering, placement, verify
from belvane.streaming import stateful

REL = "model int, kind string, source string, target string"


def test_models_of_a_fleet_do_not_mix(spark):
    """Edges of two models make no cycle together, and a node of one model is no end of another's edge."""
    rel = spark.createDataFrame([(1, "contains", "a", "b"), (2, "contains", "b", "a"), (3, "contains", "x", "y"), (3, "contains", "y", "x")], REL)
    assert {(r["model"], r["subject"]) for r in verify.acyclic({"rel": rel}).collect()} == {(3, "x"), (3, "y")}
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "x"), (3, "y")], "model int, node string")
    assert [(r["model"], r["subject"]) for r in verify.both_ends({"rel": rel, "nodes": nodes}).collect()] == [(1, "contains a b")]
    found = verify.findings({"rel": rel, "nodes": nodes})
    told = {r["model"]: (r["failed"], r["passed"]) for r in verify.report(found, spark.createDataFrame([(1,), (2,)], "model int")).collect()}
    assert told == {1: (1, False), 2: (0, True), 3: (2, False)}  # a model that nobody named is not lost
    slots = spark.createDataFrame([(1, "e", "Area")], "model int, entity string, quantity string")
    entities = spark.createDataFrame([(1, "e", "Wall"), (2, "e", "Wall")], "model int, entity string, class string")
    required = spark.createDataFrame([("Wall", "Area")], "class string, quantity string")
    assert [tuple(r) for r in lowering.missing(entities, required, slots).collect()] == [(2, "e", "Area")]


def test_invariants_of_factors_degrees_and_evaluation(spark):
    rel = spark.createDataFrame([(1, "voids", "o1", "w1"), (1, "voids", "o2", "w1"), (1, "voids", "o2", "w2"), (2, "voids", "o3", "w1")], REL)
    single = spark.createDataFrame([(1, x, "voids") for x in ("o1", "o2", "o3")], "model int, node string, kind string")
    assert {(r["subject"], r["detail"]) for r in verify.exactly_one({"rel": rel, "single": single}).collect()} == {("voids o2", 2.0), ("voids o3", 0.0)}
    cov = spark.createDataFrame([(m, i, j, v) for m, off in ((1, 0.5), (2, 3.0)) for i, j, v in (("a", "a", 1.0), ("a", "b", off), ("b", "a", off), ("b", "b", 1.0))], "model int, i string, j string, v double")
    assert [(r["model"], r["status"]) for r in verify.factors({"cov": cov}).collect()] == [(2, "FAIL")]
    derived = spark.createDataFrame([(1, "x", 2.0, 2.0), (1, "y", 2.0, 2.1), (1, "z", 2.0, 2.5), (2, "x", 1.0, 1.0)], "model int, subject string, value double, again double")
    assert [(r["model"], r["subject"]) for r in verify.reevaluated({"derived": derived}).collect()] == [(1, "z")]


def test_deep_nodes_are_kept_at_the_deepest_depth(spark):
    rel = spark.createDataFrame([(1, "contains", f"n{k}", f"n{k + 1}") for k in range(12)], REL)
    assert {r["node"]: r["depth"] for r in graph.depths(rel, 8).collect()} == {f"n{k}": min(k, 8) for k in range(13)}


PLACE = "model int, node string, parent string, x double, y double, z double, yaw double, tilted boolean"


def test_a_long_line_of_placements(spark, monkeypatch):
    """Ten thousand nodes on one another take 14 rounds."""
    n, r = 10_000, random.Random(3)
    steps = [(r.uniform(-1, 1), r.uniform(-1, 1), 0.001, r.uniform(-0.1, 0.1)) for _ in range(n)]
    rows = [(1, f"n{k}", f"n{k - 1}" if k else None, *s, False) for k, s in enumerate(steps)]
    written, real = [], placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda df: written.append(1) or real(df))
    found = {x["node"]: x for x in placement.resolved(spark.createDataFrame(rows, PLACE)).collect()}
    assert len(written) <= 16
    x = y = z = yaw = 0.0
    for k, (dx, dy, dz, turn) in enumerate(steps):
        x, y, z, yaw = x + math.cos(yaw) * dx - math.sin(yaw) * dy, y + math.sin(yaw) * dx + math.cos(yaw) * dy, z + dz, yaw + turn
        if k % 997 == 0 or k == n - 1:
            got = found[f"n{k}"]
            assert (got["x"], got["y"], got["z"]) == pytest.approx((x, y, z), abs=1e-6) and got["depth"] == k
            assert math.cos(got["yaw"] - yaw) == pytest.approx(1)


def test_placements_that_have_none(spark):
    rows = [
        (1, "root", None, 1.0, 2.0, 3.0, math.pi / 2, False), (1, "a", "root", 1.0, 0.0, 0.0, math.pi, None), (1, "b", "gone", 0.0, 0.0, 0.0, 0.0, False), (1, "c", "b", 0.0, 0.0, 0.0, 0.0, False),
        (1, "t", "root", 0.0, 0.0, 0.0, 0.0, True), (1, "u", "t", 0.0, 0.0, 0.0, 0.0, False), (1, "p", "q", 0.0, 0.0, 0.0, 0.0, False), (1, "q", "p", 0.0, 0.0, 0.0, 0.0, False), (1, "s", "q", 0.0, 0.0, 0.0, 0.0, False),
        (2, "root", "root", 0.0, 0.0, 0.0, 0.0, False), (2, "d", None, 0.0, 0.0, 0.0, 0.0, False), (2, "d", None, 1.0, 0.0, 0.0, 0.0, False), (2, "e", "d", 0.0, 0.0, 0.0, 0.0, False),
    ]
    found = [r.asDict() for r in placement.resolved(spark.createDataFrame(rows, PLACE)).collect()]
    status = {(r["model"], r["node"]): r["status"] for r in found}
    assert len(found) == len(rows) and status == {
        (1, "root"): "PLACED", (1, "a"): "PLACED", (1, "b"): "DANGLING", (1, "c"): "DANGLING", (1, "t"): "OUT_OF_PLANE", (1, "u"): "OUT_OF_PLANE",
        (1, "p"): "CYCLE", (1, "q"): "CYCLE", (1, "s"): "CYCLE", (2, "root"): "CYCLE", (2, "d"): "AMBIGUOUS", (2, "e"): "AMBIGUOUS",
    }
    a = next(r for r in found if r["node"] == "a")
    assert (a["x"], a["y"], a["z"], abs(a["yaw"]), a["depth"]) == pytest.approx((1.0, 3.0, 3.0, math.pi / 2, 1))
    assert placement.resolved(spark.createDataFrame([], PLACE)).count() == 0
    pose = {c: F.lit(v) for c, v in zip(placement.POSE, (1.0, -2.0, 0.5, 0.7), strict=True)}
    back = placement.composed(placement.inverse(pose), pose)
    assert spark.range(1).select(*back.values()).first() == pytest.approx((0, 0, 0, 0), abs=1e-12)


def test_one_key_is_filtered_in_many_tasks(spark):
    """A key with most of the readings is cut into ranges; the result is that of one step after the other."""
    r = random.Random(5)
    rows = [("hot", k, r.uniform(0, 100), r.choice([1.0, 4.0, 0.0])) for k in range(6000)] + [(f"k{k % 9}", k, r.uniform(0, 9), 2.0) for k in range(90)]
    rows += [("null y", 0, 1.0, 1.0), ("null y", 1, None, 1.0), ("null r", 0, 1.0, 1.0), ("null r", 1, 2.0, None), (None, 0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, at int, y double, r double").repartition(7)
    for q, a, b in ((1.0, 1.0, 0.0), (0.5, 0.9, 0.3), (0.0, 1.0, 0.0)):
        found = {x["key"]: x for x in belief.predict_update(df, "key", ["at"], mu0=50.0, var0=100.0, q=q, a=a, b=b).collect()}
        for key in {x[0] for x in rows}:
            mu, var, mine = 50.0, 100.0, sorted((x for x in rows if x[0] == key), key=lambda x: x[1])
            for _, _, y, noise in mine:
                p = None if var is None else a * a * var + q
                gain = None if p is None or noise is None else p / (p + noise) if p + noise else 1.0
                mu = None if gain is None or mu is None or y is None else a * mu + b + gain * (y - a * mu - b)
                var = None if gain is None else (1 - gain) * p
            assert found[key]["n"] == len(mine)
            if q or key != "hot":  # with no noise at all a second exact reading has no one answer
                assert found[key]["mu"] == (None if mu is None else pytest.approx(mu, abs=1e-9)) and found[key]["var"] == (None if var is None else pytest.approx(var, abs=1e-9))


def parts(spark, rows, schema, slices, top):
    """The rows written in ``slices`` files one after the other, and a stream over them."""
    for k, part in enumerate(slices):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")


def test_a_filter_that_is_stopped_goes_on(spark, tmp_path):
    schema, r = "key string, place long, y double, r double", random.Random(1)
    rows = [(f"k{i % 3}", i, r.uniform(0, 100), 4.0) for i in range(60)]
    top = str(tmp_path)
    stateful.filtered(parts(spark, rows, schema, [range(20), range(20, 30)], top), "key", top, mu0=50.0, var0=100.0, q=1.0).collect()
    late = [("k0", 27, 1.0, 4.0), ("k0", 57, 1.0, 4.0), ("k0", 61, 1.0, 0.0), ("k0", 62, None, 1.0), ("k0", 63, 5.0, None), ("new", 0, 5.0, 4.0)]
    found = stateful.filtered(parts(spark, rows + late, schema, [range(30, 60), range(60, 66)], top), "key", top, mu0=50.0, var0=100.0, q=1.0).collect()
    assert len(found) == 66
    want = {x["key"]: x for x in belief.predict_update(spark.createDataFrame(rows + late[-1:], schema), "key", ["place"], mu0=50.0, var0=100.0, q=1.0).collect()}
    for key, w in want.items():
        last = max((x for x in found if x["key"] == key and x["reason"] is None), key=lambda x: x["place"])
        assert (last["n"], last["mu"], last["var"]) == (w["n"], pytest.approx(w["mu"]), pytest.approx(w["var"]))
    assert {(x["place"], x["reason"]) for x in found if x["reason"]} == {(27, "LATE"), (57, "REPEATED"), (61, "NOISE"), (62, "VALUE"), (63, "NOISE")}


def test_a_log_guards_its_lifecycle_over_restarts(spark, tmp_path):
    schema = "key string, place long, line string, prior string, record string, step string"
    allowed = [(None, "proposed"), ("proposed", "approved"), ("approved", "done")]
    rows, r = [], random.Random(8)
    for i in range(120):
        record = r.choice([None, "a", "b"])
        rows.append((f"k{i % 2}", i, f"line {i}", r.choice([None, None, "0" * 64]), record, r.choice(["proposed", "approved", "done"]) if record else None))
    rows += [("k0", 3, "again", None, None, None), ("k1", 119, "again", None, None, None)]
    heads, steps, last, want = {}, {}, {}, {}
    for key, place, line, prior, record, step in rows:
        head, seq = heads.get(key, ("0" * 64, 0))
        if key in last and place <= last[key]:
            reason = "REPEATED" if place == last[key] else "LATE"
        elif prior is not None and prior != head:
            reason = "STALE"
        elif record is not None and (steps.get((key, record)), step) not in allowed:
            reason = "ILLEGAL_STEP"
        else:
            reason, last[key], heads[key] = None, place, (hashlib.sha256(f"{head}|{line}".encode()).hexdigest(), seq + 1)
            if record:
                steps[key, record] = step
        want[key, place, line] = (reason, None, None) if reason else (None, seq, heads[key][0])
    top = str(tmp_path)
    for slices in ([range(30), range(30, 50)], [range(50, 120), range(120, 122)]):
        found = stateful.appended(parts(spark, rows, schema, slices, top), "key", top, allowed).collect()
    assert len(found) == len(rows)
    assert sorted((x["key"], x["place"], str(x["reason"]), str(x["seq"]), str(x["event_hash"])) for x in found) == sorted((k, p, str(a), str(b), str(c)) for (k, p, _), (a, b, c) in want.items())
    assert {x["reason"] for x in found} == {None, "STALE", "ILLEGAL_STEP", "LATE", "REPEATED"}


def test_streams_make_no_table_for_each_key(spark, tmp_path):
    """A pandas table for each key and micro-batch took most of the time."""
    from pyspark.sql import Row

    rows = [Row(key="k", place=p, y=y, r=r) for p, y, r in [(2, 1.0, 4.0), (1, 9.0, 2.0), (2, None, 4.0), (1, 3.0, 2.0), (1, 0.0, 1.0), (2, 5.0, float("nan"))]]
    assert [tuple(x)[1:3] for x in stateful.in_turn(iter(rows), "place")] == [(1, 0.0), (1, 3.0), (1, 9.0), (2, 1.0), (2, None), (2, 5.0)]
    stream = parts(spark, [("a", 1, 5.0, 1.0)], "key string, place long, y double, r double", [range(1)], str(tmp_path))
    found = stateful.filtered(stream, "key", str(tmp_path), mu0=0.0, var0=1.0, q=0.0)
    assert [(r["n"], r["mu"], r["var"]) for r in found.collect()] == [(1, 2.5, 0.5)]
    assert not hasattr(stateful, "pd")


def dense(rng, n, rank):
    m = rng.normal(size=(n, rank))
    return m @ m.T + np.eye(n)


def long_form(model, m, left="i", right="j"):
    return [(model, f"v{i}", f"v{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]


def test_joint_conditioning_agrees_with_a_dense_solve(spark):
    rng = np.random.default_rng(4)
    cov, rows, readings, want = [], [], [], {}
    for model, (n, k, exact) in enumerate(((6, 3, False), (9, 4, True), (3, 2, True), (4, 2, False))):
        s, h, e = dense(rng, n, 2), rng.normal(size=(k, n)), rng.normal(size=k)
        r = np.zeros(k) if exact else rng.uniform(0.5, 2, k)
        if model == 2:  # the same exact reading twice
            h[1], e[1] = h[0], e[0]
        if model == 3:
            r[0] = -1.0
        cov += long_form(model, s)
        rows += [(model, f"o{a}", f"v{b}", float(h[a, b])) for a in range(k) for b in range(n)]
        readings += [(model, f"o{a}", float(e[a]), float(r[a])) for a in range(k)]
        if model < 2:
            for i, x in enumerate(s @ h.T @ np.linalg.solve(h @ s @ h.T + np.diag(r), e)):
                want[model, f"v{i}"] = x
    shift, told = belief.conditioned_jointly(
        spark.createDataFrame(cov, "model long, i string, j string, v double"), spark.createDataFrame(rows, "model long, obs string, var_id string, h double"), spark.createDataFrame(readings, "model long, obs string, innovation double, r double")
    )
    found = {(x["model"], x["var_id"]): x["shift"] for x in shift.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
    assert {x["model"]: x["status"] for x in told.collect()} == {0: "SOLVED", 1: "SOLVED", 2: "REDUNDANT", 3: "INVALID"}


def test_joint_conditioning_of_a_large_model(spark):
    """A chain of 100,000 variables of which each tenth is read, solved by neighbours alone."""
    n = 100_000
    v = spark.range(n).withColumnRenamed("id", "i")
    cov = v.select(F.lit(1).alias("model"), "i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("j")).where(f"j >= 0 and j < {n}").withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.4))
    obs = v.where("i % 10 < 3").select(F.lit(1).alias("model"), F.col("i").alias("obs"))
    shift, told = belief.conditioned_jointly(cov, obs.select("model", "obs", F.col("obs").alias("var_id"), F.lit(1.0).alias("h")), obs.select("model", "obs", F.lit(1.0).alias("innovation"), F.lit(0.5).alias("r")))
    x = np.linalg.solve(np.array([[1.5, 0.4, 0], [0.4, 1.5, 0.4], [0, 0.4, 1.5]]), np.ones(3))  # readings ten apart don't touch
    assert told.first()["status"] == "SOLVED"
    got = {r["var_id"]: r["shift"] for r in shift.where("var_id between 50000 and 50009").collect()}
    assert [got[50000 + k] for k in range(4)] == pytest.approx([x[0] + 0.4 * x[1], 0.4 * x[0] + x[1] + 0.4 * x[2], 0.4 * x[1] + x[2], 0.4 * x[2]])


def test_covariances_across_entities_agree_with_matrices(spark):
    rng = np.random.default_rng(2)
    s, j = dense(rng, 5, 2), rng.normal(size=(4, 5)) * (rng.random((4, 5)) < 0.6)
    cov = spark.createDataFrame(long_form(1, s), "model long, i string, j string, v double")
    jac = spark.createDataFrame([(1, f"o{a}", f"v{b}", float(j[a, b])) for a, b in zip(*np.nonzero(j), strict=True)], "model long, out_var string, var_id string, v double")
    asked = [(a, b) for a in range(4) for b in range(4)]
    found = {(r["a"], r["b"]): r for r in belief.pair_covariances(jac, cov, spark.createDataFrame([(1, f"o{a}", f"o{b}") for a, b in asked], "model long, a string, b string")).collect()}
    full = j @ s @ j.T
    for a, b in asked:
        r = found[f"o{a}", f"o{b}"]
        assert (r["cov"], r["var_a"], r["var_b"]) == pytest.approx((full[a, b], full[a, a], full[b, b]))
    named = jac.select("model", F.lit("e").alias("x"), "*").select(F.col("model").alias("m"), "out_var", "var_id", "v")
    comp = named.select(F.lit(1).cast("long").alias("model"), F.when(F.col("out_var").isin("o0", "o1"), "p").otherwise("q").alias("entity"), F.when(F.col("out_var").isin("o0", "o2"), "x").otherwise("y").alias("component"), "var_id", "v")
    got = {(r["p"], r["q"]): r["v"] for r in belief.relative_covariances(comp, cov, spark.createDataFrame([(1, "p", "q")], "model long, a string, b string")).collect()}
    d = j[[0, 1]] - j[[2, 3]]
    want = d @ s @ d.T
    assert got == {(p, q): pytest.approx(want[a, b]) for a, p in enumerate("xy") for b, q in enumerate("xy")}


def test_clearance_gradient_by_finite_differences(spark):
    r = random.Random(6)
    box = lambda k: (k, r.uniform(0, 3), r.uniform(0, 3), 0.0, r.uniform(-3, 3), r.uniform(0.5, 2), r.uniform(0.5, 2), 1.0)
    schema = "id long, ox double, oy double, oz double, yaw double, ex double, ey double, ez double"
    rows = [box(k) for k in range(40)]
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)], "a long, b long")
    apart = lambda rs: {x["pair"]: x for x in decision.flat_clearance(geometry.sided(pairs, spark.createDataFrame(rs, schema))).collect()}
    base = apart(rows)
    exact = {(x["pair"], x["id"], x["extent"]): x["v"] for x in decision.clearance_gradient(decision.flat_clearance(geometry.sided(pairs, spark.createDataFrame(rows, schema)))).collect()}
    for column, extent in ((5, "x"), (6, "y")):
        for odd in (0, 1):
            moved = apart([(*x[:column], x[column] + 1e-6, *x[column + 1 :]) if x[0] % 2 == odd else x for x in rows])
            for pair, m in moved.items():
                if m["axis"] == base[pair]["axis"]:
                    assert (m["clearance"] - base[pair]["clearance"]) / 1e-6 == pytest.approx(exact[pair, base[pair]["b" if odd else "a"], extent], abs=1e-4)
