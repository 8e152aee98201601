"""Rules, invariants, codecs and replays on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from belvane.operators import belief, ingest, ledger, lowering, rules, scan, verify

STOREY = {"Area": [(1, ("H", "H"))], "Volume": [(1, ("Area", "H"))]}


def test_order_and_cycles():
    assert rules.ordered(STOREY) == [["Area"], ["Volume"]] and rules.free(STOREY) == ["H"] and rules.raws_of(STOREY, "Volume") == ["H"]
    with pytest.raises(ValueError, match="cycle: A, B"):
        rules.ordered({"A": [(1, ("B",))], "B": [(1, ("A",))], "C": []})
    assert rules.local_edges(STOREY, "Volume") == [("Volume", "Area", 1), ("Volume", "H", 1), ("Area", "H", 2)]


def test_parsed_rules():
    text = json.dumps([{"name": "Area", "terms": [{"coef": 1, "factors": ["H", "H"]}]}])
    assert rules.parsed(text) == {"Area": [(1.0, ("H", "H"))]}
    for bad in ([{"name": "A", "terms": [], "more": 1}], [{"name": "A", "terms": [{"coef": 1}]}], [{"name": "A", "terms": []}, {"name": "A", "terms": []}]):
        with pytest.raises(ValueError):
            rules.parsed(json.dumps(bad))
    with pytest.raises(ValueError):
        rules.mean_of([])


def test_values_gradients_and_missing(spark):
    slots = spark.createDataFrame([(1, "a", "H", 3.0, 0.01), (1, "b", "H", 2.0, 0.1), (1, "c", "W", 1.0, 0.1)], "model int, entity string, quantity string, mu double, sigma double")
    rows = rules.with_gradient(rules.side_by_side(slots, ["H", "W"]), STOREY)
    found = {r["entity"]: r for r in rows.collect()}
    assert (found["a"]["Area"], found["a"]["Volume"], found["a"]["d_Area_H"], found["a"]["d_Volume_H"]) == (9.0, 27.0, 6.0, 27.0)
    cov = {(r["i"], r["j"]): r["v"] for r in rules.covariance(rows.where("entity = 'b'"), STOREY, ["Area", "Volume"]).collect()}
    assert cov[("Area", "Volume")] == pytest.approx(4 * 12 * 0.01) and cov[("Area", "Volume")] == cov[("Volume", "Area")]
    wide = rules.side_by_side(slots.where("quantity = 'H'"), ["H"])
    before = rules.evaluated(wide, STOREY)
    now = wide.withColumn("H", F.when(F.col("entity") == "b", 5.0).otherwise(F.col("H")))
    after, work = rules.incremental(before, now, wide.where("entity = 'b'"), STOREY)
    assert {(r["entity"], r["Volume"]) for r in after.collect()} == {(r["entity"], r["Volume"]) for r in rules.evaluated(now, STOREY).collect()}
    assert work.first().asDict() == {"model": 1, "recomputed": 1, "kept": 1}


def test_factors_refused(spark):
    env = spark.createDataFrame([(1, "x", 2.0, 1.0), (1, "y", 2.0, 1.0)], "model int, var_id string, mu double, sigma double")
    changes = spark.createDataFrame([(1, "x", 0.0), (1, "y", -3.0)], "model int, var_id string, factor double")
    assert {(r["var_id"], r["mu"], r["sigma"]) for r in belief.scale_parameter(env, changes).collect()} == {("x", 2.0, 1.0), ("y", -6.0, 3.0)}
    assert [(r["var_id"], r["reason"]) for r in belief.refused_factors(changes).collect()] == [("x", "FACTOR_IS_ZERO")]


def test_conditioning_agrees_with_the_joint_solve(spark):
    cov = [(1, "x", "x", 4.0), (1, "x", "y", 1.5), (1, "y", "x", 1.5), (1, "y", "y", 2.0)]
    df = spark.createDataFrame(cov, "model long, i string, j string, v double")
    row = spark.createDataFrame([(1, "x", 1.0, 0.5)], "model long, var_id string, h double, r double")
    seen = spark.createDataFrame([(1, "x", 1.0, 0.5)], "model long, var_id string, innovation double, r double")
    one = {r["i"]: r["v"] for r in belief.conditioned(df, row, ["model"]).where("i = j").collect()}
    two = {r["var_id"]: r["var"] for r in belief.conditioned_by_joint(df, seen).collect()}
    assert one == pytest.approx(two)
    assert belief.positive(df, "model").first()["positive"]
    bent = df.withColumn("v", F.when(F.col("i") != F.col("j"), 9.0).otherwise(F.col("v")))
    assert not belief.positive(bent, "model").first()["positive"]


def test_a_cycle_reached_from_a_root_fails(spark):
    rel = spark.createDataFrame([(1, "contains", "r", "a"), (1, "contains", "a", "b"), (1, "contains", "b", "a"), (1, "contains", "r", "z")], "model int, kind string, source string, target string")
    assert {r["subject"] for r in verify.acyclic({"rel": rel}).collect()} == {"a", "b"}


def test_strict_json_and_operations(spark):
    files = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1}'), (3, '{"a": "no", "b": "x"}'), (4, '{"a": 99, "b": "x"}'), (5, "["), (6, None)], "id int, body string")
    found = {r["id"]: r["reason"] for r in ingest.strict_json(files, {"a": "double", "b": "string"}, limits={"a": (0, 10)}).collect()}
    assert found == {1: None, 2: "KEYS", 3: "TYPE", 4: "LIMITS", 5: "NOT_JSON", 6: "NOT_JSON"}
    ops = spark.createDataFrame([(1, '{"op": "observe", "y": "1", "r": "0"}'), (2, '{"op": "observe", "y": "1", "r": "2"}'), (3, '{"op": "fly"}')], "id int, body string")
    assert {r["id"]: r["fault"] for r in ledger.operations(ops, {"observe": ["y", "r"]}).collect()} == {1: "NOISE", 2: None, 3: "UNKNOWN_OP"}


def test_replay_over_several_runs(spark):
    rows = [(1, k, "accepted" if k % 5 else "rejected", ("set", "shift", "scale", "shift")[k % 4], float(k % 3)) for k in range(9000)]
    mu = 7.0
    for _, _, status, op, v in rows:
        if status == "accepted":
            mu = v if op == "set" else mu + v if op == "shift" else mu * v
    r = ledger.replayed(spark.createDataFrame(rows, "model int, seq long, status string, op string, value double"), {"mu": 7.0}).first()
    assert (r["accepted"], r["rejected"], r["mu"]) == (7200, 1800, mu)


def test_registration_finds_a_shift(spark):
    points = spark.createDataFrame([(k, (k % 2) * 10 + 0.3 + (k % 5) * 0.01, 0.2 + (k % 7) * 0.01) for k in range(200)], "id long, x double, y double")
    parts = spark.createDataFrame([("a", 0.5, 0.02, 0.03, 1.0, 1.0), ("b", 0.5, 10.02, 0.03, 1.0, 1.0)], "part string, weight double, mean_x double, mean_y double, var_x double, var_y double")
    shift, trace = scan.registered(points, parts, ["x", "y"], rounds=10)
    assert shift["x"] == pytest.approx(-0.3, abs=0.01) and shift["y"] == pytest.approx(-0.2, abs=0.01) and trace == sorted(trace, reverse=True)
    with pytest.raises(ValueError):
        scan.with_parts(points, parts, ["x", "y"], most=1)


def test_composite_is_one_change(spark):
    before = spark.createDataFrame([("m", "x", 2.0), ("m", "y", 5.0)], "model string, var string, mu double")
    steps = spark.createDataFrame([("m", "x", 3, "scale", 2.0), ("m", "x", 1, "set", -4.0), ("m", "x", 2, "shift", 5.0), ("m", "z", 1, "set", 1.0), ("m", "x", 5000, "shift", 1.0)], "model string, var string, seq long, op string, value double")
    found = {r["var"]: r["mu"] for r in verify.composite(before, steps, ["model", "var"]).collect()}
    assert found == {"x": 3.0, "y": 5.0}
    assert verify.composite(before.limit(0), steps, ["model", "var"]).count() == 0


def test_attached_properties_and_listing(spark):
    products = spark.createDataFrame([(1,), (2,)], "id long")
    relations = spark.createDataFrame([("s", [1, 9]), ("s", [1]), ("t", [2]), ("u", None)], "set string, related array<long>")
    sets = spark.createDataFrame([("s", "Fire", "F30"), ("u", "Load", "1")], "set string, name string, value string")
    assert [tuple(r) for r in ingest.attached(products, relations, sets).collect()] == [(1, "s", "Fire", "F30")]
    slots = spark.createDataFrame([("e", "b", 123456.5, 0.0), ("e", "a", -0.00012345678, None)], "entity string, quantity string, mu double, sigma double")
    rows = lowering.listed(slots, ["entity"]).first()["quantities"]
    assert [(r["quantity"], pytest.approx(r["mu"]), r["sigma"]) for r in rows] == [("a", -0.000123457, None), ("b", 123457.0, 0.0)]
