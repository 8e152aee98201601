"""Operators of audits and decisions on small tables: ties, nulls, empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from belvane.operators import attention, decision, geometry, ledger, lowering


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit(spark):
    entities = spark.createDataFrame([(1, 1, "x", False, True), (1, 2, "x", False, False), (1, 3, "x", True, True), (2, 4, "y", False, False)], "model int, entity int, class string, blocked boolean, has_geometry boolean")
    required = spark.createDataFrame([("x", "q"), ("x", "r")], "class string, quantity string")
    slots = spark.createDataFrame([(1, "q"), (2, "q"), (2, "q")], "entity int, quantity string")
    found = lowering.audit(entities, required, slots)
    assert rows(found.select("entity", "n_missing", "status")) == [(1, 1, "NEEDS_GEOMETRY"), (2, 1, "MISSING"), (3, 2, "BLOCKED"), (4, 0, "READY")]
    assert rows(lowering.summary(found)) == [(1, 0, 1, 1, 1, False), (2, 1, 0, 0, 0, True)]
    assert rows(lowering.audit(entities.limit(0), required, slots)) == []


def test_digest_ignores_order_but_not_repeats(spark):
    make = lambda *x: rows(lowering.module_digest(spark.createDataFrame([(1, y) for y in x], "model int, line string")))
    assert make("a", "b") == make("b", "a")
    assert make("a", "b") != make("a", "b", "b")


def test_equivalence_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert rows(lowering.equivalence({"t": a}, {"t": a.distinct()})) == [("t", 1, 0, False)]
    assert rows(lowering.equivalence({"t": a.limit(0)}, {"t": a.limit(0)})) == [("t", 0, 0, True)]


def test_samples_do_not_depend_on_partitions(spark):
    slots = spark.range(200).select(F.lit(1).alias("model"), F.col("id").cast("string").alias("var_id"), F.lit(5.0).alias("mu"), F.lit(2.0).alias("sigma"))
    drawn = decision.samples(slots, 20, 3)
    assert rows(drawn) == rows(decision.samples(slots.repartition(7), 20, 3))
    mean, std = drawn.agg(F.avg("mu"), F.stddev("mu")).first()
    assert abs(mean - 5) < 0.15 and abs(std - 2) < 0.1


def test_separation(spark):
    names = [f"{c}_{s}" for s in "ab" for c in ("ox", "oy", "oz", "yaw", "ex", "ey", "ez")]
    box = lambda x, y, z=0.0, yaw=0.0: (x, y, z, yaw, 1.0, 1.0, 1.0)
    pairs = [box(0.0, 0.0) + box(1.5, 0.0), box(0.0, 0.0) + box(0.0, 0.0), box(0.0, 0.0) + box(0.0, 0.0, 3.0), box(0.0, 0.0) + box(2.0, 0.0, 0.0, 0.7853981633974483)]
    found = decision.separation(spark.createDataFrame(pairs, ", ".join(f"{n} double" for n in names)).coalesce(1))
    assert [round(r["clearance"], 6) for r in found.collect()] == [0.5, -1.0, 2.0, 0.292893]


def test_capacity_claim_ties_and_overflow(spark):
    beams = spark.createDataFrame([(1, 5, 1, 4), (2, 15, 1, 14), (3, 10**18 - 1, 10**18 - 1, 1)], "id int, strength long, modulus long, demand long")
    found = {r["id"]: (r["available"], r["verdict"]) for r in decision.capacity_claim(beams).collect()}
    assert found == {1: ("4", "PASS"), 2: ("14", "PASS"), 3: (None, "OVERFLOW")}


def test_attention_of_one_token(spark):
    tokens = spark.createDataFrame([(1, 0.0, 0.0, 1.0, "x")], "id int, x double, y double, payload double, class string")
    heard = attention.weights(tokens, attention.both_ways(spark.createDataFrame([(1, 1)], "a int, b int")), scale=1.0, length=1.0, other_class=0.5)
    assert rows(heard) == []
    assert rows(attention.spread(tokens.select("id", F.col("payload").alias("v")), heard, rounds=2, rate=0.5)) == [(1, 1.0)]


def test_invalid_parts(spark):
    names = "part string, weight double, m_x double, m_y double, c_x_x double, c_x_y double, c_y_y double"
    parts = [("good", 1.0, 0.0, 0.0, 1.0, 0.5, 1.0), ("light", 0.0, 0.0, 0.0, 1.0, 0.0, 1.0), ("flat", 1.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("nan", 1.0, float("nan"), 0.0, 1.0, 0.0, 1.0), ("null", 1.0, None, 0.0, 1.0, 0.0, 1.0)]
    assert sorted(r["part"] for r in geometry.invalid_parts(spark.createDataFrame(parts, names)).collect()) == ["flat", "light", "nan", "null"]


def test_attested_needs_one_event(spark):
    log = spark.createDataFrame([("h", None), ("i", 1), ("j", 2), ("j", 2)], "event_hash string, v int")
    receipts = spark.createDataFrame([("h", None), ("i", 2), ("j", 2), ("k", 1)], "event_hash string, v int")
    assert {r["event_hash"]: r["attested"] for r in ledger.attested(receipts, log, ["v"]).collect()} == {"h": True, "i": False, "j": False, "k": False}
