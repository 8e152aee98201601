"""Operators on small tables: nulls, ties, empty tables and streams that are run twice."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest

from belvane.operators import belief, dag, geometry, ledger
from belvane.streaming.posterior import posterior_of_stream


def test_tiles_keep_the_moments_of_their_box(spark):
    box = spark.createDataFrame([(1, 2.0, 3.0, 0.0, 0.7, 2.5, 0.4, 3.0)], "id long, ox double, oy double, oz double, yaw double, ex double, ey double, ez double")
    whole, tiles = geometry.primitives(box, 100.0).toPandas(), geometry.primitives(box, 1.0).toPandas()
    assert len(whole) == 1 and len(tiles) == 3 * 1 * 3
    one = whole.iloc[0]
    for x in "xyz":
        assert tiles[f"mean_{x}"].mean() == pytest.approx(one[f"mean_{x}"])
    for x, y in ("xx", "xy", "yy", "zz"):
        between = (tiles[f"mean_{x}"] * tiles[f"mean_{y}"]).mean() - tiles[f"mean_{x}"].mean() * tiles[f"mean_{y}"].mean()
        assert tiles[f"s_{x}{y}"].mean() + between == pytest.approx(one[f"s_{x}{y}"])


def test_a_box_without_extent_is_one_tile(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "id long, ox double, oy double, oz double, yaw double, ex double, ey double, ez double")
    assert geometry.primitives(box, 1.0).count() == 1


def test_equal_parts_are_at_no_distance(spark):
    parts = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 2.0)], "part long, mean_x double, var_x double")
    row = geometry.distances(parts, ["x"]).first()
    assert (row["bhattacharyya"], row["kl"]) == (pytest.approx(0), pytest.approx(0))
    assert row["log_overlap"] == pytest.approx(-0.5 * math.log(2 * math.pi * 4))


def test_a_far_point_is_an_outlier(spark):
    scored = spark.createDataFrame([(1, "a", 0.0), (1, "b", -2.0), (2, "a", -1e6), (2, "b", -1e6)], "id long, part string, log_p double")
    found = {r["part"]: r for r in geometry.evidence(scored, 0.05, 0.1).collect()}
    mass = 0.95 * (1 + math.exp(-2)) / (0.95 * (1 + math.exp(-2)) + 0.005)
    assert found["a"]["effective_points"] + found["b"]["effective_points"] == pytest.approx(mass)


def test_length_of_a_path(spark):
    points = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 3.0, 4.0), ("a", 3, 3.0, 5.0), ("b", 1, 9.0, 9.0)], "key string, k int, x double, y double")
    assert {tuple(r) for r in geometry.path_length(points, "key", ["k"]).collect()} == {("a", 3, 6.0), ("b", 1, 0.0)}


def test_ties_of_readings_go_by_name(spark):
    j = spark.createDataFrame([(1, "y", "b", 2.0), (1, "y", "a", 2.0), (1, "y", "c", 0.0)], "model long, out_var string, var_id string, v double")
    sigma = spark.createDataFrame([(1, x, 1.0) for x in "abc"], "model long, var_id string, sigma double")
    found = {r["var_id"]: (r["place"], r["gain"]) for r in belief.observation_plan(j, sigma, 1.0).collect()}
    assert [found[x][0] for x in "abc"] == [1, 2, 3]
    assert found["a"][1] == pytest.approx(-0.5 * math.log(0.75)) and found["c"][1] == pytest.approx(0)


def test_the_first_request_of_a_log_names_the_beginning(spark):
    log = spark.createDataFrame([("a", 0, "h0"), ("a", 1, "h1")], "key string, seq long, event_hash string")
    asks = spark.createDataFrame([("a", "h1"), ("a", "h0"), ("a", None), ("new", ledger.GENESIS)], "key string, head string")
    found = {(r["key"], r["head"]): r["accepted"] for r in ledger.admit(asks, log, "key").collect()}
    assert found == {("a", "h1"): True, ("a", "h0"): False, ("a", None): False, ("new", ledger.GENESIS): True}


def test_regressions_see_nulls_and_missing_facts(spark):
    schema = "subject string, fact string, value long"
    e = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("a", "z", 3)], schema)
    m = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "z", 3)], schema)
    assert {tuple(r) for r in ledger.regression(e, m).collect()} == {("a", "z", 3, None), ("b", "z", None, 3)}


def test_a_stream_of_many_batches_equals_one_sum(spark, tmp_path):
    schema = "key string, y double, r double"
    rows = [("a", float(k), 1.0 + k % 3) for k in range(12)] + [("b", 5.0, 2.0), ("b", 7.0, 0.0), ("b", 7.0, None)]
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {r["key"]: r for r in posterior_of_stream(stream, "key", 50.0, 100.0).collect()}
    once = {r["key"]: r for r in belief.posterior(spark.createDataFrame(rows, schema), "key", 50.0, 100.0).collect()}
    for key in "ab":
        assert found[key]["n"] == once[key]["n"]
        assert (found[key]["mu"], found[key]["var"]) == (pytest.approx(once[key]["mu"]), pytest.approx(once[key]["var"]))


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, y double, r double").parquet(str(tmp_path / "in"))
    assert posterior_of_stream(stream, "key", 50.0, 100.0).count() == 0


def test_levels_count_nodes_and_leave_out_cycles(spark):
    # 8 layers of 10 nodes, each joined with all of the next: ten million paths, more rows than a recursive query may have
    edges = [(f"{k}:{i}", f"{k + 1}:{j}") for k in range(7) for i in range(10) for j in range(10)]
    edges += [("0:0", "7:0"), ("0:0", "x"), ("x", "y"), ("y", "x"), ("y", "z")]
    df = spark.createDataFrame(edges, "parent string, child string")
    found = {r["node"]: r["level"] for r in dag.levels(df).collect()}
    assert found == {f"{k}:{i}": k for k in range(8) for i in range(10)}
    with pytest.raises(RuntimeError):
        dag.levels(df, 5)


def test_affected_reaches_the_whole_of_a_long_line(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(65)], "parent long, child long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted(r["node"] for r in dag.affected(df, start).collect()) == list(range(1, 66))
    with pytest.raises(RuntimeError):
        dag.affected(df, start, 5)


def test_a_long_log_is_chained_and_filtered_batch_by_batch(spark):
    """A key of more rows than a batch of Arrow, whose folded array would hold all of its hashes."""
    rows = [(k % 3 // 2, 1000 - k // 4, k, f"é{k % 7}", float(k % 11), 1.0 + k % 5) for k in range(25_000)] + [(None, 0, -1, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "user long, ts long, id long, what string, y double, r double")
    found = ledger.chain(df, "user", ["ts", "id"], ["what"])
    assert "collect_list" not in found._jdf.queryExecution().toString()
    logs, sequences = defaultdict(list), defaultdict(list)
    for r in found.collect():
        logs[r["user"]].append(r)
    for r in ledger.sequence(df, "user", ["ts", "id"], ["what"]).collect():
        sequences[r["user"]].append((r["seq"], r["id"], r["line"]))
    state = {r["user"]: r for r in belief.predict_update(df, "user", ["ts", "id"], mu0=5.0, var0=9.0, q=0.5).collect()}
    assert len(state) == len(logs) == 3
    for user, log in logs.items():
        log.sort(key=lambda r: r["seq"])
        last, mu, var = ledger.GENESIS, 5.0, 9.0
        own = sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3])
        assert len(own) == len(log)
        for seq, (r, e) in enumerate(zip(log, own)):
            assert (r["seq"], r["id"], r["line"], r["previous_hash"]) == (seq, e[2], e[3] or "", last)
            last = hashlib.sha256(f"{last}|{e[3] or ''}".encode()).hexdigest()
            assert r["event_hash"] == last
            gain = (var + 0.5) / (var + 0.5 + e[5])
            mu, var = mu + gain * (e[4] - mu), (1 - gain) * (var + 0.5)
        assert sorted(sequences[user]) == [(r["seq"], r["id"], r["line"]) for r in log]
        assert (state[user]["n"], state[user]["mu"], state[user]["var"]) == (len(own), pytest.approx(mu), pytest.approx(var))


def test_nested_definitions_are_evaluated_a_level_at_a_time(spark):
    """G = q p, N = G - G d, C = N + N t; K is constant, L = K q; X and Y are a cycle, Z is behind it, U has an unknown variable."""
    rules = {"G": [(1.0, "qp")], "N": [(1.0, "G"), (-1.0, "Gd")], "C": [(1.0, "N"), (1.0, "Nt")], "K": [(3.0, "")], "L": [(1.0, "Kq")], "X": [(1.0, "Y")], "Y": [(1.0, "X")], "Z": [(1.0, "Xq")], "U": [(1.0, "u")]}
    terms = spark.createDataFrame([(1, out, k, c, [(x, 1) for x in f]) for out, ts in rules.items() for k, (c, f) in enumerate(ts)], "model int, out_var string, term_id int, coef double, factors array<struct<var_id: string, pow: int>>")
    q, p, d, t = 5.0, 7.0, 0.1, 0.2
    env = spark.createDataFrame([(1, "q", q), (1, "p", p), (1, "d", d), (1, "t", t)], "model int, var_id string, mu double")
    found = {r["out_var"]: r["mu"] for r in dag.evaluate(terms, env).collect()}
    assert found == {"G": 35.0, "N": pytest.approx(31.5), "C": pytest.approx(37.8), "K": 3.0, "L": 15.0, "X": None, "Y": None, "Z": None, "U": None}
    v = {(r["out_var"], r["var_id"]): r["v"] for r in dag.partials(terms, env).collect()}
    want = {("G", "q"): p, ("G", "p"): q, ("N", "q"): p * (1 - d), ("N", "p"): q * (1 - d), ("N", "d"): -q * p, ("L", "q"): 3.0}
    want |= {("C", "q"): p * (1 - d) * (1 + t), ("C", "p"): q * (1 - d) * (1 + t), ("C", "d"): -q * p * (1 + t), ("C", "t"): q * p * (1 - d)}
    assert {k: x for k, x in v.items() if k[0] != "U"} == {k: pytest.approx(x) for k, x in want.items()}
