"""What queries shuffle, seen in their plans: no row for each factor, quantity or pair where a line has all side by side."""

from __future__ import annotations

import pytest

from belvane.operators import rules
from belvane.plans import checks, fleet, models, records  # noqa: F401  (they register their queries)
from belvane.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_neighbours_go_to_their_model_once(spark):
    df = QUERIES["cross_entity_covariance"](spark, DIR)
    assert exchanges(df) == 1 and "Generate" not in plan_of(df)
    net = {"Net": [(1, ("Q", "Fx")), (1, ("Fx",))]}
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0), (2, 1, 5.0)], "model int, k int, Q double").selectExpr("*", "0.5D s_Q", "2D Fx", "0.1D s_Fx")
    found = rules.neighbour_covariances(rules.with_gradient(rows, net), net, "Net", ["Fx"], ["k"])
    # by hand: (Q + 1) (Q' + 1) 0.01, and (2 * 0.5)^2 + ((Q + 1) 0.1)^2
    assert [(r["model"], r["place"], pytest.approx(r["cov"]), pytest.approx(r["var_a"]), pytest.approx(r["var_b"])) for r in found.orderBy("place").collect()] == [(1, 1, 0.12, 1.09, 1.16), (1, 2, 0.20, 1.16, 1.25)]


def test_scaled_lines_are_met_once(spark):
    df = QUERIES["scale_parameter"](spark, DIR)
    assert exchanges(df) <= 3 and "Generate" not in plan_of(df)


@pytest.mark.parametrize("name, most", [("change_impact", 3), ("compliance_margins", 0), ("computational_equivalence", 3)])
def test_terms_are_evaluated_where_the_line_is(spark, name, most):
    df = QUERIES[name](spark, DIR)
    assert exchanges(df) <= most and "Generate" not in plan_of(df)


def test_like_terms_cancel():
    nested = {"Gross": [(1, ("Q", "P"))], "Net": [(1, ("Gross",)), (-1, ("Gross", "D"))]}
    assert rules.multiplied_out(nested, "Net") == [(1.0, ("P", "Q")), (-1.0, ("D", "P", "Q"))]
    assert rules.margin(nested, "Gross", "Net") == {"Margin": [(1.0, ("D", "P", "Q"))]}
    assert rules.margin(nested, "Gross", "Gross") == {"Margin": []}


def test_boxes_are_not_gathered_on_the_driver(spark):
    """A part's file is small, its boxes and their derivatives are not: they are joined by shuffles."""
    df = QUERIES["clearance_risks"](spark, DIR)
    assert "Broadcast" not in plan_of(df)


def test_hierarchies_need_no_levels(spark, monkeypatch):
    from belvane.operators import dag, verify

    def no(*_):
        raise AssertionError("levels of a tree")

    tree = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "x")], "parent string, child string")
    with monkeypatch.context() as m:
        m.setattr(dag, "levels", no)
        assert dag.on_cycles(tree).count() == 0
    # a cycle of b and c, what leads to it and what lies behind it, at any depth
    ring = tree.union(spark.createDataFrame([("b", "c"), ("c", "b"), ("x", "y"), ("y", "z"), ("a", "w")], tree.schema))
    assert sorted(r["node"] for r in dag.on_cycles(ring).collect()) == ["b", "c", "x", "y", "z"]
    rel = spark.createDataFrame([(1, "contains", "a", None), (1, "contains", "a", "b"), (2, "contains", "a", "b")], "model int, kind string, source string, target string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "model int, node string")
    assert sorted((r["model"], r["subject"]) for r in verify.both_ends({"rel": rel, "nodes": nodes}).collect()) == [(1, "contains a"), (2, "contains a b")]


@pytest.mark.parametrize("name", ["belief_sizes", "digest_changes"])
def test_rows_are_dealt_to_as_many_tasks_as_the_session_has(spark, name):
    plan = plan_of(QUERIES[name](spark, DIR))
    assert "REPARTITION_BY_COL" in plan and ", 7)" not in plan


def test_leaves_are_not_digested_in_one_task(spark, monkeypatch, tmp_path):
    from pyspark.sql.classic.dataframe import DataFrame

    from belvane.sources import snapshots

    own = DataFrame.coalesce

    def checked(df, n):
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
        return own(df, n)

    monkeypatch.setattr(DataFrame, "coalesce", checked)
    rows = spark.range(100).selectExpr("id", "id * 2 as v")
    assert snapshots.write(rows, ["id"], f"{tmp_path}/a", depth=2) == snapshots.write(rows.repartition(3), ["id"], f"{tmp_path}/b", depth=2)


def test_affinity_counts_places_without_sets(spark):
    from belvane.operators import graph

    seen = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (None, "a"), (None, "b")], "place int, node string")
    df = graph.affinity(seen)
    assert [tuple(r) for r in df.collect()] == [("a", "b", 0.5, 2)] and "distinct" not in plan_of(df)


def test_ends_are_looked_up_in_tasks_that_are_not_merged(spark):
    """Spark merged the tasks of these joins by their packed bytes, until one sorted more than a GB."""
    from belvane.operators import graph

    plan = plan_of(QUERIES["dangling_edges"](spark, DIR))
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") >= plan.count("LeftAnti") > 0
    rel = spark.createDataFrame([("k", "a", "b"), ("k", "a", "x"), ("k", None, "b"), ("k", "y", "z")], "kind string, source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "node string")
    found = sorted((str(r["source"]), r["target"], r["end"]) for r in graph.dangling(rel, nodes).collect())
    assert found == [("None", "b", "source"), ("a", "x", "target"), ("y", "z", "source"), ("y", "z", "target")]


def test_variables_are_told_in_the_line(spark):
    assert exchanges(QUERIES["free_variables"](spark, DIR)) == 1
    twice = {"Gross": [(1, ("Q", "P")), (1, ("Q", "F"))], "Net": [(1, ("Gross",)), (-1, ("Gross", "D"))], "None": [(1, ())]}
    found = rules.free_variables(spark.createDataFrame([(1, "e")], "model int, entity string"), twice, ["F"]).collect()
    assert {r["quantity"]: r["variables"] for r in found} == {"Gross": ["*.F", "e.P", "e.Q"], "Net": ["*.F", "e.D", "e.P", "e.Q"], "None": []}


def test_lines_are_listed_where_they_are(spark):
    from belvane.operators import lowering

    assert "Exchange" not in plan_of(QUERIES["state_listing"](spark, DIR))
    slots = spark.createDataFrame([("e", "Qty", 1234567.0, 0.5), ("e", "Disc", None, 0.1)], "entity string, quantity string, mu double, sigma double")
    rows = spark.createDataFrame([("e", 1234567.0, 0.5, None, 0.1)], "entity string, Qty double, s_Qty double, Disc double, s_Disc double")
    assert lowering.listed_rows(rows, ["entity"], ["Qty", "Disc"]).collect() == lowering.listed(slots, ["entity"]).collect()


def test_constraints_are_told_in_the_line(spark):
    from belvane.operators import ingest

    assert exchanges(QUERIES["constraint_rows"](spark, DIR)) == 1
    slots = spark.createDataFrame([(1, "e", "Qty"), (1, "e", "Disc")], "model int, entity string, quantity string")
    args = [("Disc", "Qty"), ("Fx", "Qty")], ["Disc", "Price"]
    found = ingest.constraints_of_kind(slots.select("model", "entity").distinct(), ["Qty", "Disc"], *args)
    assert sorted(map(str, found.collect())) == sorted(map(str, ingest.constraints(slots, *args).collect())) and found.count() == 4


def test_correlations_are_within_the_row(spark):
    from belvane.operators import belief

    df = QUERIES["correlations"](spark, DIR)
    assert exchanges(df) == 0
    net = {"G": [(1, ("Q", "P"))], "N": [(1, ("G",)), (-1, ("G", "D"))], "Z": [(0, ("Q",))]}
    rows = spark.createDataFrame([(1, "e", 2.0, 0.5, 3.0, 0.1, 0.5, 0.2)], "model int, entity string, Q double, s_Q double, P double, s_P double, D double, s_D double")
    rows = rules.with_gradient(rows, net)
    told = lambda df: sorted((r["i"], r["j"], pytest.approx(r["cov"]), pytest.approx(r["corr"])) for r in df.collect())
    want = belief.correlations(rules.covariance(rows, net, list(net)), ["model", "entity"])
    assert told(rules.correlations(rows, net, list(net))) == [(r["i"], r["j"], r["cov"], r["corr"]) for r in want.orderBy("i", "j").collect()]


def test_deviations_are_judged_in_the_line(spark):
    from belvane.operators import lowering

    assert exchanges(QUERIES["sigma_policy"](spark, DIR)) == 1
    slots = spark.createDataFrame([(1, "a", "Q", 2.0, 0.1, 0.3), (1, "b", "Q", 2.0, None, 0.3), (1, "c", "P", -2.0, None, None), (1, "d", "Q", 2.0, None, None), (2, "a", "T", 2.0, None, None)], "model int, var_id string, quantity string, mu double, p double, s double")
    side = lambda c: slots.where(f"{c} is not null").select("model", "var_id", slots[c].alias("sigma"))
    defaults = spark.createDataFrame([("Q", 0.5)], "quantity string, sigma double")
    bare = slots.drop("p", "s")
    want = sorted(tuple(r) for r in lowering.sigma_policy(bare, side("p"), side("s"), defaults, {"P": 0.5}).collect())
    assert want == sorted(tuple(r) for r in lowering.judged_sigma(slots, "p", "s", defaults, {"P": 0.5}).drop("p", "s").collect())
    assert [r[4:] for r in want] == [(0.1, "POSTERIOR"), (0.3, "STATED"), (1.0, "RELATIVE"), (0.5, "DEFAULT"), (None, "REJECTED")]


def test_steps_are_composed_in_the_row(spark, monkeypatch):
    from belvane.operators import verify

    def no(*_):
        raise AssertionError("written")

    with monkeypatch.context() as m:
        m.setattr(models, "materialise", no)
        assert "ObjectHashAggregate" not in plan_of(QUERIES["composite_change"](spark, DIR))
    rows = spark.createDataFrame([(1, "a", 2.0, [(2, "scale", 3.0), (1, "shift", 1.0)]), (1, "b", 2.0, []), (2, "c", 2.0, None), (2, "d", 2.0, [(0, "shift", None)]), (2, "e", 2.0, [(0, "set", 5.0), (1, "other", 9.0)])], "model int, entity string, mu double, steps array<struct<seq int, op string, value double>>")
    before = rows.drop("steps")
    want = verify.composite(before, rows.selectExpr("model", "entity", "inline(steps)"), ["model", "entity"])
    assert sorted(map(tuple, verify.composite_rows(rows, "steps").collect())) == sorted(map(tuple, want.collect())) == [(1, "a", 9.0), (1, "b", 2.0), (2, "c", 2.0), (2, "d", 2.0), (2, "e", 5.0)]


def test_observation_rows_are_told_in_the_line(spark):
    from belvane.operators import belief

    assert exchanges(QUERIES["observation_rows"](spark, DIR)) == 1
    net = {"G": [(1, ("Q", "P"))]}
    rows = rules.with_gradient(spark.createDataFrame([(1, "e", 2.0, 3.0)], "model int, entity string, Q double, P double"), net)
    found = [tuple(r) for r in rules.observation_rows(rows, net, ["G", "P"]).collect()]
    assert found == [(1, "e", "G", "P", 2.0), (1, "e", "G", "Q", 3.0), (1, "e", "P", "P", 1.0)]
    j = spark.createDataFrame([(1, "e.G", "e.P", 2.0), (1, "e.G", "e.Q", 3.0)], "model int, out_var string, var_id string, v double")
    raw = spark.createDataFrame([(1, "e.P"), (1, "e.Q")], "model int, var_id string")
    want = belief.observation_rows(j, raw, raw.limit(1).union(j.select("model", "out_var")))
    assert sorted((r["var_id"], r["raw"], r["h"]) for r in want.collect()) == [(f"{e}.{q}", f"{e}.{r}", h) for _, e, q, r, h in found]


def test_far_means_need_no_draw(spark):
    from pyspark.sql import functions as F

    from belvane.operators import decision

    slots = spark.range(400).selectExpr("1 as model", "concat('v', id) as var_id", "CASE WHEN id = 7 THEN NULL ELSE id / 40D - 1 END as mu", "CASE WHEN id = 9 THEN NULL WHEN id % 2 = 0 THEN 0.5D ELSE -0.5D END as sigma")
    keyed = lambda df: sorted(map(str, df.select("var_id", "sample", "bad").collect()))
    found = decision.sampled_negatives(slots, 20, 7)
    assert keyed(found) == keyed(decision.samples(slots, 20, 7).withColumn("bad", F.col("mu") < 0))
    assert found.where("bad").count() > 50 and found.where("not bad").count() > 50
    low = decision._normal(F.lit("0" * 12 + "8" + "0" * 19))  # the farthest draw
    assert -decision.REACH < spark.range(1).select(low.alias("z")).first()["z"] < -8
    assert "md5" in plan_of(found) and "CASE WHEN" in plan_of(found).split("md5")[0].splitlines()[-1]


def test_attached_pairs_are_dealt_to_tasks_that_are_not_merged(spark):
    plan = plan_of(QUERIES["attached_properties"](spark, DIR))
    assert "REPARTITION_BY_NUM" in plan and "collect_list" not in plan


def test_a_version_tells_its_parts(spark, tmp_path):
    assert plan_of(QUERIES["overlaid_values"](spark, DIR)).count("Join") == 1
    net = {"G": [(1, ("Q", "P"))]}
    wide = spark.createDataFrame([(1, "a", 2.0, 3.0), (1, "b", 4.0, 5.0)], "model int, entity string, Q double, P double")
    rules.write_base(wide, net, str(tmp_path), buckets=4)
    rules.write_overlay(spark, str(tmp_path), spark.createDataFrame([(1, "b", 1.0)], "model int, entity string, Q double"), net, "x", buckets=4)
    found = rules.read_version(spark, str(tmp_path), "x", part="part").select("entity", "G", "part")
    assert sorted(map(tuple, found.collect())) == [("a", 6.0, "base"), ("b", 5.0, "overlay")]
    assert {r["part"] for r in rules.read_version(spark, str(tmp_path), part="part").collect()} == {"base"}


def test_few_texts_are_held_at_a_time():
    """Of a batch of ten thousand texts, all shingles were held at once in each task."""
    import pyarrow as pa

    from belvane.llm import ngram_join

    n = 2 * ngram_join.ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"a b c d e {k % 7}" for k in range(n)])], ["at", "text"])
    made = list(ngram_join._names(iter([batch]), 5))
    assert [b.num_rows for b in made] == [ngram_join.ROWS, ngram_join.ROWS, 1] and pa.Table.from_batches(made)["at"].to_pylist() == list(range(n))
    assert list(ngram_join._names(iter([batch.slice(0, 0)]), 5)) == [] and pa.Table.from_batches(made)["n"].to_pylist() == [2] * n


def test_python_tasks_get_few_texts_at_a_time_and_no_pandas(spark):
    """The stages that read texts in Python send them in small batches, and the classifier's workers import no pandas."""
    import subprocess
    import sys

    import pyarrow as pa

    from belvane.llm import _common, bpe, ngram_join, quality_classifier, simhash

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(k, f"text number {k} of some words") for k in range(3)], "doc_id long, text string")
    asked = spark.conf.get(key)
    try:
        for stage in (quality_classifier.keep_good, simhash.keep_one, ngram_join.keep_one, bpe.encode, bpe.encode_digests):
            spark.conf.set(key, "10000")
            stage(docs)
            assert int(spark.conf.get(key)) == _common.BATCH
        got = [r["n"] for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 2500 and max(got) <= _common.BATCH
        spark.conf.set(key, "7")
        assert _common.in_small_batches(docs) is docs and spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, asked)
    said = subprocess.run([sys.executable, "-c", "import sys, belvane.llm.quality_classifier; print('pandas' in sys.modules)"], capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "False"
