"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belvane.operators import rules, verify
from belvane.plans.catalog import QUERIES
from belvane.sources.tables import materialise, shared_dir

HEADLINE = ("evaluate_definitions", "total_with_uncertainty", "decide_minimum", "set_parameter", "condition_by_information", "predict_update", "hash_chain", "affected_set", "clash_candidates", "verification_report", "mixture_responsibilities")


STOREY = {"Square": [(1, ("H", "H"))], "Cube": [(1, ("Square", "H"))]}


def timed(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def storeys(spark: SparkSession, n: int) -> dict[str, float]:
    """Seconds of a complete push-forward (means and covariances), of one after a change of one storey (its folder is read,
    it alone is evaluated and written), and of a verification, for ``n`` storeys."""
    slots = spark.range(n).select(F.lit(0).alias("model"), F.col("id").cast("string").alias("entity"), F.lit("H").alias("quantity"), (3 + F.col("id") * 1e-6).alias("mu"), F.lit(0.01).alias("sigma"))
    slots = materialise(slots)
    wide = rules.side_by_side(slots, ["H"])
    complete = timed(rules.covariance(rules.with_gradient(wide, STOREY), STOREY, list(STOREY)))
    before = materialise(rules.evaluated(wide, STOREY))
    top = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    rules.write_base(wide, STOREY, top)
    changed = spark.createDataFrame([(0, "7", 4.0)], "model int, entity string, H double")
    began = time.time()
    rules.write_overlay(spark, top, changed, STOREY, "local").collect()
    incremental = round(time.time() - began, 3)
    again = before.select("model", F.col("entity").alias("subject"), F.col("Cube").alias("value"), (F.col("H") * F.col("H") * F.col("H")).alias("again"))
    world = {"slots": slots.select("model", F.col("entity").alias("var_id"), "mu", "sigma"), "restatements": again}
    verification = timed(verify.report(verify.findings(world), slots.select("model").distinct()))
    return {"complete": complete, "incremental": incremental, "verification": verification}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    storeys(spark, 512)  # a warm-up
    model = {str(n): storeys(spark, n) for n in (512, 1024, 1536, 2048, 5792, 2_000_000)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "storeys": model, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
