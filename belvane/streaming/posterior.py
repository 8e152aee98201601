"""Readings that keep arriving: posteriors by sums of precisions, which no order of arrival changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.sources.tables import shared_dir


def precision_sums(readings: DataFrame, key: str) -> DataFrame:
    """``key``, n, w, wy: sums that add up over batches, from readings (y, r: the noise variance, above 0)."""
    return readings.where("r > 0").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("r")).alias("w"), F.sum(F.col("y") / F.col("r")).alias("wy"))


def posterior_of_stream(readings: DataFrame, key: str, prior_mu: float, prior_var: float) -> DataFrame:
    """``key``, n, mu, var after all that the stream ``readings`` has so far.

    Each micro-batch adds its partial sums as files named by the batch, so that a batch which is run again after a loss
    replaces its own files and counts once. The stream keeps no state; the partial sums are added when they are read.
    A stream that has brought nothing gives no rows.
    """
    spark = readings.sparkSession
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        precision_sums(batch, key).write.mode("overwrite").parquet(f"{top}/sums/batch={n}")

    put(spark.createDataFrame([], readings.schema), -1)  # so that there is a table to read
    run = readings.writeStream.foreachBatch(put).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    sums = spark.read.parquet(f"{top}/sums").groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "w", "wy")])
    precision = F.col("w") + 1 / prior_var
    return sums.select(key, "n", ((F.col("wy") + prior_mu / prior_var) / precision).alias("mu"), (1 / precision).alias("var"))
