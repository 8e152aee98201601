"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.sources.tables import materialise, shared_dir  # noqa: F401  (operators take these from here)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows that go to a Python task at once.
BATCH = 1024


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends ``BATCH`` rows at a time to Python tasks from now on, if it did not send fewer. Spark's
    10,000 are some 35 MB of texts, which each task holds in the JVM's buffers (twice, while these grow) and again in Python."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return docs


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_row_id(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``, so that no name clashes), and ``file`` and ``at``, which together name a row of its
    Parquet files. ``select("row.*")`` gives the rows back.

    A frame that isn't read from files is written first, since an id must be the same each time it is computed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select(row, F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at"))
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] not in ("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "MISSING_ATTRIBUTES"):
            raise
    return with_row_id(materialise(docs))


def running(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... over the whole order), ``before`` (the sum of ``size`` before the row) and the
    sums over all rows, ``all_rows`` and ``all_size``.

    The order is cut into ranges, sorted and summed range by range; only one row per range meets in a single task.
    ``order`` should be total, else rows that tie may change places. ``df`` must be cheap to read again.
    """
    ranged = materialise(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__s"))
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(up_to), F.lit(0)).alias("__s0"),
        F.sum("__n").over(whole).alias("all_rows"),
        F.sum("__s").over(whole).alias("all_size"),
    )
    own = ranged.withColumns({"__i": F.row_number().over(inside) - 1, "__sum": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)})
    # one row per range partition: at most spark.sql.shuffle.partitions rows
    joined = own.join(F.broadcast(parts), "__part")
    return joined.withColumns({"rank": F.col("__n0") + F.col("__i"), "before": F.col("__s0") + F.col("__sum")}).drop("__part", "__n0", "__s0", "__i", "__sum")


#: Steps that a fold makes before its results are put behind the earlier ones.
FOLD = 256


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it: inside a lambda function, Spark shares no expressions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states (of SQL type ``kind``) after each item, from ``start``, by step(state, item).

    A fold that appends to one array copies it at every step; here ``FOLD`` states are gathered at a time, and the runs
    are joined at the end, so that the work grows with the number of items."""
    none, runs = f"array<{kind}>", f"array<array<{kind}>>"

    def over(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda j: F.slice(all_, j * FOLD + 1, FOLD))

        def run(acc: Column, part: Column) -> Column:
            zero = F.struct(acc["last"].alias("last"), F.array().cast(none).alias("out"))

            def one(a: Column, x: Column) -> Column:
                return bound(step(a["last"], x).cast(kind), lambda y: F.struct(y.alias("last"), F.concat(a["out"], F.array(y)).alias("out")))

            return bound(F.aggregate(part, zero, one), lambda r: F.struct(r["last"].alias("last"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        return F.flatten(F.aggregate(cut, F.struct(start.cast(kind).alias("last"), F.array().cast(runs).alias("out")), run, lambda acc: acc["out"]))

    return bound(items, lambda all_: F.when(F.size(all_) > 0, over(all_)).otherwise(F.array().cast(none)))
