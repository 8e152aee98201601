"""Operator 8: shards along a Hilbert curve, with DataFrame functions only.

Source, language and length of a document are quantised to a grid; the grid's cells are visited along a Hilbert curve,
so that files hold documents alike in all three and can be pruned by any. Runs of the order with near equal bytes are
the shards. Equal texts lie side by side, at the cell of the first of their sources and languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.llm._common import materialise, running

BITS = 6
AXES = ("__x", "__y", "__z")


def hilbert(df: DataFrame, axes: tuple[str, ...], bits: int, name: str) -> DataFrame:
    """``df`` with ``name``, the place along a Hilbert curve of the cell whose coordinates ``axes`` are (whole numbers
    below 2 ** bits); ``axes`` are used up. Each step of the rotation is a projection, so none is computed twice."""
    first = axes[0]
    for k in range(bits - 1, 0, -1):
        q, p = 1 << k, (1 << k) - 1
        for axis in axes:
            on = F.col(axis).bitwiseAND(q) != 0
            swap = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(p)
            new = {first: F.when(on, F.col(first).bitwiseXOR(F.lit(p))).otherwise(F.col(first).bitwiseXOR(swap))}
            if axis != first:
                new[axis] = F.when(on, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap))
            df = df.withColumns(new)
    for before, axis in zip(axes, axes[1:], strict=False):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0).cast("long")
    for k in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << k) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("__turn", turn)
    df = df.withColumns({axis: F.col(axis).bitwiseXOR(F.col("__turn")) for axis in axes})
    place: Column = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for axis in axes:
            place = place * 2 + F.shiftright(F.col(axis), k).bitwiseAND(1)
    return df.withColumn(name, place).drop("__turn", *axes)


def _cells(groups: DataFrame, value: str, name: str) -> DataFrame:
    """``groups`` with ``name``, the cell of ``value``: values are in order, and a cell is a 2 ** BITS th part of all bytes. So
    a file's least and greatest value tell which values it lacks, a frequent value has cells of its own, and rare neighbours
    share one."""
    each = groups.groupBy(value).agg(F.sum("group_size").alias("__bytes"))
    placed = running(materialise(each), [value], "__bytes").select(F.col(value).alias("__value"), F.least(F.floor(F.col("before") * (1 << BITS) / F.col("all_size")), F.lit((1 << BITS) - 1)).cast("long").alias(name))
    # Spark broadcasts the cells if their measured size is small, and else splits the rows of a frequent value
    return groups.join(placed, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def shard(docs: DataFrame, *, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, 0 for null, plus 1), text_crc32, law ("bytes"), shard, slot (0, 1, ... in
    each shard), grown_shard (null), curve (the place along the curve) and group_size for every row.

    The sum of sizes is cut into ``shards`` equal runs. Equal texts are in one shard, that in which they begin, so a shard
    may be larger than its part by less than a group; only a group that by itself is larger than a shard's part is cut.
    Ties are ordered by text, doc_id, source and language; rows equal in all of them may swap slots. A null text is taken as
    empty; a long one counts by its bytes and is in one shard. A null source or language comes last. Other columns are not
    read. An empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = materialise(docs.select("doc_id", "source", "lang", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("__text")))
    # the copies of a text are summed before they meet
    groups = materialise(slim.groupBy("__text").agg(F.min("source").alias("__source"), F.min("lang").alias("__lang"), F.min("size").alias("__one"), F.sum("size").alias("group_size")))
    cells = _cells(_cells(groups, "__source", "__x"), "__lang", "__y")
    cells = cells.select("__text", "group_size", "__x", "__y", F.least(F.floor(3.5 * F.log2(F.col("__one"))), F.lit((1 << BITS) - 1)).cast("long").alias("__z"))
    placed = materialise(hilbert(cells, AXES, BITS, "curve"))
    order = running(placed, ["curve", "__text"], "group_size").select(F.col("__text").alias("__t"), "curve", "group_size", F.col("before").alias("__group"))
    # Spark splits the rows of a large group over several tasks of this join
    ranked = running(slim.join(order, F.col("__text") == F.col("__t")), ["curve", "__text", "doc_id", "source", "lang"], "size")
    limit = F.col("all_size") / shards
    at = F.when(F.col("group_size") <= limit, F.col("__group")).otherwise(F.col("before"))
    cut = ranked.withColumn("shard", F.least(F.floor(at / limit), F.lit(shards - 1)).cast("int"))
    cut = materialise(cut.select("doc_id", "size", "text_crc32", "shard", "rank", "curve", "group_size"))
    first = cut.groupBy("shard").agg(F.min("rank").alias("__first"))
    # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "group_size"
    )
