"""Operator 6: sources mixed to target weights by Sainte-Laguë apportionment.

The words of a source lie on a line, document after document in a seeded order, cut into blocks of ``block`` words. All
blocks of the mix are seats: each goes to the source with the highest quotient target / (2k + 1), k being the seats it
has. The seats of shard 1, 2, ... are dealt one after the other, so each shard has an integer quota of each source. A
source's blocks are shuffled by a seed (what is left over, less than a block, comes last); shard after shard takes its
quota from that order, which begins anew when all blocks have been taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.llm._common import bound, materialise, n_words, running, with_row_id

#: Runs of a source that are summed apart and then put one after the other: no task gathers a source.
RUNS = 1024
#: Strides of the shuffle: primes, fixed values. One that doesn't divide the number of blocks visits each once.
STRIDES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def targets(sizes: DataFrame, *, cap: float = 3.0) -> DataFrame:
    """source, source_size, place (0, 1, ... by code point, null last) and target, from one row per source.

    Weights 1, 2, 3, 1, ... share the sum of all sizes; a source gets ``cap`` times its size at most, and what is over
    goes to the others by weight, again and again until none is above. Only sums come to the driver.
    """
    weighed = sizes.withColumn("missing", F.col("source").isNull()).withColumn("one", F.lit(1))
    placed = running(weighed, ["missing", "source"], "one")
    known = materialise(placed.select("source", F.col("source_size"), F.col("rank").alias("place"), (1 + F.col("rank") % 3).cast("double").alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, True
    while free:
        # the level only rises, so a source that is capped stays so
        capped, weights = known.agg(
            F.sum(F.when(F.col("weight") * level >= F.col("most"), F.col("most"))),
            F.sum(F.when(F.col("weight") * level < F.col("most"), F.col("weight"))),
        ).first()
        now = (total - (capped or 0)) / weights if weights else level
        free, level = bool(weights) and now > level, max(level, now)
    return known.select("source", "source_size", "place", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def quotas(wanted: DataFrame, blocks: int, shards: int) -> DataFrame:
    """source, shard (0 up to shards - 1), quota: Sainte-Laguë seats of each source, ``blocks`` in all.

    A divisor known to give too few seats gives most of them at once, and one known to give too many bounds the rest;
    only the quotients between the two, about two for each source, are sorted.
    """
    n = wanted.agg(F.count(F.lit(1)), F.sum("target")).first()
    sources, total = n[0], n[1] or 0.0
    houses = [blocks * (k + 1) // shards for k in range(shards)]

    def seats(divisor: float | None) -> Column:
        return F.floor((F.col("target") / divisor + 1) / 2) if divisor else F.lit(0).cast("long")

    each = []
    for k, m in enumerate(houses):
        few = total / (2 * m - sources) * (1 + 1e-9) if 2 * m > sources and total > 0 else None
        many = total / (2 * m + sources) * (1 - 1e-9) if total > 0 else None
        each.append(F.struct(F.lit(k).alias("shard"), F.lit(m).cast("long").alias("house"), seats(few).cast("long").alias("sure"), seats(many).cast("long").alias("most")))
    rows = wanted.select("source", "place", "target", F.inline(F.array(*each)))
    left = rows.groupBy("shard", "house").agg(F.sum("sure").alias("given")).select("shard", (F.col("house") - F.col("given")).alias("left"))
    open_ = rows.where("most > sure").select("source", "place", "target", "shard", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("k"))
    by = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") - 1)), "place", "k")
    won = open_.withColumn("nth", F.row_number().over(by)).join(F.broadcast(left), "shard").where("nth <= left").groupBy("shard", "place").agg(F.count(F.lit(1)).alias("more"))
    held = rows.join(won, ["shard", "place"], "left").select("source", "place", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("held"))
    before = F.coalesce(F.lag("held").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    return held.withColumn("quota", F.col("held") - before).select("source", "shard", "quota")


def shuffle(source: Column, blocks: Column, seed: int) -> tuple[Column, Column]:
    """``stride`` and ``shift`` of a source's order: block i is at place (i * stride + shift) mod blocks. The first of the
    strides, from a seeded one on, that doesn't divide the number of blocks; below 2 ** 43 blocks nothing overflows."""
    drawn = F.xxhash64(F.coalesce(source, F.lit("")), F.lit(seed + 1))
    turned = [F.get(F.lit(list(STRIDES)).cast("array<bigint>"), F.pmod(drawn + k, F.lit(len(STRIDES))).cast("int")) for k in range(len(STRIDES))]
    return F.coalesce(*[F.when(blocks % x != 0, x) for x in turned]), F.pmod(F.shiftright(drawn, 8), blocks)


def _taken(docs: DataFrame, keys: list[str], seed: int, block: int, shards: int, cap: float) -> DataFrame:
    slim = docs.select(*keys, "source", F.col("doc_id").alias("__id"), n_words(F.col("text")).alias("size"))
    slim = materialise(slim.withColumn("__key", F.xxhash64(F.coalesce(F.col("__id"), F.lit(-1)).cast("long"), F.lit(seed))).withColumn("__run", F.pmod("__key", F.lit(RUNS)).cast("int")))
    runs = materialise(slim.groupBy("source", "__run").agg(F.sum("size").alias("__size")))
    wanted = materialise(targets(runs.groupBy("source").agg(F.sum("__size").alias("source_size")), cap=cap))
    total = wanted.agg(F.sum("source_size")).first()[0] or 0
    # the seats of a source after each shard: ``shards`` numbers
    dealt = quotas(wanted, max(1, round(total / block)), shards).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    seats = dealt.select("source", F.transform("q", lambda x: F.aggregate(F.filter("q", lambda y: y["shard"] <= x["shard"]), F.lit(0).cast("long"), lambda n, y: n + y["quota"])).alias("held"))
    n, blocks = F.greatest(F.col("source_size"), F.lit(1)), F.greatest(F.floor(F.col("source_size") / block), F.lit(1)).cast("long")
    stride, shift = shuffle(F.col("w.source"), blocks, seed)
    words = lambda held: F.least(held * block, F.floor(F.col("source_size") * cap).cast("long"))
    passes = F.transform("held", lambda held: F.struct(F.floor(words(held) / n).cast("long").alias("whole"), (words(held) % n).cast("long").alias("rest")))
    plan = wanted.alias("w").join(seats.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source"))).select(F.col("w.source").alias("__source"), "source_size", "target", passes.alias("__held"), blocks.alias("__blocks"), stride.alias("__stride"), shift.alias("__shift"))
    up_to = Window.partitionBy("source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # one row per source and run: RUNS rows of a source at most
    offsets = runs.withColumn("__before", F.coalesce(F.sum("__size").over(up_to), F.lit(0))).alias("r").join(plan, F.col("r.source").eqNullSafe(F.col("__source"))).drop("source", "__size").withColumnRenamed("__run", "__r")
    inside = Window.partitionBy("source", "__run").orderBy("__key", F.col("__id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("__own", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__run") == F.col("__r")))
    joined = joined.withColumn("__a", F.col("__before") + F.col("__own")).withColumn("__b", F.col("__a") + F.col("size"))
    first, last = F.floor(F.col("__a") / block), F.floor((F.col("__b") - 1) / block)

    def piece(i: Column) -> Column:
        """Where the row's words in block i lie in the shuffled order, and how many they are."""
        inside = F.greatest(F.col("__a") - i * block, F.lit(0))
        here = F.least(F.col("__b") - i * block, F.lit(block)) - inside
        shuffled = (i * F.col("__stride") + F.col("__shift")) % F.col("__blocks")
        return F.struct((F.when(i < F.col("__blocks"), shuffled).otherwise(i) * block + inside).alias("at"), here.alias("n"))

    def up_to_shard(pieces: Column) -> Column:
        zero = F.lit(0).cast("long")
        rest = lambda held: F.aggregate(pieces, zero, lambda n, p: n + F.least(F.greatest(held["rest"] - p["at"], zero), p["n"]))
        return F.transform("__held", lambda held: held["whole"] * F.col("size") + rest(held))

    pieces = F.when(F.col("size") > 0, F.transform(F.sequence(first, last), piece)).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>"))
    words = bound(pieces, up_to_shard)
    by_shard = F.transform("__sums", lambda n, k: n - F.when(k > 0, F.get("__sums", k - 1)).otherwise(F.lit(0).cast("long")))
    return joined.withColumn("__sums", words).withColumns({"taken": F.element_at("__sums", -1), "by_shard": by_shard})


def mix(docs: DataFrame, *, seed: int = 13, block: int = 16, shards: int = 8, cap: float = 3.0) -> DataFrame:
    """doc_id, source, size (words), source_size, target (of its source), taken (words the mix takes, repeats counted) and
    by_shard (how many of them go to each shard, joined by commas) for every row.

    A null text has no words; a text of any length is read whole. A null source is one source, the last. Repeated rows each
    count and come back; rows that are equal in doc_id, source and size may swap what is taken. Sources whose quotients tie
    are ordered by code point. If no text has a word, nothing is taken. Other columns are not read. An empty table gives no
    rows.
    """
    found = _taken(docs, ["doc_id"], seed, block, shards, cap)
    return found.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", F.array_join(F.col("by_shard").cast("array<string>"), ",").alias("by_shard"))


def repeat(docs: DataFrame, *, seed: int = 13, block: int = 16, shards: int = 8, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with all their columns: a row comes back as often as taken / size,
    rounded half up. A text without words, or a null one, isn't taken; repeated rows each count; columns whatever their names
    stay as they are. An empty table gives no rows."""
    named = with_row_id(docs)
    read = named.select("file", "at", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = _taken(read, ["file", "at"], seed, block, shards, cap)
    times = found.select("file", "at", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int").alias("times")).where("times > 0")
    return named.join(times, ["file", "at"]).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
