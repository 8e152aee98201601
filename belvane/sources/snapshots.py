"""Versions of tables with an integrity digest, as a tree over ranges of key hashes.

A row falls into one of 16 ** depth leaves by the hash of its key. A leaf's digest is that of its rows in order, an inner
node's that of its 16 children, the root's that of the version. Two versions are compared from the root down, along nodes
that differ alone, and only the leaves that differ are read. Rows lie in folders by the first two levels.

What a leaf tells lies in folder -1: its digest, and one of each of its parts, some 8 to 16 rows by the first bits of their
keys' hashes. Of a leaf that differs only the rows of parts that differ are met with one another. Rows are stored without
digests; these are made anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16
_META = ("leaf", "folder", "row_digest", "leaf_rows", "leaf_digest", "leaf_parts")
#: A part is told by so many first bits of its key's hash at most; a version has so many parts at most, all leaves together.
_BITS, _MOST_PARTS = 12, 1 << 24
_LEAVES = "leaf long, leaf_rows long, leaf_digest string, leaf_parts array<binary>"


def _row_digest(columns: list[str]) -> Column:
    """A digest of all columns; each part comes with its length, a null one with a dash, so none can be read as two."""
    text = {c: F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("{}")) for c in columns}
    return F.sha2(F.concat_ws("|", *[x for c in columns for x in (F.lit(c), F.length(text[c]).cast("string"), text[c])]), 256)


def _leaves(rows: DataFrame) -> DataFrame:
    """leaf, rows, digest: a leaf's rows are in the order of their digests, repeats included."""
    lines = F.array_sort(F.collect_list("row_digest"))
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _own(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in _META]


def _first_bits(keys: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - _BITS)


def _leaf_of(most: int) -> Callable:
    """For a leaf's rows (leaf, bits, row_digest): their number and digest as ``_leaves`` tells them, and the digests of the
    leaf's parts, whose number is a power of two up to ``most``."""

    def told(t):
        import hashlib

        import pyarrow as pa

        t = t.sort_by("row_digest")
        lines = t["row_digest"].to_pylist()
        n = min(1 << max((len(lines) // 8).bit_length() - 1, 0), most)
        parts = [hashlib.sha256() for _ in range(n)]
        for bits, line in zip(t["bits"].to_pylist(), lines, strict=True):
            parts[bits * n >> _BITS].update(line)
        whole = hashlib.sha256("\n".join(x.hex() for x in lines).encode()).hexdigest()
        found = {"leaf": (t["leaf"][0].as_py(), pa.int64()), "leaf_rows": (len(lines), pa.int64()), "leaf_digest": (whole, pa.string()), "leaf_parts": ([x.digest() for x in parts], pa.list_(pa.binary()))}
        return pa.table({name: pa.array([v], kind) for name, (v, kind) in found.items()})

    return told


def _tree(leaves: DataFrame, depth: int) -> DataFrame:
    """level, node, rows, digest from the leaves (level ``depth``) to the root (level 0, node 0)."""
    level = leaves.select(F.lit(depth).alias("level"), F.col("leaf").alias("node"), "rows", "digest")
    all_ = level
    for k in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FAN at most
        line = F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), "\n")
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(line, 256).alias("digest")).select(F.lit(k).alias("level"), "node", "rows", "digest")
        all_ = all_.unionByName(level)
    return all_


def sequence_faults(events: DataFrame, key: str) -> DataFrame:
    """``key``, events, fault of logs (key, seq) whose sequence isn't 0, 1, ... without gaps and repeats."""
    found = events.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum(F.col("seq").cast("decimal(38,0)")).alias("total"), F.count("seq").alias("given"))
    n = F.col("events").cast("decimal(20,0)")
    fault = F.when((F.col("given") < F.col("events")) | (F.col("lo") != 0), "BEGINNING").when(F.col("hi") != F.col("events") - 1, "GAP").when(F.col("total") * 2 != n * (n - 1), "REPEATED")
    return found.select(key, "events", fault.alias("fault")).where("fault is not null")


def _kept(rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The rows with leaf and folder, and in folder -1 what their leaves tell. Rows are shuffled once, and without digests: both
    sides of the union read the same shuffle."""
    dealt = rows.withColumn("leaf", F.pmod(F.xxhash64(*keys), F.lit(FAN**depth)).cast("long")).repartition("leaf")
    lines = dealt.select("leaf", _first_bits(keys).cast("int").alias("bits"), F.unhex(_row_digest(rows.columns)).alias("row_digest"))
    most = min(1 << _BITS, max(_MOST_PARTS // FAN**depth, 1))
    leaves = lines.groupBy("leaf").applyInArrow(_leaf_of(most), _LEAVES).withColumn("folder", F.lit(-1).cast("long"))
    return dealt.withColumn("folder", F.floor(F.col("leaf") / FAN ** max(depth - 2, 0))).unionByName(leaves, allowMissingColumns=True)


def write(rows: DataFrame, keys: list[str], top: str, *, depth: int = 3, log: tuple[str, str] | None = None) -> str:
    """Writes a version to the new folder ``top`` and returns its digest. A leaf must fit a task: with ``depth`` levels there are
    16 ** depth of them. ``log`` names the key and number of a log, which must have no gaps; if it has, nothing is written."""
    if log:
        faults = sequence_faults(rows.select(F.col(log[0]), F.col(log[1]).alias("seq")), log[0])
        bad = faults.limit(3).collect()
        if bad:
            raise ValueError(f"not a sequence: {[(r[0], r['fault']) for r in bad]}")
    clash = [c for c in rows.columns if c in _META]
    if clash:
        raise ValueError(f"columns named as the snapshot's own: {clash}")
    kept = _kept(rows, keys, depth)
    kept.where("false").drop("leaf_rows", "leaf_digest", "leaf_parts").coalesce(1).write.parquet(f"{top}/schema")  # also a version without rows has columns
    kept.write.partitionBy("folder").option("compression", "zstd").parquet(f"{top}/rows")
    spark = rows.sparkSession
    _tree(_told(spark, top).select("leaf", F.col("leaf_rows").alias("rows"), F.col("leaf_digest").alias("digest")), depth).repartition(1).write.parquet(f"{top}/tree")
    return digest(spark, top)


def _rows(spark: SparkSession, top: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{top}/schema").schema).parquet(f"{top}/rows").where("folder >= 0")


def _told(spark: SparkSession, top: str) -> DataFrame:
    return spark.read.schema(f"{_LEAVES}, folder long").parquet(f"{top}/rows").where("folder = -1")


def digest(spark: SparkSession, top: str) -> str | None:
    """The digest of a version; None for one without rows."""
    root = spark.read.parquet(f"{top}/tree").where("level = 0").first()
    return root["digest"] if root else None


def read(spark: SparkSession, top: str) -> DataFrame:
    return _rows(spark, top).drop(*_META)


def damaged(spark: SparkSession, top: str) -> DataFrame:
    """level, node of the tree that the rows, read and digested anew, don't fit: a changed value, a row too many or too few, or
    a changed tree."""
    tree = spark.read.parquet(f"{top}/tree")
    depth = tree.agg(F.max("level")).first()[0] or 0
    rows = _rows(spark, top)
    again = _tree(_leaves(rows.withColumn("row_digest", _row_digest(_own(rows)))), depth)
    joined = tree.alias("a").join(again.alias("b"), ["level", "node"], "full")
    return joined.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.rows").eqNullSafe(F.col("b.rows"))).select("level", "node")


def changed_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """The leaves in which two versions of equal depth differ. Each level reads the children of nodes that differ; they are few
    if little has changed, and 16 ** depth at most."""
    a, b = (spark.read.parquet(f"{t}/tree") for t in (old, new))
    depth = max(t.agg(F.max("level")).first()[0] or 0 for t in (a, b))
    nodes = [0]
    for level in range(depth + 1):
        x, y = (t.where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        nodes = [r["node"] for r in x.join(y, "node", "full").where("not x <=> y").collect()]
        if not nodes or level == depth:
            return sorted(nodes)
        nodes = [n * FAN + k for n in nodes for k in range(FAN)]
    return []


def _changed_parts(spark: SparkSession, old: str, new: str, leaves: list[int]) -> DataFrame:
    """leaf, __differs: for each of a leaf's parts whether its digest differs. A leaf that isn't divided alike differs as a
    whole. There are 2 ** 24 parts at most."""
    x, y = (_told(spark, t).where(F.col("leaf").isin(leaves)).select("leaf", F.col("leaf_parts").alias(n)) for t, n in ((old, "x"), (new, "y")))
    alike = F.size("x") == F.size("y")
    return x.join(y, "leaf", "full").select("leaf", F.when(alike, F.zip_with("x", "y", lambda a, b: a != b)).otherwise(F.array(F.lit(True))).alias("__differs"))


def changes(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """``keys`` and change (ADDED, REMOVED, CHANGED) of the rows in which two versions differ; only folders and leaves that
    differ are read, and of these only parts that differ are met. Rows that repeat a key count as changed if their numbers or
    values differ."""
    leaves = changed_leaves(spark, old, new)
    depth = spark.read.parquet(f"{new}/tree").agg(F.max("level")).first()[0] or 0
    folders = sorted({n // FAN ** max(depth - 2, 0) for n in leaves})
    parts = F.broadcast(_changed_parts(spark, old, new, leaves))
    place = F.shiftright(_first_bits(keys) * F.size("__differs"), _BITS).cast("int")
    no_key = F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys])  # a key with a null meets none

    def side(top: str, name: str) -> DataFrame:
        rows = _rows(spark, top).where(F.col("folder").isin(folders) & F.col("leaf").isin(leaves))
        met = rows.join(parts, "leaf", "left").where(no_key | F.coalesce(F.get("__differs", place), F.lit(True)))
        return met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.unhex(_row_digest(_own(rows))))).alias(name))

    both = side(old, "__x").join(side(new, "__y"), keys, "full").where("not __x <=> __y")
    return both.select(*keys, F.when(F.col("__x").isNull(), "ADDED").when(F.col("__y").isNull(), "REMOVED").otherwise("CHANGED").alias("change"))
