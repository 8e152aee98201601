"""From entities and their quantities to complete, checked models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belvane.functions.scalars import significant


def missing(entities: DataFrame, required: DataFrame, slots: DataFrame) -> DataFrame:
    """model, entity, quantity: what ``required`` (class, quantity) asks of ``entities`` (model, entity, class) and
    ``slots`` (model, entity, quantity) lacks. Two models may name an entity alike; slots without a model are of entities whose names are
    one model's only."""
    keys = [k for k in ("model", "entity", "quantity") if k in slots.columns]
    return entities.join(required, "class").join(slots.select(*keys), keys, "left_anti").select("model", "entity", "quantity")


def audit(entities: DataFrame, required: DataFrame, slots: DataFrame) -> DataFrame:
    """``entities`` (model, entity, class, blocked, has_geometry) with ``n_missing`` and a status.

    BLOCKED comes first; what lacks a quantity is NEEDS_GEOMETRY if there is a shape to derive it from, else MISSING; the
    rest is READY.
    """
    n = missing(entities, required, slots).groupBy("model", "entity").agg(F.count(F.lit(1)).alias("n_missing"))
    found = entities.join(n, ["model", "entity"], "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    status = F.when(F.col("blocked"), "BLOCKED").when((F.col("n_missing") > 0) & F.col("has_geometry"), "NEEDS_GEOMETRY").when(F.col("n_missing") > 0, "MISSING")
    return found.withColumn("status", status.otherwise("READY"))


def summary(audited: DataFrame) -> DataFrame:
    """model, a count by status, and pipeline_ready: whether all of its entities are READY."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    found = audited.groupBy("model").agg(*[count(s) for s in ("READY", "NEEDS_GEOMETRY", "MISSING", "BLOCKED")])
    return found.withColumn("pipeline_ready", (F.col("needs_geometry") + F.col("missing") + F.col("blocked")) == 0)


def sigma_policy(slots: DataFrame, posterior: DataFrame, stated: DataFrame, defaults: DataFrame, relative: dict[str, float]) -> DataFrame:
    """``slots`` (model, var_id, quantity, mu) with ``sigma`` and the ``policy`` that it is from.

    A posterior (model, var_id, sigma) comes before a stated uncertainty (model, var_id, sigma), that before a share of the
    mean by quantity, and that before the default of the quantity (quantity, sigma). A quantity with none is REJECTED. Two
    models may name a variable alike.
    """
    told = slots.join(posterior.select("model", "var_id", F.col("sigma").alias("__p")), ["model", "var_id"], "left").join(stated.select("model", "var_id", F.col("sigma").alias("__s")), ["model", "var_id"], "left")
    return judged_sigma(told, "__p", "__s", defaults, relative).drop("__p", "__s").select(*slots.columns, "sigma", "policy")


def judged_sigma(slots: DataFrame, posterior: str, stated: str, defaults: DataFrame, relative: dict[str, float]) -> DataFrame:
    """:func:`sigma_policy` for ``slots`` (quantity, mu, ...) whose columns ``posterior`` and ``stated`` hold these deviations, or
    null: no variable is looked up, and only the few ``defaults`` (quantity, sigma) are joined."""
    share = F.lit(None).cast("double")
    for quantity, part in relative.items():
        share = F.when(F.col("quantity") == quantity, part * F.abs("mu")).otherwise(share)
    known = defaults.select("quantity", F.col("sigma").alias("__d"))
    joined = slots.withColumns({"__p": F.col(posterior), "__s": F.col(stated), "__r": share}).join(known, "quantity", "left")
    policy = F.when(F.col("__p").isNotNull(), "POSTERIOR").when(F.col("__s").isNotNull(), "STATED").when(F.col("__r").isNotNull(), "RELATIVE").when(F.col("__d").isNotNull(), "DEFAULT")
    return joined.select(*slots.columns, F.coalesce("__p", "__s", "__r", "__d").alias("sigma"), policy.otherwise("REJECTED").alias("policy"))


def module_digest(lines: DataFrame) -> DataFrame:
    """model, n, digest of the lines (model, line) of each model in any order, repeats included.

    The SHA-256 of each line adds to a sum, so that a model of any size is digested by partial sums and no task gathers it.
    """
    h = F.sha2("line", 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    found = lines.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *parts)
    return found.select("model", "n", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256).alias("digest"))


def equivalence(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """check, only_a, only_b, same: rows, repeats included, that only one of two states has, table by table."""
    found = None
    for name in a:
        one = a[name].exceptAll(b[name]).agg(F.count(F.lit(1)).alias("only_a"))
        two = b[name].exceptAll(a[name]).agg(F.count(F.lit(1)).alias("only_b"))
        row = one.join(two).select(F.lit(name).alias("check"), "only_a", "only_b", ((F.col("only_a") + F.col("only_b")) == 0).alias("same"))  # one row each
        found = row if found is None else found.unionByName(row)
    return found


def close(a: DataFrame, b: DataFrame, keys: list[str], value: str, *, atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """model, n, unmatched, apart, same: ``value`` of two states by ``keys`` (of which ``model`` is one), within a tolerance."""
    joined = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    off = both & (F.abs(F.col("__a") - F.col("__b")) > atol + rtol * F.abs("__b"))
    found = joined.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~both, 1)).alias("unmatched"), F.count(F.when(off, 1)).alias("apart"))
    return found.withColumn("same", (F.col("unmatched") + F.col("apart")) == 0)


def last_values(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys``, value, place and n: the value that was written last for each key (the greatest of equal places)."""
    last = F.max(F.struct(F.col(order).alias("place"), F.col(value).alias("value")))
    return rows.groupBy(*keys).agg(last.alias("__last"), F.count(F.lit(1)).alias("n")).select(*keys, "__last.value", "__last.place", "n")


def model_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """model and how many rows each of ``tables`` (model, ...) has of it; 0 where it has none."""
    found = None
    for name, rows in tables.items():
        n = rows.groupBy("model").agg(F.count(F.lit(1)).alias(name))
        found = n if found is None else found.join(n, "model", "full")
    return found.select("model", *[F.coalesce(n, F.lit(0)).alias(n) for n in tables])


def bound_statuses(entities: DataFrame, told: DataFrame, known: list[str]) -> DataFrame:
    """``entities`` (id) with the status that an audit ``told`` (id, status) of them: UNMATCHED if none, UNKNOWN_STATUS for
    one that is not among ``known``."""
    found = entities.join(told, "id", "left")
    return found.select(*entities.columns, F.when(F.col("status").isNull(), "UNMATCHED").when(~F.col("status").isin(known), "UNKNOWN_STATUS").otherwise(F.col("status")).alias("status"))


def listed(slots: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """``by`` (an entity's key) and quantities: an array of (quantity, mu, sigma) in order of their names, to so many
    significant digits. An entity has few quantities, those of its class."""
    row = F.struct("quantity", significant(F.col("mu"), digits).alias("mu"), significant(F.col("sigma"), digits).alias("sigma"))
    return slots.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("quantities"))


def listed_rows(rows: DataFrame, by: list[str], quantities: list[str], digits: int = 6) -> DataFrame:
    """What :func:`listed` gives, from ``rows`` that have an entity's ``quantities`` side by side, each with its deviation as
    s_quantity: nothing is shuffled."""
    six = lambda c: significant(F.col(c), digits)
    each = [F.struct(F.lit(q).alias("quantity"), six(q).alias("mu"), six(f"s_{q}").alias("sigma")) for q in sorted(quantities)]
    return rows.select(*by, F.array(*each).alias("quantities"))
