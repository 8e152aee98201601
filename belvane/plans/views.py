"""The engine's tables, derived from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belvane.sources.tables import table

ENTITY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """One row per line of an order: model (its supplier), entity and the raw quantities' means; ``more`` of its columns."""
    raw = table(spark, d, "lineitem")
    entity = F.concat_ws(":", *[F.col(c).cast("string") for c in ENTITY], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    return raw.select(
        F.col("l_suppkey").alias("model"), entity.alias("entity"), "l_returnflag",
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), *more,
    )


def slots(spark: SparkSession, d: str) -> DataFrame:
    """model, entity, quantity, var_id, mu, sigma: raw quantities with the default uncertainty of their kind."""
    kinds = F.array(
        F.struct(F.lit("Qty").alias("quantity"), F.col("qty").alias("mu"), F.lit(0.5).alias("sigma")),
        F.struct(F.lit("Price").alias("quantity"), F.col("price").alias("mu"), (0.08 * F.abs("price")).alias("sigma")),
        F.struct(F.lit("Disc").alias("quantity"), F.col("disc").alias("mu"), F.lit(0.002).alias("sigma")),
        F.struct(F.lit("Tax").alias("quantity"), F.col("tax").alias("mu"), F.lit(0.002).alias("sigma")),
    )
    own = lines(spark, d).select("model", "entity", F.inline(kinds))
    shared = table(spark, d, "supplier").select(F.col("s_suppkey").alias("model"), F.lit("*").alias("entity"), F.lit("Fx").alias("quantity"), F.lit(1.0).alias("mu"), F.lit(0.01).alias("sigma"))
    return own.unionByName(shared).withColumn("var_id", F.concat_ws(".", "entity", "quantity"))


def definitions(spark: SparkSession, d: str, *, nested: bool = False) -> DataFrame:
    """Terms of each line's derived quantities: Gross = Qty Price, Net = Gross (1 - Disc), Charge = Net (1 + Tax) Fx; as
    they are stated if ``nested``, else multiplied out to raw quantities, so that each can be taken by itself."""
    rules = {"Gross": [(1, "QP")], "Net": [(1, "QP"), (-1, "QPD")], "Charge": [(1, "QPF"), (-1, "QPDF"), (1, "QPTF"), (-1, "QPDTF")]}
    if nested:
        rules = {"Gross": [(1, "QP")], "Net": [(1, "G"), (-1, "GD")], "Charge": [(1, "NF"), (1, "NTF")]}
    names = {"Q": "Qty", "P": "Price", "D": "Disc", "T": "Tax", "G": "Gross", "N": "Net"}
    factor = lambda x: F.struct((F.concat(F.col("entity"), F.lit("." + names[x])) if x in names else F.lit("*.Fx")).alias("var_id"), F.lit(1).alias("pow"))
    terms = [F.struct(F.lit(out).alias("quantity"), F.lit(k).alias("term_id"), F.lit(float(c)).alias("coef"), F.array(*[factor(x) for x in f]).alias("factors")) for out, ts in rules.items() for k, (c, f) in enumerate(ts)]
    made = lines(spark, d).select("model", "entity", F.inline(F.array(*terms)))
    return made.select("model", "entity", "quantity", F.concat_ws(".", "entity", "quantity").alias("out_var"), "term_id", "coef", "factors")


#: Gross, net and charge of a line, as they are stated.
RULES = {"Gross": [(1, ("Qty", "Price"))], "Net": [(1, ("Gross",)), (-1, ("Gross", "Disc"))], "Charge": [(1, ("Net", "Fx")), (1, ("Net", "Tax", "Fx"))]}
OWN, SHARED = ["Qty", "Price", "Disc", "Tax"], ["Fx"]


def own(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """model, entity and a column for each quantity of a line, with s_ for its deviation; ``more`` columns of the lines go
    along."""
    return lines(spark, d, *more).select(
        "model", "entity", F.col("qty").alias("Qty"), F.lit(0.5).alias("s_Qty"), F.col("price").alias("Price"), (0.08 * F.abs("price")).alias("s_Price"),
        F.col("disc").alias("Disc"), F.lit(0.002).alias("s_Disc"), F.col("tax").alias("Tax"), F.lit(0.002).alias("s_Tax"), *more,
    )


def shared(spark: SparkSession, d: str) -> DataFrame:
    """model and its own quantity, with s_ for the deviation."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("model"), F.lit(1.0).alias("Fx"), F.lit(0.01).alias("s_Fx"))


def wide(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """model, entity and a column for each quantity of :func:`slots`, with s_ for its deviation: what
    :func:`~belvane.operators.rules.side_by_side` makes of the slots. A line has its quantities side by side already, so
    nothing is shuffled but the models' shared ones, of which Spark broadcasts a small table. ``more`` columns of the lines
    go along."""
    return own(spark, d, *more).join(shared(spark, d), "model", "left")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """kind, source, target: regions aggregate nations, these suppliers and customers; customers contain orders."""
    def edge(name: str, kind: str, a: str, source: str, b: str, target: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(kind).alias("kind"), F.concat(F.lit(a), F.col(source)).alias("source"), F.concat(F.lit(b), F.col(target)).alias("target"))

    return (
        edge("nation", "aggregates", "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(edge("supplier", "aggregates", "n", "s_nationkey", "s", "s_suppkey"))
        .unionByName(edge("customer", "aggregates", "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(edge("orders", "contains", "c", "o_custkey", "o", "o_orderkey"))
    )


def supplier_relations(spark: SparkSession, d: str) -> DataFrame:
    """model, kind, source, target: each supplier is a model that contains its orders, which aggregate its lines."""
    lines_ = table(spark, d, "lineitem")
    model, order = F.col("l_suppkey").alias("model"), F.concat(F.lit("o"), "l_orderkey")
    contains = lines_.select(model, F.lit("contains").alias("kind"), F.concat(F.lit("s"), "l_suppkey").alias("source"), order.alias("target")).distinct()
    line = F.concat_ws(":", F.lit("l"), *[F.col(c).cast("string") for c in ENTITY])
    return contains.unionByName(lines_.select(model, F.lit("aggregates").alias("kind"), order.alias("source"), line.alias("target")).distinct())


def nodes_of(rel: DataFrame) -> DataFrame:
    """model, node of all ends of ``rel``."""
    return rel.select("model", F.col("source").alias("node")).unionByName(rel.select("model", F.col("target").alias("node"))).distinct()


def region_relations(spark: SparkSession, d: str) -> DataFrame:
    """model, kind, source, target: each region is a model of its nations, customers and orders, which are named within it."""
    nation, customer, orders = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    own = customer.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("model")), "c_nationkey")
    edge = lambda kind, a, source, b, target: (F.lit(kind).alias("kind"), F.concat(F.lit(a), F.col(source)).alias("source"), F.concat(F.lit(b), F.col(target)).alias("target"))
    return own.select("model", *edge("aggregates", "n", "c_nationkey", "c", "c_custkey")).unionByName(
        orders.join(own.select("model", F.col("c_custkey").alias("o_custkey")), "o_custkey").select("model", *edge("contains", "c", "o_custkey", "o", "o_orderkey"))
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """id, origin, yaw, extents: boxes on a floor, from parts."""
    return table(spark, d, "part").selectExpr(
        "p_partkey as id", "p_type as class", "cast(p_partkey % 50 as double) as ox", "cast(floor(p_partkey / 50) as double) as oy", "cast(0 as double) as oz",
        "(p_partkey % 4) * 0.39269908169872414D as yaw", "0.2D + p_size / 50.0D as ex", "0.3D + p_size / 100.0D as ey", "3.0D as ez",
    )


def as_readings(events: DataFrame) -> DataFrame:
    """user_id, ts, event_id, event_type, y and r (the noise variance of its kind of event)."""
    r = F.when(F.col("event_type") == "purchase", 4.0).when(F.col("event_type") == "click", 9.0).when(F.col("event_type") == "view", 25.0).otherwise(16.0)
    return events.select("user_id", "ts", "event_id", "event_type", F.col("value").alias("y"), r.alias("r"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    return as_readings(table(spark, d, "events"))
