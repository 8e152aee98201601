"""From source records to entities: which rows come in, in which units, and why others don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belvane.sources.tables import dealt


def classified(products: DataFrame, classes: DataFrame) -> DataFrame:
    """``products`` (type, ...) of a known type, with the ``class`` that ``classes`` (type, class) gives it."""
    return products.join(classes, "type")


def opted_in(products: DataFrame, marked: DataFrame, optional: list[str]) -> DataFrame:
    """``products`` (id, class, ...), those of an ``optional`` class only if ``marked`` (id) names them."""
    named = marked.select("id").distinct().withColumn("__marked", F.lit(True))
    return products.join(named, "id", "left").where(~F.col("class").isin(optional) | F.col("__marked").isNotNull()).drop("__marked")


def in_metres(quantities: DataFrame, units: DataFrame, lengths: list[str]) -> DataFrame:
    """``quantities`` (model, quantity, mu) with ``si``: lengths times the scale of the model's unit (model, scale), other
    quantities as they are. A model without a unit is in metres, and ``assumed`` tells so."""
    scale = F.when(F.col("quantity").isin(lengths), F.coalesce("scale", F.lit(1.0))).otherwise(1.0)
    return quantities.join(units, "model", "left").withColumns({"si": F.col("mu") * scale, "assumed": F.col("scale").isNull()}).drop("scale")


def unit_status(assigned: DataFrame, prefixes: dict[str, float]) -> DataFrame:
    """model, n, scale, status of the length units (model, prefix) that each model assigns: OK, AMBIGUOUS where scales
    differ, UNSUPPORTED where a prefix is unknown. The prefix "" is the metre itself."""
    known = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    found = assigned.withColumn("s", F.element_at(known, F.col("prefix"))).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("k"), F.max("s").alias("scale"), F.count(F.when(F.col("s").isNull(), 1)).alias("bad"))
    status = F.when(F.col("bad") > 0, "UNSUPPORTED").when(F.col("k") > 1, "AMBIGUOUS").otherwise("OK")
    return found.select("model", "n", F.when(status == "OK", F.col("scale")).alias("scale"), status.alias("status"))


def shared_sources(slots: DataFrame, model: str, source: list[str]) -> DataFrame:
    """``slots`` whose source record is that of another slot of the model too, with ``n``, how many share it."""
    return slots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(model, *source))).where("n > 1")


def lowered_edges(lists: DataFrame, known: DataFrame) -> DataFrame:
    """kind, source, target of relations (kind, source, targets: a list), of which both ends are ``known`` (node)."""
    nodes = known.select("node").distinct()
    edges = lists.select("kind", "source", F.explode("targets").alias("target"))
    return edges.join(nodes, F.col("source") == F.col("node"), "left_semi").join(nodes, F.col("target") == F.col("node"), "left_semi")


def flagged(entities: DataFrame, records: DataFrame, key: str, name: str) -> DataFrame:
    """``entities`` with the boolean ``name``: whether any of ``records`` (key) names them."""
    return entities.join(records.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def count_gate(entities: DataFrame, models: DataFrame, exactly: int = 1) -> DataFrame:
    """``models`` (model) with ``n``, its entities of the gate's kind, and a status: OK, NONE, TOO_FEW or TOO_MANY."""
    n = entities.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    found = models.join(n, "model", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("status", F.when(F.col("n") == exactly, "OK").when(F.col("n") == 0, "NONE").when(F.col("n") < exactly, "TOO_FEW").otherwise("TOO_MANY"))


def by_name(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """``wanted`` (name) with the one entity (id, name) of that name, its number ``n``, and a status; none or several are
    an error, and no entity is chosen."""
    found = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    joined = wanted.join(found, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("name", "n", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, "FOUND").when(F.col("n") == 0, "UNKNOWN").otherwise("AMBIGUOUS").alias("status"))


def constraints(slots: DataFrame, below: list[tuple[str, str]], restated: list[str]) -> DataFrame:
    """model, entity, kind, lhs, rhs from ``slots`` (model, entity, quantity): every quantity is not negative; of each pair
    ``below`` the first is at most the second, where an entity has both; ``restated`` quantities equal their definition."""
    positive = slots.select("model", "entity", F.lit("NonNegative").alias("kind"), F.col("quantity").alias("lhs"), F.lit(None).cast("string").alias("rhs"))
    same = slots.where(F.col("quantity").isin(restated)).select("model", "entity", F.lit("ExprEquals").alias("kind"), F.col("quantity").alias("lhs"), F.lit("definition").alias("rhs"))
    has = slots.groupBy("model", "entity").agg(F.collect_set("quantity").alias("q"))  # an entity has a few quantities
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("lhs"), F.lit(b).alias("rhs")) for a, b in below]), lambda p: F.array_contains("q", p["lhs"]) & F.array_contains("q", p["rhs"]))
    less = has.select("model", "entity", F.lit("LessEqual").alias("kind"), F.inline(pairs))
    return positive.unionByName(less).unionByName(same)


def constraints_of_kind(entities: DataFrame, quantities: list[str], below: list[tuple[str, str]], restated: list[str]) -> DataFrame:
    """What :func:`constraints` gives for ``entities`` (model, entity) of one kind, each of which has the same
    ``quantities``: told in the entity's row, nothing is shuffled."""
    told = [("NonNegative", q, None) for q in quantities]
    told += [("LessEqual", a, b) for a, b in below if a in quantities and b in quantities]
    told += [("ExprEquals", q, "definition") for q in quantities if q in restated]
    each = [F.struct(F.lit(k).alias("kind"), F.lit(a).alias("lhs"), F.lit(b).cast("string").alias("rhs")) for k, a, b in told]
    return entities.select("model", "entity", F.inline(F.array(*each)))


def strict_json(files: DataFrame, fields: dict[str, str], *, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """id, sha256, each of ``fields`` (name to SQL type) and a reason from ``files`` (id, body): a document must be an
    object with these keys and no others, each of its type, finite and within its limits. A refused one keeps its id, its
    digest and the reason: NOT_JSON, KEYS, TYPE or LIMITS."""
    told = F.from_json("body", "map<string,string>")
    keys = F.json_object_keys("body")
    found = files.select("id", F.sha2("body", 256).alias("sha256"), keys.alias("__keys"), told.alias("__m"))
    typed = found.select("*", *[F.expr(f"try_cast(__m['{n}'] as {t})").alias(n) for n, t in fields.items()])
    wrong = lambda test: sum([F.coalesce(test(n), F.lit(True)).cast("int") for n in fields], F.lit(0)) > 0
    outside = sum([(~F.col(n).between(*limits[n])).cast("int") for n in limits], F.lit(0)) > 0
    same = F.array_sort("__keys") == F.array(*[F.lit(n) for n in sorted(fields)])
    reason = F.when(F.col("__keys").isNull(), "NOT_JSON").when(~same, "KEYS").when(wrong(lambda n: F.col(n).isNull()), "TYPE").when(F.coalesce(outside, F.lit(True)), "LIMITS")
    return typed.withColumn("reason", reason).select("id", "sha256", *[F.when(F.col("reason").isNull(), F.col(n)).alias(n) for n in fields], "reason")


def property_values(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``key``, name, text and number (null for what is none) of each property in a JSON object."""
    return rows.select(key, F.explode(F.from_json(body, "map<string,string>")).alias("name", "text")).withColumn("number", F.expr("try_cast(text as double)"))


def written_back(source: DataFrame, posterior: DataFrame, floor: float = 1e-6) -> DataFrame:
    """model, var_id, kind, value: ``source`` (model, var_id, value) with the values that ``posterior`` (model, var_id, mu,
    sigma) has anew, and for each of those a row of kind "sigma", at least ``floor``. A posterior without a source is left
    out, as there is nothing to write it to."""
    joined = source.join(posterior, ["model", "var_id"], "left")
    values = joined.select("model", "var_id", F.lit("value").alias("kind"), F.coalesce("mu", "value").alias("value"))
    return values.unionByName(joined.where("sigma is not null").select("model", "var_id", F.lit("sigma").alias("kind"), F.greatest("sigma", F.lit(floor)).alias("value")))


def text_status(text: Column, digest: Column) -> Column:
    """OK, or what is wrong with a text and the digest that it came with: EMPTY, NO_DIGEST (not 64 hexadecimal digits) or
    WRONG_DIGEST."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "EMPTY").when(~F.coalesce(digest, F.lit("")).rlike("^[0-9a-f]{64}$"), "NO_DIGEST").when(F.sha2(text, 256) != digest, "WRONG_DIGEST").otherwise("OK")


def attached(products: DataFrame, relations: DataFrame, sets: DataFrame) -> DataFrame:
    """id, set, name, value: the properties that ``relations`` (set, related: an array of ids) attach to ``products`` (id),
    by their ``sets`` (set, name, value). A set that is attached to a product twice counts once; ids that are no products
    and sets without properties are left out."""
    # dealt by number: merged by their packed bytes, a task's pairs and hash tables came to more than a GB
    pairs = dealt(relations.select("set", F.explode("related").alias("id")), "id").distinct()
    return pairs.join(products.select("id"), "id", "left_semi").join(sets.select("set", "name", "value"), "set").select("id", "set", "name", "value")
