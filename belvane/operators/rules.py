"""Derived quantities by rule: one definition for all entities of a kind, evaluated where an entity's quantities are.

``rules`` maps a derived quantity to its terms, pairs of a coefficient and the quantities that are multiplied, e.g.
``{"Gross": [(1, ("Qty", "Price"))], "Net": [(1, ("Gross",)), (-1, ("Gross", "Disc"))]}``. A term without factors is a
constant. A rule may use other derived quantities, but not, by any way, itself. Quantities of an entity stand side by side
in one row, so values and derivatives are plain columns: no shuffle by variable, and a shared quantity of a model is no hot
key. For definitions that differ from entity to entity see ``dag``.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = dict[str, list[tuple[float, tuple[str, ...]]]]


def free(rules: Rules) -> list[str]:
    """The quantities that rules use and none defines, in order."""
    return sorted({x for terms in rules.values() for _, factors in terms for x in factors} - set(rules))


def ordered(rules: Rules) -> list[list[str]]:
    """The derived quantities level by level, each after those that it uses. A cycle is an error that names it."""
    left, done = {out: {x for _, f in terms for x in f if x in rules} for out, terms in rules.items()}, []
    while left:
        level = sorted(out for out, uses in left.items() if not uses & set(left))
        if not level:
            raise ValueError(f"definitions on a cycle: {', '.join(sorted(left))}")
        done.append(level)
        left = {out: uses for out, uses in left.items() if out not in level}
    return done


def side_by_side(slots: DataFrame, own: list[str], shared: list[str] | None = None) -> DataFrame:
    """model, entity and for each quantity its mean and, as s_quantity, its deviation, from ``slots`` (model, entity,
    quantity, mu, sigma). ``shared`` quantities are the model's, under the entity "*". A missing quantity is null."""
    pick = lambda q, c: F.max(F.when(F.col("quantity") == q, F.col(c)))
    columns = lambda qs: [x for q in qs for x in (pick(q, "mu").alias(q), pick(q, "sigma").alias(f"s_{q}"))]
    wide = slots.where(F.col("quantity").isin(own)).groupBy("model", "entity").agg(*columns(own))
    if not shared:
        return wide
    # a row for each model: Spark broadcasts it if its measured size is small
    return wide.join(slots.where((F.col("entity") == "*") & F.col("quantity").isin(shared)).groupBy("model").agg(*columns(shared)), "model", "left")


def _value(terms: list[tuple[float, tuple[str, ...]]]) -> Column:
    """The sum of the terms; what all of them have as a factor is multiplied last, which rounds less often."""
    product = lambda factors: reduce(lambda a, b: a * b, [F.col(x) for x in factors]) if factors else None
    shared = reduce(lambda a, b: a & b, [Counter(f) for _, f in terms]) if terms else Counter()

    def term(c: float, factors: tuple[str, ...]) -> Column:
        rest = product(sorted((Counter(factors) - shared).elements()))
        return F.lit(float(c)) if rest is None else rest if c == 1 else F.lit(float(c)) * rest

    total = reduce(lambda a, b: a + b, [term(c, f) for c, f in terms]) if terms else F.lit(0.0)
    common = product(sorted(shared.elements()))
    return total if common is None else common * total


def evaluated(wide: DataFrame, rules: Rules) -> DataFrame:
    """``wide`` with a column for each derived quantity; null where one that it uses is null. No terms give 0."""
    for level in ordered(rules):
        wide = wide.withColumns({out: _value(rules[out]) for out in level})
    return wide


def _partial(terms: list[tuple[float, tuple[str, ...]]], x: str) -> list[Column]:
    found = []
    for c, factors in terms:
        n = factors.count(x)
        if n:
            rest = list(factors)
            rest.remove(x)
            found.append(F.lit(float(c) * n) * reduce(lambda a, b: a * b, [F.col(y) for y in rest], F.lit(1.0)))
    return found


def with_gradient(wide: DataFrame, rules: Rules, only: list[str] | None = None) -> DataFrame:
    """``wide`` with values and, as d_out_raw, the derivative of each derived quantity by each raw one that it rests on, by
    the chain rule over the levels. ``only``: the derived quantities whose derivatives stay."""
    reach: dict[str, list[str]] = {}
    for level in ordered(rules):
        made = {}
        for out in level:
            uses = sorted({x for _, f in rules[out] for x in f})
            raws = sorted({r for x in uses for r in (reach[x] if x in rules else [x])})
            reach[out] = raws
            for raw in raws:
                parts = []
                for x in uses:
                    local = _partial(rules[out], x)
                    if x == raw:
                        parts += local
                    elif x in rules and raw in reach[x]:
                        parts += [p * F.col(f"d_{x}_{raw}") for p in local]
                made[f"d_{out}_{raw}"] = reduce(lambda a, b: a + b, parts)
        wide = wide.withColumns({out: _value(rules[out]) for out in level}).withColumns(made)
    gone = [f"d_{out}_{raw}" for out in rules if only and out not in only for raw in reach[out]]
    return wide.drop(*gone)


def multiplied_out(rules: Rules, out: str) -> list[tuple[float, tuple[str, ...]]]:
    """The terms of ``out`` in raw quantities, like terms added; those that cancel are gone."""
    found: Counter[tuple[str, ...]] = Counter()
    for c, factors in rules[out]:
        made = [(float(c), ())]
        for x in factors:
            inner = multiplied_out(rules, x) if x in rules else [(1.0, (x,))]
            made = [(a * b, (*f, *g)) for a, f in made for b, g in inner]
        for a, f in made:
            found[tuple(sorted(f))] += a
    return [(c, f) for f, c in found.items() if c != 0]


def margin(rules: Rules, most: str, out: str) -> Rules:
    """``Margin``, by how much ``out`` is below ``most``, in raw quantities: what both rest on alike cancels exactly."""
    return {"Margin": multiplied_out({**rules, "Margin": [(1, (most,)), (-1, (out,))]}, "Margin")}


def raws_of(rules: Rules, out: str) -> list[str]:
    """The raw quantities that ``out`` rests on, in order."""
    return sorted({r for _, f in rules[out] for x in f for r in (raws_of(rules, x) if x in rules else [x])})


def free_variables(rows: DataFrame, rules: Rules, shared: list[str]) -> DataFrame:
    """model, entity, quantity, variables: what each derived quantity of each entity of ``rows`` (model, entity) rests on, in
    order, each once; ``shared`` quantities are the model's, under the entity "*". Told in the entity's row."""
    name = lambda r: F.lit(f"*.{r}") if r in shared else F.concat_ws(".", "entity", F.lit(r))
    each = [F.struct(F.lit(out).alias("quantity"), F.array_sort(F.array(*[name(r) for r in dict.fromkeys(raws_of(rules, out))]).cast("array<string>")).alias("variables")) for out in rules]
    return rows.select("model", "entity", F.inline(F.array(*each)))


def variance(rules: Rules, out: str) -> Column:
    """The variance of ``out`` in a row of :func:`with_gradient`, raw quantities being independent."""
    return reduce(lambda a, b: a + b, [F.pow(F.col(f"d_{out}_{r}") * F.col(f"s_{r}"), F.lit(2)) for r in raws_of(rules, out)])


def totals(rows: DataFrame, rules: Rules, out: str, shared: list[str]) -> DataFrame:
    """model, entities, total and var: ``out`` summed over a model's entities. What is an entity's own adds up as variances;
    the derivatives by a shared quantity are summed first. Partial sums only, so a model of any size is no hot key."""
    raws = raws_of(rules, out)
    own, common = [r for r in raws if r not in shared], [r for r in raws if r in shared]
    square = lambda r: F.pow(F.col(f"d_{out}_{r}") * F.col(f"s_{r}"), F.lit(2))
    sums = [F.sum(reduce(lambda a, b: a + b, [square(r) for r in own], F.lit(0.0))).alias("__own")]
    sums += [x for r in common for x in (F.sum(f"d_{out}_{r}").alias(f"__d_{r}"), F.max(f"s_{r}").alias(f"__s_{r}"))]
    found = rows.groupBy("model").agg(F.count(out).alias("entities"), F.sum(out).alias("total"), *sums)
    var = reduce(lambda a, b: a + b, [F.pow(F.col(f"__d_{r}") * F.col(f"__s_{r}"), F.lit(2)) for r in common], F.col("__own"))
    return found.select("model", "entities", "total", var.alias("var"))


def as_jacobian(rows: DataFrame, rules: Rules, outs: list[str]) -> DataFrame:
    """model, entity, quantity, raw, v: the derivatives of :func:`with_gradient` as rows."""
    cells = [F.struct(F.lit(o).alias("quantity"), F.lit(r).alias("raw"), F.col(f"d_{o}_{r}").alias("v")) for o in outs for r in raws_of(rules, o)]
    return rows.select("model", "entity", F.inline(F.array(*cells)))


def observation_rows(rows: DataFrame, rules: Rules, wanted: list[str]) -> DataFrame:
    """model, entity, quantity, raw, h: the rows of H for the ``wanted`` quantities of each entity of :func:`with_gradient`: a
    derived one's derivatives, and a single 1 for a raw one. Told in the entity's row, none is looked up."""
    cells = [(o, r, F.col(f"d_{o}_{r}")) for o in wanted if o in rules for r in raws_of(rules, o)] + [(o, o, F.lit(1.0)) for o in wanted if o not in rules]
    return rows.select("model", "entity", F.inline(F.array(*[F.struct(F.lit(o).alias("quantity"), F.lit(r).alias("raw"), h.alias("h")) for o, r, h in cells])))


def local_edges(rules: Rules, out: str, depth: int = 12) -> list[tuple[str, str, int]]:
    """child, parent, depth: the edges along which ``out`` rests on others, to ``depth``, nearest first."""
    edges, level = [], [out]
    for k in range(1, depth + 1):
        found = sorted({(o, x) for o in level if o in rules for _, f in rules[o] for x in f})
        edges += [(o, x, k) for o, x in found if (o, x) not in {(a, b) for a, b, _ in edges}]
        level = sorted({x for _, x in found})
    return edges


def parsed(text: str) -> Rules:
    """Rules from JSON: {"name": "Net", "terms": [{"coef": 1, "factors": ["Gross"]}, ...]} in a list. An unknown field, a
    missing one or a name defined twice is an error."""
    import json

    rules: Rules = {}
    for rule in json.loads(text):
        if set(rule) != {"name", "terms"} or rule["name"] in rules:
            raise ValueError(f"not a rule, or defined twice: {sorted(rule)} {rule.get('name')}")
        for term in rule["terms"]:
            if set(term) != {"coef", "factors"} or not all(isinstance(x, str) for x in term["factors"]):
                raise ValueError(f"not a term: {term}")
        rules[rule["name"]] = [(float(t["coef"]), tuple(t["factors"])) for t in rule["terms"]]
    return rules


def mean_of(names: list[str]) -> list[tuple[float, tuple[str, ...]]]:
    """The terms of a mean of one or more quantities."""
    if not names:
        raise ValueError("a mean of nothing")
    return [(1 / len(names), (x,)) for x in names]


def covariance(rows: DataFrame, rules: Rules, outs: list[str], *, across: list[str] | None = None) -> DataFrame:
    """model, entity, i, j, v: the covariances of ``outs`` within each entity, J S J' over the raw quantities that both rest
    on; ``across`` names raw quantities that are left out, such as those shared with other entities."""
    cells = []
    for i in outs:
        for j in outs:
            both = [r for r in raws_of(rules, i) if r in raws_of(rules, j) and r not in (across or [])]
            v = reduce(lambda a, b: a + b, [F.col(f"d_{i}_{r}") * F.col(f"d_{j}_{r}") * F.pow(F.col(f"s_{r}"), F.lit(2)) for r in both], F.lit(0.0))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v")))
    return rows.select("model", "entity", F.inline(F.array(*cells)))


def correlations(rows: DataFrame, rules: Rules, outs: list[str]) -> DataFrame:
    """model, entity, i, j, cov, corr (0 where a deviation is below 1e-150), i < j: the correlations of ``outs`` within each
    entity, in its row; what ``belief.correlations`` makes of :func:`covariance` by two joins."""
    outs = sorted(outs)
    sums = lambda i, j: reduce(lambda a, b: a + b, [F.col(f"d_{i}_{r}") * F.col(f"d_{j}_{r}") * F.pow(F.col(f"s_{r}"), F.lit(2)) for r in raws_of(rules, i) if r in raws_of(rules, j)], F.lit(0.0))
    root = {o: F.sqrt(sums(o, o)) for o in outs}
    cells = []
    for k, i in enumerate(outs):
        for j in outs[k + 1:]:
            small = (root[i] < 1e-150) | (root[j] < 1e-150)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), sums(i, j).alias("cov"), F.when(small, 0.0).otherwise(sums(i, j) / (root[i] * root[j])).alias("corr")))
    return rows.select("model", "entity", F.inline(F.array(*cells)))


def incremental(before: DataFrame, wide: DataFrame, changed: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Values after a change, and how many rows that took: ``before`` has the values of all entities (model, entity and
    derived columns), ``wide`` the raw quantities as they are now, ``changed`` (model, entity) what has changed. Only changed
    entities are evaluated anew; the rest is taken over. The second table is model, recomputed, kept."""
    names = list(rules)
    keys = changed.select("model", "entity").distinct()
    again = evaluated(wide.join(keys, ["model", "entity"], "left_semi"), rules).select("model", "entity", *names).withColumn("recomputed", F.lit(True))
    kept = before.select("model", "entity", *names).join(keys, ["model", "entity"], "left_anti").withColumn("recomputed", F.lit(False))
    both = again.unionByName(kept)
    work = both.groupBy("model").agg(F.count(F.when(F.col("recomputed"), 1)).alias("recomputed"), F.count(F.when(~F.col("recomputed"), 1)).alias("kept"))
    return both.drop("recomputed"), work


def with_changes(wide: DataFrame, quantity: str, changes: DataFrame, op: str) -> DataFrame:
    """``wide`` after an intervention on a quantity of some entities, ``changes`` (model, entity, value, and design_sigma for
    ``set``): ``set`` gives it that mean and deviation, ``shift`` adds to its mean, ``scale`` multiplies both (a factor of 0
    or null changes nothing). One join of the changed entities; all other rows stay as they are."""
    named = changes.select("model", "entity", F.col("value").alias("__v"), *([F.col("design_sigma").alias("__s")] if op == "set" else []), F.lit(True).alias("__hit"))
    joined = wide.join(named, ["model", "entity"], "left")
    mu, sigma, v = F.col(quantity), F.col(f"s_{quantity}"), F.col("__v")
    if op == "set":
        new = {quantity: F.when(F.col("__hit"), v).otherwise(mu), f"s_{quantity}": F.when(F.col("__hit"), F.col("__s")).otherwise(sigma)}
    elif op == "shift":
        new = {quantity: mu + F.coalesce(v, F.lit(0.0))}
    elif op == "scale":
        factor = F.coalesce(F.when(v != 0, v), F.lit(1.0))
        new = {quantity: mu * factor, f"s_{quantity}": sigma * F.abs(factor)}
    else:
        raise ValueError(f"not an intervention: {op}")
    return joined.withColumns(new).select(*wide.columns)


def neighbour_covariances(rows: DataFrame, rules: Rules, out: str, shared: list[str], order: list[str]) -> DataFrame:
    """model, place, var_a, var_b, cov: ``out`` of each entity and of the next of its model by ``order``, from rows of
    :func:`with_gradient`. Two entities have only ``shared`` raw quantities in common. Each row goes to its model once, as a
    few numbers; no row for each raw quantity is made."""
    common = [r for r in raws_of(rules, out) if r in shared]
    narrow = rows.select("model", *order, variance(rules, out).alias("var_a"), *[c for r in common for c in (F.col(f"d_{out}_{r}"), F.pow(F.col(f"s_{r}"), F.lit(2)).alias(f"__v_{r}"))])
    w = Window.partitionBy("model").orderBy(*order)
    after = lambda c: F.lead(c).over(w)
    near = narrow.select("model", F.row_number().over(w).alias("place"), "var_a", after("var_a").alias("var_b"), F.lead(F.lit(True)).over(w).alias("__two"), *[(F.col(f"d_{out}_{r}") * F.col(f"__v_{r}") * after(f"d_{out}_{r}")).alias(f"__c_{r}") for r in common])
    return near.where("__two").select("model", "place", "var_a", "var_b", reduce(lambda a, b: a + b, [F.col(f"__c_{r}") for r in common], F.lit(0.0)).alias("cov"))


_PLACE = "__bucket"


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(_PLACE, F.pmod(F.xxhash64("model", "entity"), F.lit(buckets)).cast("int"))


def write_base(wide: DataFrame, rules: Rules, top: str, *, buckets: int = 64) -> None:
    """Raw and derived quantities of all entities, in folders by a hash of the entity, for :func:`write_overlay`."""
    evaluated(_bucketed(wide, buckets).repartition(_PLACE), rules).write.partitionBy(_PLACE).parquet(f"{top}/base")


def write_overlay(spark, top: str, changes: DataFrame, rules: Rules, name: str, *, buckets: int = 64) -> DataFrame:  # noqa: ANN001
    """Evaluates the entities of ``changes`` (model, entity and raw quantities as they are now; those that it lacks, or has as
    null, stay) and writes them, not the others, as overlay ``name`` beside the base. Only folders that a changed entity lies
    in are read. Returns model, recomputed: the rows written. Overlays don't build on one another: name all that differs from
    the base."""
    marked = _bucketed(changes, buckets)
    touched = [r[0] for r in marked.select(_PLACE).distinct().collect()]  # ``buckets`` numbers at most
    base = spark.read.parquet(f"{top}/base").where(F.col(_PLACE).isin(touched))
    given = [c for c in changes.columns if c not in ("model", "entity")]
    joined = base.drop(*rules).join(marked.drop(_PLACE).withColumnsRenamed({c: f"__{c}" for c in given}), ["model", "entity"])
    now = joined.withColumns({c: F.coalesce(f"__{c}", c) for c in given}).drop(*[f"__{c}" for c in given])
    evaluated(now, rules).write.partitionBy(_PLACE).parquet(f"{top}/overlay-{name}")
    return spark.read.schema(base.schema).parquet(f"{top}/overlay-{name}").groupBy("model").agg(F.count(F.lit(1)).alias("recomputed"))


def read_version(spark, top: str, name: str | None = None, *, part: str | None = None) -> DataFrame:  # noqa: ANN001
    """All entities of the base, those of overlay ``name`` in its place. ``part`` names a column that tells where a row is
    from, "base" or "overlay"."""
    told = lambda df, where: df.withColumn(part, F.lit(where)) if part else df
    base = told(spark.read.parquet(f"{top}/base"), "base")
    if name is None:
        return base.drop(_PLACE)
    over = told(spark.read.schema(base.drop(*([part] if part else [])).schema).parquet(f"{top}/overlay-{name}"), "overlay")
    # the overlay is small: Spark broadcasts its keys if their measured size is
    return base.join(over.select(_PLACE, "model", "entity"), [_PLACE, "model", "entity"], "left_anti").unionByName(over).drop(_PLACE)
