"""Registered queries over fleets: structure by model, placements, streams with state, covariances across entities, joint
conditioning, each beside its SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belvane.functions import scalars
from belvane.operators import belief, decision, geometry, graph, layout, placement, registration, rules, verify
from belvane.plans import views
from belvane.plans.catalog import _LINES, _LOG, _PARTS, _PTS, _R, _SUM, query, rounded
from belvane.sources import snapshots
from belvane.sources.tables import growing, materialise, shared_dir, table
from belvane.streaming import stateful

_OWN = "(SELECT c_custkey, n_regionkey AS model, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_BACK = "o_orderkey % 97 = 0"


@query(f"""WITH o AS (SELECT model, o_custkey, o_orderkey, bool_or({_BACK}) OVER (PARTITION BY o_custkey) AS bad FROM orders JOIN {_OWN} ON c_custkey = o_custkey),
  f AS (SELECT model, concat('o', o_orderkey) AS subject, 'STRUCT-02' AS rule FROM o WHERE bad UNION ALL SELECT DISTINCT model, concat('c', o_custkey), 'STRUCT-02' FROM o WHERE bad
  UNION ALL SELECT model, 'fills ' || concat('c', c_custkey), 'STRUCT-03' FROM {_OWN} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 1
  UNION ALL SELECT model, 'contains ' || concat('c', c_custkey) || ' ' || concat('o', o_orderkey), 'STRUCT-01' FROM orders JOIN {_OWN} ON c_custkey = o_custkey WHERE o_totalprice < 2000)
  SELECT model, rule, count(*) AS failed FROM f GROUP BY 1, 2""")
def structure_report(spark: SparkSession, d: str) -> DataFrame:
    """Regions as models. Some orders lead back to their customer, which makes a cycle in their region only; cheap orders are
    missing from their region's nodes, though another region has nodes of those names; a customer is to have one order."""
    rel = views.region_relations(spark, d)
    key = F.substring("target", 2, 20).cast("long")
    back = rel.where((F.col("kind") == "contains") & (key % 97 == 0)).select("model", F.lit("aggregates").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"))
    cheap = table(spark, d, "orders").where("o_totalprice < 2000").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    nodes = views.nodes_of(rel)
    regions = nodes.select("model").distinct().withColumnRenamed("model", "other")
    elsewhere = nodes.join(cheap, "node", "left_semi").join(F.broadcast(regions), F.col("model") != F.col("other")).select(F.col("other").alias("model"), "node")  # a row a region
    nodes = nodes.join(cheap, "node", "left_anti").unionByName(elsewhere)
    single = rel.where("kind = 'aggregates'").select("model", F.col("target").alias("node"), F.lit("fills").alias("kind"))
    fills = rel.where("kind = 'contains'").withColumn("kind", F.lit("fills"))
    found = verify.both_ends({"rel": rel, "nodes": nodes}).unionByName(verify.acyclic({"rel": rel.unionByName(back)})).unionByName(verify.exactly_one({"rel": fills, "single": single}))
    return found.groupBy("model", "rule").agg(F.count(F.lit(1)).alias("failed"))


_CHAIN = """(SELECT user_id AS model, event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  value / 100 AS x, (event_id % 10) / 10.0::double AS y, 0.01::double AS z, (event_id % 16) * 0.39269908169872414::double AS yaw, user_id % 10 = 2 AND event_id % 50 = 0 AS tilted FROM events)"""
_PLACED = "round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) AS z, round(cos(yaw), 6) + 0.0 AS turn_x, round(sin(yaw), 6) + 0.0 AS turn_y"


@query(f"""WITH RECURSIVE c AS (SELECT *, CASE WHEN model % 10 = 0 THEN coalesce(before, last) WHEN model % 10 = 1 THEN coalesce(before, -1) ELSE before END AS parent FROM {_CHAIN}),
  w(model, node, x, y, z, yaw, depth, tilted) AS (SELECT model, node, x, y, z, yaw, 0::bigint, tilted FROM c WHERE parent IS NULL UNION ALL
  SELECT c.model, c.node, w.x + cos(w.yaw) * c.x - sin(w.yaw) * c.y, w.y + sin(w.yaw) * c.x + cos(w.yaw) * c.y, w.z + c.z, w.yaw + c.yaw, w.depth + 1, w.tilted OR c.tilted FROM w JOIN c ON c.model = w.model AND c.parent = w.node),
  f AS (SELECT c.model, c.node, w.x, w.y, w.z, w.yaw, w.depth, CASE WHEN c.model % 10 = 0 THEN 'CYCLE' WHEN c.model % 10 = 1 THEN 'DANGLING' WHEN w.tilted THEN 'OUT_OF_PLANE' ELSE 'PLACED' END AS status FROM c LEFT JOIN w ON w.model = c.model AND w.node = c.node)
  SELECT model, node, {_PLACED}, coalesce(depth, -1) AS depth, status FROM (SELECT model, node, CASE WHEN status = 'PLACED' THEN x END AS x, CASE WHEN status = 'PLACED' THEN y END AS y, CASE WHEN status = 'PLACED' THEN z END AS z, CASE WHEN status = 'PLACED' THEN yaw END AS yaw, CASE WHEN status = 'PLACED' THEN depth END AS depth, status FROM f)""")
def placement_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events stand on one another. In some models the first stands on the last, or on a node that isn't there, or
    some nodes are tilted."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = table(spark, d, "events").withColumns({"before": F.lag("event_id").over(w), "last": F.last("event_id").over(whole)})
    kind = F.col("user_id") % 10
    parent = F.when(kind == 0, F.coalesce("before", "last")).when(kind == 1, F.coalesce(F.col("before"), F.lit(-1))).otherwise(F.col("before"))
    rows = e.select(F.col("user_id").alias("model"), F.col("event_id").alias("node"), parent.alias("parent"), (F.col("value") / 100).alias("x"), ((F.col("event_id") % 10) / 10.0).alias("y"), F.lit(0.01).alias("z"),
                    ((F.col("event_id") % 16) * (math.pi / 8)).alias("yaw"), ((kind == 2) & (F.col("event_id") % 50 == 0)).alias("tilted"))
    found = placement.resolved(rows).withColumns({"turn_x": F.cos("yaw"), "turn_y": F.sin("yaw"), "depth": F.coalesce("depth", F.lit(-1))}).drop("yaw")
    found = rounded(found, 6, "x", "y", "z", "turn_x", "turn_y")
    return found.withColumns({c: F.col(c) + 0.0 for c in ("x", "y", "turn_x", "turn_y")})


def _sliced(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` (ts, ...) with ``slice``, 0 to ``slices`` - 1, by even parts of the time that they span."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min(t), F.max(t)).first()
    return rows.withColumn("slice", F.least(F.floor((t - F.lit(first)) * slices / F.lit(max((last or 0) - (first or 0), 1))), F.lit(slices - 1)).cast("int"))


def _placed(events: DataFrame) -> DataFrame:
    """``place``: a whole number that grows with a user's events, by their time and id."""
    return events.withColumn("place", F.unix_micros(F.col("ts").cast("timestamp")) * 100 + F.col("event_id") % 100)


@query(f"""WITH RECURSIVE o AS (SELECT user_id, value AS y, {_R} AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 100) AS k FROM events WHERE event_id % 11 <> 0),
  f(user_id, k, mu, var) AS (SELECT DISTINCT user_id, 0::bigint, 50.0::double, 10000.0::double FROM o UNION ALL
  SELECT f.user_id, o.k, f.mu + (f.var + 1) / (f.var + 1 + o.r) * (o.y - f.mu), (1 - (f.var + 1) / (f.var + 1 + o.r)) * (f.var + 1) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
  n AS (SELECT user_id, count(*) FILTER (event_id % 11 = 0) AS noise, count(*) FILTER (event_id % 7 = 0 AND event_id % 11 <> 0) AS old FROM events GROUP BY 1)
  SELECT user_id, k AS used, noise, old, round(mu, 6) AS mu, round(var, 6) AS var FROM f JOIN n USING (user_id) WHERE k = (SELECT max(k) FROM o WHERE o.user_id = f.user_id)""")
def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """Readings in four micro-batches. Some have no noise variance and are refused; some are sent again in a fifth."""
    e = _placed(table(spark, d, "events"))
    r = views.as_readings(table(spark, d, "events")).select("event_id", "r")
    rows = e.join(r, "event_id").select("user_id", "ts", "event_id", "place", F.col("value").alias("y"), F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("r")).alias("r"))
    sliced = _sliced(rows, 4)
    again = rows.where("event_id % 7 = 0 and event_id % 11 <> 0").withColumn("slice", F.lit(4))
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    arrived = stateful.arriving(materialise(sliced.unionByName(again)), "user_id", "slice", 5, top)
    found = stateful.filtered(arrived, "user_id", top, mu0=50.0, var0=10_000.0, q=1.0)
    used = F.col("reason").isNull()
    last = F.max_by(F.struct("mu", "var"), F.when(used, F.col("place")))
    out = found.groupBy("user_id").agg(F.count(F.when(used, 1)).alias("used"), F.count(F.when(F.col("reason") == "NOISE", 1)).alias("noise"), F.count(F.when(F.col("reason").isin("LATE", "REPEATED"), 1)).alias("old"), last.alias("s"))
    return rounded(out.select("user_id", "used", "noise", "old", "s.mu", "s.var"), 6, "mu", "var")


@query(f"""WITH h AS (SELECT user_id, count(*) AS accepted, list_reduce(list_prepend(repeat('0', 64), list(line ORDER BY seq)), lambda a, x: sha256(a || '|' || x)) AS head FROM {_LOG.replace("ORDER BY ts, event_id", "ORDER BY ts, event_id % 100")} GROUP BY user_id),
  n AS (SELECT user_id, count(*) FILTER (event_id % 5 = 0) AS stale, count(*) FILTER (event_id % 7 = 0) AS old FROM events GROUP BY 1) SELECT user_id, accepted, stale, old, head FROM h JOIN n USING (user_id)""")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events are appended to their user's log in four micro-batches. Right after some of them a request comes that still
    names the log's beginning; some events are sent again in a fifth micro-batch."""
    e = _placed(table(spark, d, "events")).select("user_id", "ts", "event_id", F.col("place") * 2, F.concat_ws("|", "event_type", "props").alias("line")).withColumnRenamed("(place * 2)", "place")
    none = F.lit(None).cast("string")
    asked = e.withColumn("prior", none)
    stale = e.where("event_id % 5 = 0").withColumns({"place": F.col("place") + 1, "prior": F.lit("0" * 64)})
    rows = _sliced(asked.unionByName(stale), 4).unionByName(asked.where("event_id % 7 = 0").withColumn("slice", F.lit(4)))
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    arrived = stateful.arriving(materialise(rows.withColumns({"record": none, "step": none})), "user_id", "slice", 5, top)
    found = stateful.appended(arrived, "user_id", top, [])
    n = lambda *reasons: F.count(F.when(F.col("reason").isin(*reasons), 1))
    return found.groupBy("user_id").agg(F.count("event_hash").alias("accepted"), n("STALE").alias("stale"), n("LATE", "REPEATED").alias("old"), F.max_by("event_hash", "seq").alias("head"))


#: Extents rest on a part's own size (deviation 0.4) and on a scale that all parts of a brand share (1, deviation 0.02).
_EXTENT = {"x": (0.2, 50.0), "y": (0.3, 100.0)}
_SIDE = """(SELECT p_partkey AS id, p_brand AS brand, p_size AS size, (p_partkey % 50)::double AS ox, floor(p_partkey / 50)::double AS oy, (p_partkey % 4) * 0.39269908169872414::double AS yaw, 0.2::double + p_size / 50.0::double AS ex, 0.3::double + p_size / 100.0::double AS ey FROM part)"""
_BOUND = """(SELECT *, ox + least(0, ex*cos(yaw)) + least(0, -ey*sin(yaw)) AS x0, ox + greatest(0, ex*cos(yaw)) + greatest(0, -ey*sin(yaw)) AS x1, oy + least(0, ex*sin(yaw)) + least(0, ey*cos(yaw)) AS y0, oy + greatest(0, ex*sin(yaw)) + greatest(0, ey*cos(yaw)) AS y1,
  ox + ex/2*cos(yaw) - ey/2*sin(yaw) AS cx, oy + ex/2*sin(yaw) + ey/2*cos(yaw) AS cy, cos(yaw)/100 - sin(yaw)/200 AS cx_size, sin(yaw)/100 + cos(yaw)/200 AS cy_size, ex/2*cos(yaw) - ey/2*sin(yaw) AS cx_scale, ex/2*sin(yaw) + ey/2*cos(yaw) AS cy_scale FROM """ + _SIDE + ")"
_NEAR = f"(SELECT a.id AS a, b.id AS b FROM {_BOUND} a JOIN {_BOUND} b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"


def _box_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes, the derivatives of their extents by raw variables (id, extent, var_id, v), and the covariance of these."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size"))
    own, shared = F.concat(F.lit("size."), F.col("id").cast("string")), F.concat(F.lit("scale."), F.col("brand"))
    cells = [F.struct(F.lit(k).alias("extent"), var.alias("var_id"), v.alias("v")) for k, (base, per) in _EXTENT.items() for var, v in ((own, F.lit(1 / per)), (shared, base + F.col("size") / per))]
    j = part.select(F.lit(0).alias("model"), "id", F.inline(F.array(*cells)))
    var = lambda name, sigma: part.select(name.alias("i")).distinct().select(F.lit(0).alias("model"), "i", F.col("i").alias("j"), F.lit(sigma * sigma).alias("v"))
    return views.boxes(spark, d), j, var(own, 0.4).unionByName(var(shared, 0.02))


@query(f"""WITH p AS (SELECT n.a, n.b, x.brand = y.brand AS same, x.cx_size AS ax, x.cy_size AS ay, y.cx_size AS bx, y.cy_size AS by_, x.cx_scale AS sax, x.cy_scale AS say, y.cx_scale AS sbx, y.cy_scale AS sby FROM {_NEAR} n JOIN {_BOUND} x ON x.id = n.a JOIN {_BOUND} y ON y.id = n.b)
  SELECT a, b, round(0.16 * (ax*ax + bx*bx) + 0.0004 * CASE WHEN same THEN pow(sax - sbx, 2) ELSE sax*sax + sbx*sbx END, 9) + 0.0 AS xx, round(0.16 * (ax*ay + bx*by_) + 0.0004 * CASE WHEN same THEN (sax - sbx) * (say - sby) ELSE sax*say + sbx*sby END, 9) + 0.0 AS xy,
  round(0.16 * (ay*ay + by_*by_) + 0.0004 * CASE WHEN same THEN pow(say - sby, 2) ELSE say*say + sby*sby END, 9) + 0.0 AS yy FROM p""")
def relative_covariances(spark: SparkSession, d: str) -> DataFrame:
    """How uncertain the centres of near boxes are, one against the other; what a brand's boxes share cancels."""
    boxes, extents, cov = _box_state(spark, d)
    pairs = materialise(geometry.overlapping(geometry.aabb(boxes))).select(F.lit(0).alias("model"), "a", "b")
    centres = geometry.centre_gradient(boxes).join(growing(extents.withColumnRenamed("v", "w")), ["id", "extent"]).groupBy("model", F.col("id").alias("entity"), "component", "var_id").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    found = belief.relative_covariances(centres, cov, pairs)
    cell = lambda p, q: (F.round(F.coalesce(F.max(F.when((F.col("p") == p) & (F.col("q") == q), F.col("v"))), F.lit(0.0)), 9) + 0.0).alias(p + q)
    return found.groupBy("a", "b").agg(cell("x", "x"), cell("x", "y"), cell("y", "y"))


_AXES = ", ".join(f"struct_pack(k := {k}, nx := cos({s}.yaw + {t!r}::double), ny := sin({s}.yaw + {t!r}::double))" for k, (s, t) in enumerate((s, t) for s in "xy" for t in (0.0, math.pi / 2)))
_GAP = """WITH p AS (SELECT n.a, n.b, x AS l, y AS r, unnest([""" + _AXES + f"""]) AS n FROM {_NEAR} n JOIN {_BOUND} x ON x.id = n.a JOIN {_BOUND} y ON y.id = n.b),
  q AS (SELECT *, CASE WHEN (r.cx - l.cx) * n.nx + (r.cy - l.cy) * n.ny >= 0 THEN 1 ELSE -1 END AS s, abs(n.nx*cos(l.yaw) + n.ny*sin(l.yaw)) / 2 AS lx, abs(n.ny*cos(l.yaw) - n.nx*sin(l.yaw)) / 2 AS ly, abs(n.nx*cos(r.yaw) + n.ny*sin(r.yaw)) / 2 AS rx, abs(n.ny*cos(r.yaw) - n.nx*sin(r.yaw)) / 2 AS ry FROM p),
  g AS (SELECT *, s * ((r.cx - l.cx) * n.nx + (r.cy - l.cy) * n.ny) - lx*l.ex - ly*l.ey - rx*r.ex - ry*r.ey AS gap FROM q), w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(gap, 9) DESC, n.k) = 1),
  d AS (SELECT a, b, gap, n.k AS axis, l.brand = r.brand AS same, -s*(n.nx*l.cx_size + n.ny*l.cy_size) - lx/50 - ly/100 AS dl, s*(n.nx*r.cx_size + n.ny*r.cy_size) - rx/50 - ry/100 AS dr, -s*(n.nx*l.cx_scale + n.ny*l.cy_scale) - lx*l.ex - ly*l.ey AS sl, s*(n.nx*r.cx_scale + n.ny*r.cy_scale) - rx*r.ex - ry*r.ey AS sr FROM w)
  SELECT a, b, axis, gap, 0.16 * (dl*dl + dr*dr) + 0.0004 * CASE WHEN same THEN pow(sl + sr, 2) ELSE sl*sl + sr*sr END AS var FROM d"""


@query(f"SELECT a, b, round(gap, 7) + 0.0 AS clearance, round(var, 9) AS variance, round({scalars.normal_cdf_sql('((0.01e0 - gap) / sqrt(var))')}, 6) AS p FROM ({_GAP})")
def clearance_risks(spark: SparkSession, d: str) -> DataFrame:
    """The clearance of near boxes along their best flat axis, its variance by its own gradient over both boxes' state, and
    the chance that they clash."""
    boxes, extents, cov = _box_state(spark, d)
    pairs = materialise(geometry.overlapping(geometry.aabb(boxes)))
    apart = materialise(decision.flat_clearance(geometry.sided(pairs, boxes)))
    gradient = decision.clearance_gradient(apart).select("pair", "id", "extent", "v")
    rows = gradient.join(growing(extents.withColumnRenamed("v", "w")), ["id", "extent"]).groupBy("model", F.col("pair").alias("out_var"), "var_id").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    own = rows.select("model", F.col("out_var").alias("a"), F.col("out_var").alias("b")).distinct()
    var = belief.pair_covariances(rows, cov, own).select(F.col("a").alias("pair"), F.col("var_a").alias("variance"))
    found = geometry.pair_risk(apart.join(growing(var), "pair"))
    return rounded(rounded(rounded(found, 7, "clearance"), 9, "variance"), 6, "p").select("a", "b", (F.col("clearance") + 0.0).alias("clearance"), "variance", "p")


@query("""WITH l AS (SELECT l_suppkey AS model, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS q, l_extendedprice / l_quantity AS p, l_discount AS d FROM lineitem),
  k AS (SELECT model, q*p*(1-d) AS x, pow(p*(1-d)*0.5, 2) + pow(q*(1-d)*0.08*p, 2) + pow(q*p*0.002, 2) + pow(q*p*(1-d)*0.01, 2) AS v, row_number() OVER (PARTITION BY model ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM l)
  SELECT a.model, count(*) AS pairs, round(sum(a.x * b.x * 0.0001), 2) AS cov, round(sum(sqrt(a.v * b.v)), 2) AS scale FROM k a JOIN k b ON a.model = b.model AND b.place = a.place + 1 GROUP BY a.model""")
def cross_entity_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Net values in another currency rest on a rate that a model's lines share: covariances of each line with the next."""
    net = {"Gross": [(1, ("Qty", "Price"))], "Net": [(1, ("Gross", "Fx")), (-1, ("Gross", "Disc", "Fx"))]}
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = rules.with_gradient(views.wide(spark, d, *order), net, only=["Net"])
    found = rules.neighbour_covariances(rows, net, "Net", views.SHARED, order)
    return rounded(found.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.sum("cov").alias("cov"), F.sum(F.sqrt(F.col("var_a") * F.col("var_b"))).alias("scale")), 2, "cov", "scale")


@query(f"""WITH g AS (SELECT user_id AS model, event_type AS k, sum(value / {_R}) / sum(1 / {_R}) - 50.0 AS e, 900.0::double + 1 / sum(1 / {_R}) AS t FROM events GROUP BY 1, 2), m AS (SELECT model, sum(1 / t) AS one, sum(e / t) AS et FROM g GROUP BY 1),
  x AS (SELECT model, k, e / t - 1 / t * et * 400 / (1 + 400 * one) AS x FROM g JOIN m USING (model)) SELECT model, k AS var_id, 'SOLVED' AS status, round(900 * x + 400 * sum(x) OVER (PARTITION BY model), 6) AS shift FROM x""")
def joint_conditioning(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of event of a user is a variable (prior 50, variance 1300, and 400 in common with each other kind); the kinds'
    readings condition all of a user's variables at once."""
    r = views.readings(spark, d)
    sums = r.groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("obs")).agg(F.sum(F.col("y") / F.col("r")).alias("wy"), F.sum(1 / F.col("r")).alias("w"))
    sums = materialise(sums)
    readings = sums.select("model", "obs", (F.col("wy") / F.col("w") - 50).alias("innovation"), (1 / F.col("w")).alias("r"))
    rows = sums.select("model", "obs", F.col("obs").alias("var_id"), F.lit(1.0).alias("h"))
    # a user has as many variables as there are kinds
    cov = sums.select("model", F.col("obs").alias("i")).join(sums.select("model", F.col("obs").alias("j")), "model").select("model", "i", "j", F.when(F.col("i") == F.col("j"), 1300.0).otherwise(400.0).alias("v"))
    shift, told = belief.conditioned_jointly(cov, rows, readings)
    return rounded(shift.join(told.select("model", "status"), "model").select("model", "var_id", "status", "shift"), 6, "shift")


@query(f"""SELECT model, 'CHANGED' AS change, count(*) AS n FROM ({_LINES}) WHERE l_returnflag = 'R' AND d > 0 AND q > 40 AND model % 3 = 0 GROUP BY 1 UNION ALL SELECT model, 'REMOVED', count(*) FROM ({_LINES}) WHERE l_returnflag = 'A' AND q > 49 AND model % 3 = 1 GROUP BY 1""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the lines, of which the second lacks a few and has others without discount, compared by their trees."""
    rows = views.lines(spark, d)
    small = F.col("model") % 3
    gone = (F.col("l_returnflag") == "A") & (F.col("qty") > 49) & (small == 1)
    free = (F.col("l_returnflag") == "R") & (F.col("qty") > 40) & (small == 0)
    after = rows.where(~gone).withColumn("disc", F.when(free, 0.0).otherwise(F.col("disc")))
    top = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    keys = ["model", "entity"]
    for name, version in (("one", rows), ("two", after)):
        snapshots.write(version, keys, f"{top}/{name}")
    return snapshots.changes(spark, f"{top}/one", f"{top}/two", keys).groupBy("model", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT model, CASE WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'base' END AS part, count(*) AS n, round(sum(q*p*(1 - CASE WHEN l_returnflag = 'R' THEN 0 ELSE d END)*(1+t)), 3) AS charge FROM ({_LINES}) GROUP BY 1, 2")
def overlaid_values(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines lose their discount: these alone are evaluated and written, beside the values of all lines."""
    wide = views.wide(spark, d).select("model", "entity", *rules.free(views.RULES))  # values rest on no deviation
    changed = views.lines(spark, d).where("l_returnflag = 'R'").select("model", "entity", F.lit(0.0).alias("Disc"))
    top = f"{shared_dir(spark)}/values-{uuid.uuid4().hex}"
    rules.write_base(wide, views.RULES, top)
    rules.write_overlay(spark, top, changed, views.RULES, "returned")
    now = rules.read_version(spark, top, "returned", part="part")
    return rounded(now.groupBy("model", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("Charge").alias("charge")), 3, "charge")


#: Two poses at which the sums of a step are taken.
_POSES = [registration.Pose(0.05, -0.03, 0.02, 0.3), registration.Pose(0.0, 0.1, 0.0, -1.2)]
_AT = " UNION ALL ".join(f"SELECT {k} AS pose, {p.x}::double AS tx, {p.y}::double AS ty, {p.z}::double AS tz, {p.yaw}::double AS yaw" for k, p in enumerate(_POSES))


@query(f"""WITH g AS (SELECT part, w, mx, my, mz, vx + 0.0064 AS vx, vy + 0.0064 AS vy, vz + 0.0064 AS vz FROM {_PARTS}), o AS (SELECT ln(0.05) - ln((max(mx) - min(mx) + 2) * (max(my) - min(my) + 2) * (max(mz) - min(mz) + 2)) AS flat FROM g),
  q AS (SELECT pose, id, cos(yaw)*x - sin(yaw)*y + tx AS x, sin(yaw)*x + cos(yaw)*y + ty AS y, z + tz AS z, -(sin(yaw)*x + cos(yaw)*y) AS jx, cos(yaw)*x - sin(yaw)*y AS jy FROM {_PTS}, ({_AT})),
  l AS (SELECT *, ln(0.95) + ln(w) - 1.5*ln(2*pi()) - ({_SUM("0.5*ln(v?) + pow(?-m?,2)/(2*v?)")}) AS l FROM q, g, o), s AS (SELECT *, sum(exp(l)) OVER (PARTITION BY pose, id) + exp(flat) AS total FROM l), r AS (SELECT *, exp(l) / total AS share FROM s),
  n AS (SELECT pose, count(*) AS n, avg(-ln(total)) AS nll FROM (SELECT DISTINCT pose, id, total FROM s) GROUP BY pose)
  SELECT r.pose, any_value(n) AS n, round(any_value(nll), 6) AS nll, round(sum(share*(x-mx)/vx), 4) AS g_x, round(sum(share*(jx*(x-mx)/vx + jy*(y-my)/vy)), 4) AS g_yaw, round(sum(share/vz), 3) AS h_z_z, round(sum(share*jx/vx), 3) AS h_x_yaw, round(sum(share*(jx*jx/vx + jy*jy/vy)), 3) AS h_yaw_yaw FROM r JOIN n ON n.pose = r.pose GROUP BY r.pose""")
def registration_step(spark: SparkSession, d: str) -> DataFrame:
    """The sums of a Gauss-Newton step at two poses, in one pass over the points."""
    from belvane.plans.catalog import _mixture

    points, parts = _mixture(spark, d)
    zero = F.lit(0.0)
    shaped = parts.select(F.col("part").cast("string").alias("part"), "weight", *[f"mean_{a}" for a in "xyz"], *[F.col(f"var_{a}").alias(f"s_{a}{a}") for a in "xyz"], zero.alias("s_xy"), zero.alias("s_xz"), zero.alias("s_yz"))
    found = registration.pose_sums(points, registration.mixture(shaped, smooth=0.08), _POSES)
    found = rounded(rounded(rounded(found, 6, "nll"), 4, "g_x", "g_yaw"), 3, "h_z_z", "h_x_yaw", "h_yaw_yaw")
    return found.select("pose", "n", "nll", "g_x", "g_yaw", "h_z_z", "h_x_yaw", "h_yaw_yaw")


#: Rooms from parts: an opening of W by H, a floor of F; a width costs 1000 a metre.
_ROOM_RULES = {"Opening": [(1, ("W", "H"))], "Cost": [(1000, ("W",)), (50, ("F",))], "Wall": [(4, ("F",)), (-1, ("W", "H"))]}
_ROOMS = "(SELECT p_partkey AS room, 0.5::double + p_size / 50.0::double AS w, 2.0::double AS h, 8.0::double + p_size / 10.0::double AS f FROM part)"


def _rooms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    size = F.col("p_size").cast("double")
    return p.select(F.lit(0).alias("model"), F.col("p_partkey").alias("entity"), (0.5 + size / 50).alias("W"), F.lit(0.05).alias("s_W"), F.lit(2.0).alias("H"), F.lit(0.02).alias("s_H"), (8 + size / 10).alias("F"), F.lit(0.1).alias("s_F"))


@query(f"""WITH v AS (SELECT *, w*h/f AS ratio, w*h - f + 2 * sqrt(pow(h*0.05, 2) + pow(w*0.02, 2) + pow(0.1, 2)) AS x FROM {_ROOMS})
  SELECT room, round(0.1 * w + 0.005 * f + 400 * pow(ratio - 0.1, 2) + 0.02 * 0.5 * (4*f - w*h) + 2 * ln(1 + exp(least(x / 0.01, 40))), 6) AS objective, round(0.1 + 800 * (ratio - 0.1) * h/f - 0.01 * h + 200 / (1 + exp(-greatest(least(x / 0.01, 40), -40))) * h, 6) AS g_w FROM v""")
def layout_objective(spark: SparkSession, d: str) -> DataFrame:
    """What each room costs by all aims, and the derivative by its opening's width; an opening is to be smaller than the floor."""
    aim = layout.Objective("Cost", "Opening", "F", {"Wall": 0.5}, (("Opening", "F"),))
    found = layout.evaluated(_rooms(spark, d), _ROOM_RULES, aim, ["W"])
    return rounded(found.select(F.col("entity").alias("room"), "objective", F.col("g_W").alias("g_w")), 6, "objective", "g_w")


@query(f"""WITH o AS (SELECT *, f/h * (0.1 - (0.1 - 0.01*h) * f / (800*h)) AS best FROM {_ROOMS}) SELECT room, round(best, 2) AS width, round(best * h / f, 2) AS ratio, true AS converged FROM o""")
def layout_optimum(spark: SparkSession, d: str) -> DataFrame:
    """The width of each room's opening that costs least, found by descent and set as an intervention."""
    rooms = _rooms(spark, d)
    found = materialise(layout.optimised(rooms, _ROOM_RULES, layout.Objective("Cost", "Opening", "F", {"Wall": 0.5}), ["W"], rounds=400))
    after = rules.evaluated(rules.with_changes(rooms, "W", layout.interventions(found, "W"), "set"), _ROOM_RULES)
    told = after.join(found.select("model", "entity", "converged"), ["model", "entity"])
    return told.select(F.col("entity").alias("room"), F.round("W", 2).alias("width"), F.round(F.col("Opening") / F.col("F"), 2).alias("ratio"), "converged")


@query(f"SELECT model, bool_or(l_returnflag = 'R' AND d > 0 AND q = 50) AS changed FROM ({_LINES}) GROUP BY model")
def digest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which models' beliefs have another digest after some lines lost their discount; the rows are dealt anew meanwhile."""
    wide = views.wide(spark, d)
    changes = views.lines(spark, d).where("l_returnflag = 'R' and qty = 50").select("model", "entity", F.lit(0.0).alias("value"), F.lit(0.002).alias("design_sigma"))
    long = lambda w: w.select("model", F.inline(F.array(*[F.struct(F.concat(F.col("entity"), F.lit(f".{q}")).alias("var_id"), F.col(q).cast("double").alias("mu"), F.col(f"s_{q}").alias("sigma")) for q in views.OWN])))
    before = belief.belief_digest(long(wide)).withColumnRenamed("digest", "before")
    after = belief.belief_digest(long(rules.with_changes(wide, "Disc", changes, "set")).repartition("var_id"))
    return before.join(after, ["model", "n"]).select("model", (F.col("before") != F.col("digest")).alias("changed"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 101 = 0), n AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_custkey IN (SELECT c FROM a)),
  f AS (SELECT 'o' AS kind, o_custkey IN (SELECT c FROM a) AS changed FROM orders UNION ALL SELECT 'c', c_nationkey IN (SELECT n FROM n) FROM customer UNION ALL SELECT 's', s_nationkey IN (SELECT n FROM n) FROM supplier UNION ALL
  SELECT 'n', n_nationkey IN (SELECT n FROM n) FROM nation UNION ALL SELECT 'r', r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT n FROM n)) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)) SELECT kind, count(*) AS n, count(*) FILTER (changed) AS changed FROM f GROUP BY 1""")
def configuration_changes(spark: SparkSession, d: str) -> DataFrame:
    """Some orders leave their customer: whose surroundings, three steps far, are others then?"""
    rel = views.relations(spark, d)
    nodes = rel.select(F.col("source").alias("node")).unionByName(rel.select(F.col("target").alias("node"))).distinct().withColumn("label", F.substring("node", 1, 1))
    left = rel.where(~((F.col("kind") == "contains") & (F.substring("target", 2, 20).cast("long") % 101 == 0)))
    one, two = graph.relabel(nodes, rel), graph.relabel(nodes, left).withColumnRenamed("label", "after")
    both = one.join(two, "node").groupBy(F.substring("node", 1, 1).alias("kind"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") != F.col("after"), 1)).alias("changed"))
