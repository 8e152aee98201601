"""Registered queries over geometry, scans, sections and logs, each beside its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belvane.functions import scalars
from belvane.operators import decision, geometry, graph, ledger, lowering, scan
from belvane.plans import views
from belvane.plans.catalog import _AABB, _BOX, _PTS, _REL, _mixture, query, rounded
from belvane.sources.tables import materialise, table

# 16 dimensions of the embeddings, so that a mixture is as wide as the data allow in text
_D = 16
_DIMS = [f"x{k}" for k in range(_D)]
_WIDE = f"(SELECT vec_id AS id, label, {', '.join(f'embedding[{k + 1}]::double AS x{k}' for k in range(_D))} FROM embeddings)"
_WPARTS = f"(SELECT label AS part, count(*)::double / (SELECT count(*) FROM embeddings) AS w, {', '.join(f'avg(x{k}) AS m{k}, var_pop(x{k}) AS v{k}' for k in range(_D))} FROM {_WIDE} GROUP BY label)"
_WLOG = f"ln(w) - {_D / 2} * ln(2 * pi()) - 0.5 * ({' + '.join(f'ln(v{k}) + pow(x{k} - m{k}, 2) / v{k}' for k in range(_D))})"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points of the first 16 dimensions, and the parts of a mixture by label."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[k].cast("double").alias(x) for k, x in enumerate(_DIMS)])
    n = p.count()
    g = p.groupBy(F.col("label").alias("part")).agg((F.count(F.lit(1)) / n).alias("weight"), *[F.avg(x).alias(f"mean_{x}") for x in _DIMS], *[F.var_pop(x).alias(f"var_{x}") for x in _DIMS])
    return p, g


@query(f"""WITH l AS (SELECT id, 0.95 * exp({_WLOG}) AS e FROM {_WIDE}, {_WPARTS}), s AS (SELECT id, -ln(sum(e) + 0.05 * 0.1) AS nll FROM l GROUP BY id) SELECT id, round(nll, 7) AS nll FROM s""")
def scan_likelihood(spark: SparkSession, d: str) -> DataFrame:
    points, parts = _points(spark, d)
    return rounded(scan.scored(scan.with_parts(points, parts, _DIMS), _DIMS).select("id", "nll"), 7, "nll")


@query(f"""WITH l AS (SELECT id, part, {', '.join(f'v{k}, x{k}, m{k}' for k in range(3))}, 0.95 * exp({_WLOG}) AS e FROM {_WIDE}, {_WPARTS}), r AS (SELECT *, e / (sum(e) OVER (PARTITION BY id) + 0.05 * 0.1) AS s FROM l)
  SELECT count(DISTINCT id) AS n, {', '.join(f'round(sum(s / v{k}), 5) AS a_x{k}, round(sum(s / v{k} * (m{k} - x{k})), 5) + 0.0 AS b_x{k}' for k in range(3))} FROM r""")
def registration_sums(spark: SparkSession, d: str) -> DataFrame:
    points, parts = _points(spark, d)
    names = [f"{s}_{x}" for x in _DIMS[:3] for s in ("a", "b")]
    found = rounded(scan.translation_sums(scan.scored(scan.with_parts(points, parts, _DIMS), _DIMS), _DIMS).select("n", *names), 5, *names)
    return found.withColumns({f"b_{x}": F.col(f"b_{x}") + 0.0 for x in _DIMS[:3]})


@query(f"""WITH l AS (SELECT id, part, v0, v1, 0.95 * exp({_WLOG}) AS e FROM {_WIDE}, {_WPARTS}), r AS (SELECT *, e / (sum(e) OVER (PARTITION BY id) + 0.05 * 0.1) AS s FROM l)
  SELECT count(DISTINCT id) AS n, round(sum(s / v0), 5) AS info_x0, round(1 / sqrt(sum(s / v0)), 9) AS sigma_x0, round(sum(s / v1), 5) AS info_x1, round(1 / sqrt(sum(s / v1)), 9) AS sigma_x1 FROM r""")
def pose_information(spark: SparkSession, d: str) -> DataFrame:
    points, parts = _points(spark, d)
    found = scan.pose_information(scan.scored(scan.with_parts(points, parts, _DIMS), _DIMS), _DIMS).select("n", "info_x0", "sigma_x0", "info_x1", "sigma_x1")
    return rounded(rounded(found, 5, "info_x0", "info_x1"), 9, "sigma_x0", "sigma_x1")


@query("SELECT label AS scan, count(*) AS n, count(*) FILTER (vec_id % 97 = 5) AS bad, CASE WHEN count(*) FILTER (vec_id % 97 = 5) > 0 THEN 'NOT_FINITE' WHEN count(*) < 3 THEN 'TOO_FEW' ELSE 'OK' END AS status FROM embeddings GROUP BY label")
def scan_validation(spark: SparkSession, d: str) -> DataFrame:
    x = lambda k: F.when(F.col("vec_id") % 97 == 5, F.lit(float("nan"))).otherwise(F.col("embedding")[k].cast("double"))
    return scan.valid_points(table(spark, d, "embeddings").select(F.col("label").alias("scan"), x(0).alias("x"), x(1).alias("y")), ["x", "y"])


@query("""WITH s AS (SELECT user_id AS face, (event_id % 7 + 1) / 8.0::double AS share, (value - 250) / 1000 AS gap, (user_id % 4) * 0.0001::double AS pose FROM events), f AS (SELECT face, count(*) AS points, sum(share) AS mass, sum(share * gap) / sum(share) AS offset_, sum(share * gap * gap) / sum(share) AS gg, max(pose) AS pose FROM s WHERE abs(gap) <= 0.2 GROUP BY 1),
  g AS (SELECT *, greatest(gg - offset_ * offset_, 0) AS spread FROM f)
  SELECT face, points, round(mass, 6) AS mass, round(offset_, 9) AS "offset", round((spread + 0.0001::double) / mass + pose, 9) AS variance, CASE WHEN mass < 12 THEN 'TOO_LITTLE_SUPPORT' WHEN sqrt(spread) > 0.118 THEN 'SPREAD' END AS reason FROM g""")
def face_readings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("face"), ((F.col("event_id") % 7 + 1) / 8.0).alias("share"), ((F.col("value") - 250) / 1000).alias("gap"), ((F.col("user_id") % 4) * 0.0001).alias("pose_var"))
    return rounded(rounded(scan.face_offset(s, band=0.2, noise=0.01, least_mass=12, most_spread=0.118), 6, "mass"), 9, "offset", "variance")


_RECT = "(SELECT p_partkey AS id, 0.2::double + p_size / 50.0::double AS b, 0.3::double + p_size / 100.0::double AS h FROM part)"


@query(f"SELECT id, round(b * h, 9) AS area, round(b / 2 + id % 7, 7) AS cx, round(h / 2 - 1, 7) AS cy, round(b * pow(h, 3) / 12, 7) AS ix, round(h * pow(b, 3) / 12, 7) AS iy, round(b * h * h / 6, 7) AS sx, round(h * b * b / 6, 7) AS sy FROM {_RECT}")
def section_properties(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles, every other one drawn clockwise."""
    box = views.boxes(spark, d).select("id", "ex", "ey")
    left, low = (F.col("id") % 7).cast("double"), F.lit(-1.0)
    corner = lambda k, x, y: F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y"))
    pts = box.select("id", F.inline(F.array(corner(0, left, low), corner(1, left + F.col("ex"), low), corner(2, left + F.col("ex"), low + F.col("ey")), corner(3, left, low + F.col("ey")))))
    turned = pts.withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")).otherwise(3 - F.col("k")))
    return rounded(rounded(geometry.sections(turned, "id", "k"), 9, "area"), 7, "cx", "cy", "ix", "iy", "sx", "sy")


@query(f"SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE round(2 * 24 * b * sin(pi() / 4 / 24), 9) END AS length, CASE WHEN id % 9 <> 0 AND id % 5 <> 0 THEN round(abs(2 * 24 * b * sin(pi() / 4 / 24) - 2 * 6 * b * sin(pi() / 4 / 6)), 9) END AS error, CASE WHEN id % 9 = 0 THEN 'BLOCKED' WHEN id % 5 = 0 THEN 'LENGTH_ONLY' ELSE 'COMPLETE' END AS status FROM {_RECT} WHERE NOT (id % 9 = 0 AND id % 5 = 0)")
def beam_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of quarter arcs of chords, by 24 and by 6; some have one of the two only."""
    arcs = views.boxes(spark, d).select("id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.col("ex").alias("radius"), F.lit(0.3).alias("start"), F.lit(math.pi / 2).alias("sweep"))
    length = lambda n: geometry.path_length(geometry.arc(arcs, n), "id", ["k"]).select("id", "length")
    found = geometry.derived_lengths(length(24).where("id % 9 <> 0"), length(6).where("id % 5 <> 0"))
    return rounded(found, 9, "length", "error")


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 'BLOCKED' WHEN id % 5 = 0 THEN 'LENGTH_ONLY' ELSE 'COMPLETE' END AS status FROM {_RECT} WHERE NOT (id % 9 = 0 AND id % 5 = 0)) GROUP BY 1")
def beam_summary(spark: SparkSession, d: str) -> DataFrame:
    return beam_geometry(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_SUM3 = lambda t: " + ".join(t.replace("?", x) for x in "xyz")
_PARTS3 = f"(SELECT label AS part, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz FROM {_PTS} GROUP BY label)"


@query(f"SELECT p.part AS a, q.part AS b, round({_SUM3('pow(p.m?-q.m?,2)/(p.v?+q.v?)')}, 9) AS m2 FROM {_PARTS3} p JOIN {_PARTS3} q ON p.part < q.part")
def mahalanobis_distances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.mahalanobis2(_mixture(spark, d)[1], ["x", "y", "z"]), 9, "m2")


_TILES = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n, ox + (i + 0.5) * ex / nx AS px, oy + ey / 2 AS py, pow(ex / nx, 2) / 12 AS vx, ey * ey / 12 AS vy FROM (SELECT *, unnest(range(nx)) AS i FROM (SELECT *, greatest(ceil(ex / 0.75::double), 1)::bigint AS nx FROM {_BOX})))"


@query(f"""WITH c AS (SELECT a.id AS a, b.id AS b FROM {_AABB} a JOIN {_AABB} b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), t AS (SELECT * FROM {_TILES})
  SELECT c.a, c.b, round(sum(exp(-0.5 * (3 * ln(2 * pi()) + pow(p.px-q.px,2)/(p.vx+q.vx) + pow(p.py-q.py,2)/(p.vy+q.vy) + ln(p.vx+q.vx) + ln(p.vy+q.vy) + ln(1.5)))), 7) AS mass FROM c JOIN t p ON p.id = c.a JOIN t q ON q.id = c.b GROUP BY 1, 2""")
def overlap_masses(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of boxes that may clash, taken as not turned, by tiles along their length."""
    boxes = views.boxes(spark, d)
    pairs = geometry.overlapping(geometry.aabb(boxes))
    nx = F.greatest(F.ceil(F.col("ex") / 0.75), F.lit(1))
    tiles = boxes.withColumn("nx", nx).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    tiles = tiles.select("id", "n", F.lit(1.0).alias("weight"), (F.col("ox") + (F.col("n") + 0.5) * F.col("ex") / F.col("nx")).alias("mean_x"), (F.col("oy") + F.col("ey") / 2).alias("mean_y"), F.lit(1.5).alias("mean_z"),
                         (F.pow(F.col("ex") / F.col("nx"), F.lit(2)) / 12).alias("var_x"), (F.col("ey") * F.col("ey") / 12).alias("var_y"), F.lit(0.75).alias("var_z"))
    return rounded(geometry.overlap_mass(pairs, tiles, tiles).select("a", "b", "mass"), 7, "mass")


@query(f"""WITH c AS (SELECT a.id AS a, b.id AS b, greatest(greatest(a.x0, b.x0) - least(a.x1, b.x1), greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS gap FROM {_AABB} a JOIN {_AABB} b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
  r AS (SELECT *, CASE WHEN (a + b) % 6 = 0 THEN 0 ELSE 0.01 * (1 + (a + b) % 3) END::double AS s FROM c) SELECT a, b, round(gap, 7) AS clearance, round(CASE WHEN s = 0 THEN (gap < 0.01)::int ELSE {scalars.normal_cdf_sql('((0.01 - gap) / s)')} END, 6) AS p, CASE WHEN s > 0 THEN round(gap / s, 6) END AS significance FROM r WHERE (a + b) % 4 <> 0""")
def clash_risks(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the broad phase that aren't exempt, with the chance that they clash."""
    boxes = geometry.aabb(views.boxes(spark, d))
    pairs = materialise(geometry.overlapping(boxes))
    exempt = pairs.where("(a + b) % 4 = 0")
    side = lambda s: boxes.select(F.col("id").alias(s), *[F.col(f"{k}{n}").alias(f"{k}{n}_{s}") for k in "xy" for n in (0, 1)])
    joined = pairs.join(exempt, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    gap = F.greatest(*[F.greatest(f"{k}0_a", f"{k}0_b") - F.least(f"{k}1_a", f"{k}1_b") for k in "xy"])
    sigma = F.when((F.col("a") + F.col("b")) % 6 == 0, 0.0).otherwise(0.01 * (1 + (F.col("a") + F.col("b")) % 3))
    found = geometry.pair_risk(joined.select("a", "b", gap.alias("clearance"), (sigma * sigma).alias("variance")))
    return rounded(rounded(found, 7, "clearance"), 6, "p", "significance").select("a", "b", "clearance", "p", "significance")


@query(f"SELECT element, CASE WHEN k = 1 THEN name ELSE name || '#' || k END AS label, round(payload, 6) AS payload FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY element) AS k FROM (SELECT p_partkey AS element, p_brand AS name, sum(l_quantity * l_discount) / sum(l_quantity) AS payload FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))")
def element_payloads(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("element"), F.col("p_brand").alias("name"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("payload"))
    return rounded(geometry.payload_means(tokens), 6, "payload")


@query(f"""WITH b AS (SELECT *, ox + ex / 2 AS mx, oy + ey / 2 AS my, 0.04::double AS var FROM {_BOX}), r AS (SELECT DISTINCT floor(oy) AS ray FROM b),
  d AS (SELECT ray, sum(exp(-pow(ray + 0.5 - my, 2) / (2 * var)) / (2 * pi() * var) * ({scalars.normal_cdf_sql('((25 - mx) / 0.2)')} - {scalars.normal_cdf_sql('((-5 - mx) / 0.2)')}) * 0.1) AS depth FROM r JOIN b ON floor(oy) = ray GROUP BY ray)
  SELECT ray, round(depth, 7) AS depth, round(exp(-depth), 7) AS transmittance FROM d""")
def ray_transmittance(spark: SparkSession, d: str) -> DataFrame:
    """A ray along each row of boxes, through as many Gaussians."""
    b = views.boxes(spark, d)
    parts = b.select(F.col("id").alias("part"), (F.col("ox") + F.col("ex") / 2).alias("mean_x"), (F.col("oy") + F.col("ey") / 2).alias("mean_y"), F.lit(1.5).alias("mean_z"), F.lit(0.2).alias("s"), F.lit(0.1).alias("weight")).withColumn("var", F.lit(0.04)).drop("s")
    rays = b.select(F.floor("oy").cast("double").alias("ray"), F.col("id").alias("part")).select("ray", "part", (F.col("ray") + 0.5).alias("y"), F.lit(1.5).alias("z"), F.lit(-5.0).alias("x0"), F.lit(25.0).alias("x1"))
    return rounded(geometry.transmittance(rays, parts), 7, "depth", "transmittance")


@query("""WITH p AS (SELECT user_id AS case_id, event_id AS check_id, event_type AS subject, value AS gain FROM events WHERE value > 300) SELECT sha256(concat(length(case_id::varchar), ':', case_id, '|', length(check_id::varchar), ':', check_id, '|', length(subject), ':', subject)) AS request_id, case_id, check_id, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, check_id) AS place FROM p""")
def evidence_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("check_id"), F.col("event_type").alias("subject"), F.col("value").alias("gain"), F.when(F.col("value") > 300, "OBSERVE").otherwise("DECISION_RESOLVED").alias("disposition"))
    return ledger.evidence_requests(e).select("request_id", "case_id", "check_id", "place")


@query("""SELECT kind, verdict, count(*) AS n, round(sum(lo), 6) AS p_lower, round(sum(hi), 6) AS p_upper FROM (SELECT 'clearance' AS kind, value / 1000 AS lo, value / 500 AS hi, CASE WHEN value > 400 THEN 'VIOLATED' ELSE 'SATISFIED' END AS verdict FROM events WHERE event_type = 'click' UNION ALL SELECT 'minimum', value / 500, value / 500, 'UNRESOLVED' FROM events WHERE event_type = 'view' UNION ALL SELECT 'difference', value / 600, value / 600, 'UNRESOLVED' FROM events WHERE event_type = 'error') GROUP BY 1, 2""")
def normalised_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("check_id", F.col("event_id"))
    clear = e.where("event_type = 'click'").select("check_id", (F.col("value") / 1000).alias("p_lower"), (F.col("value") / 500).alias("p_upper"), F.when(F.col("value") > 400, "VIOLATED").otherwise("SATISFIED").alias("verdict"))
    one = lambda kind, n: e.where(F.col("event_type") == kind).select("check_id", (F.col("value") / n).alias("p"), F.lit("UNRESOLVED").alias("verdict"))
    found = ledger.normalised_checks(clear, one("view", 500), one("error", 600))
    return rounded(found.groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("p_lower").alias("p_lower"), F.sum("p_upper").alias("p_upper")), 6, "p_lower", "p_upper")


@query("""SELECT found, same_kind, same_payload, bound, count(*) AS n FROM (SELECT event_id % 13 <> 0 AS found, event_id % 13 <> 0 AND event_type <> 'view' AS same_kind, event_id % 13 <> 0 AND event_id % 3 <> 0 AS same_payload, event_id % 13 <> 0 AND event_type <> 'view' AND event_id % 3 <> 0 AS bound FROM events) GROUP BY ALL""")
def bound_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests that name each event; some name a place that is not in the log, another kind, or another payload."""
    e = table(spark, d, "events")
    log = e.select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.sha2("props", 256).alias("payload"))
    m = e.select(F.col("user_id").alias("ledger"), F.when(F.col("event_id") % 13 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("seq"), F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type")).alias("its_kind"), F.when(F.col("event_id") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("props", 256)).alias("its_payload"))
    found = ledger.bound_manifests(m, log, {"same_kind": ("its_kind", "kind"), "same_payload": ("its_payload", "payload")})
    return found.groupBy("found", "same_kind", "same_payload", "bound").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(fault, 'GOOD') AS outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 17 = 0 THEN 'NOT_JSON' WHEN event_type = 'error' THEN 'UNKNOWN_OP' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'FIELDS' WHEN event_type = 'purchase' AND value < 100 THEN 'NOISE' END AS fault FROM events) GROUP BY 1")
def operation_codec(spark: SparkSession, d: str) -> DataFrame:
    """Operations written as JSON and read back; some are spoilt."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("y"), F.greatest(F.col("value") - 100, F.lit(0.0)).alias("r"), F.lit("x").alias("var"))
    e = e.withColumn("r", F.when(F.col("y") >= 100, F.col("r") + 1).otherwise(0.0))
    code = lambda kind, op, fields: ledger.encoded_operations(e.where(F.col("event_type") == kind), op, fields).select("event_id", "event_type", "body")
    all_ = code("purchase", "observe", ["var", "y", "r"]).unionByName(code("view", "shift", ["var", "y"])).unionByName(code("error", "explode", ["var"])).unionByName(code("click", "set", ["var", "y"])).unionByName(code("signup", "scale", ["var", "y"]))
    body = F.when(F.col("event_id") % 17 == 0, "{").when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), '{"op": "shift", "var": "x"}').otherwise(F.col("body"))
    found = ledger.operations(all_.withColumn("body", body), {"observe": ["var", "y", "r"], "shift": ["var", "y"], "set": ["var", "y"], "scale": ["var", "y"]})
    return found.groupBy(F.coalesce("fault", F.lit("GOOD")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS k, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f(user_id, n, mu) AS (SELECT DISTINCT user_id, 0::bigint, 100.0::double FROM events UNION ALL
  SELECT f.user_id, e.n, CASE e.k WHEN 'purchase' THEN e.v WHEN 'click' THEN mu + e.v WHEN 'view' THEN mu * 0.5 ELSE mu END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
  SELECT c.user_id AS model, c.accepted, c.rejected, c.other, round(f.mu, 6) AS mu FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'click', 'view')) AS accepted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'signup') AS other FROM events GROUP BY 1) c JOIN f ON f.user_id = c.user_id AND f.n = c.n""")
def replayed_logs(spark: SparkSession, d: str) -> DataFrame:
    log = ledger.sequence(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"]).join(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    op = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "click", "shift").when(F.col("event_type") == "view", "scale")
    status = F.when(F.col("event_type") == "error", "rejected").when(op.isNotNull(), "accepted").otherwise("note")
    found = ledger.replayed(log.select(F.col("user_id").alias("model"), "seq", status.alias("status"), op.alias("op"), F.when(op == "scale", 0.5).otherwise(F.col("value")).alias("value")), {"mu": 100.0})
    return rounded(found, 6, "mu")


@query(f"SELECT kind, count(*) AS n, count(*) AS same FROM {_REL} GROUP BY 1")
def same_configuration(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends get the same label though the edges are dealt and listed in another order."""
    rel = views.relations(spark, d)
    nodes = rel.select(F.col("source").alias("node")).union(rel.select("target")).distinct().withColumn("label", F.substring("node", 1, 1))
    labels = materialise(graph.relabel(nodes, rel))
    again = materialise(graph.relabel(nodes.repartition("node"), rel.orderBy(F.desc("target"))))
    kept = labels.join(again.withColumnRenamed("label", "again"), "node").where("label = again").select("node")
    both = rel.join(kept, F.col("source") == F.col("node"), "left_semi").join(kept, F.col("target") == F.col("node"), "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("same"))
    return rel.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(both, "kind")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN_STATUS' WHEN p_size % 5 = 1 THEN 'READY' WHEN p_size % 5 = 2 THEN 'BLOCKED' ELSE 'UNMATCHED' END AS status FROM part")
def bound_audit_statuses(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    told = part.where("p_size % 5 < 3").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "FINE").when(F.col("p_size") % 5 == 1, "READY").otherwise("BLOCKED").alias("status"))
    return lowering.bound_statuses(part.select(F.col("p_partkey").alias("id")), told, ["READY", "NEEDS_GEOMETRY", "MISSING", "BLOCKED"])


@query("SELECT o_custkey AS model, count(*) FILTER (o_orderkey % 3 = 0) AS computed, count(*) FILTER (o_orderkey % 3 <> 0) AS reused FROM orders GROUP BY 1")
def reused_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of orders are known by the digest of what they rest on; every third order's price has changed since."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("demand"))
    known = decision.decided(o.withColumn("demand", F.when(F.col("id") % 3 == 0, F.col("demand") + 1).otherwise(F.col("demand"))), F.col("demand") > 100_000, ["id", "demand"])
    found = decision.with_reuse(o, known, F.col("demand") > 100_000, ["id", "demand"])
    return found.groupBy("model").agg(F.count(F.when(~F.col("reused"), 1)).alias("computed"), F.count(F.when(F.col("reused"), 1)).alias("reused"))
