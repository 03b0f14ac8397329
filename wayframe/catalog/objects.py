"""Queries for actors, lights, routes and sample assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.views import actors, egos, lights, r6, route_points
from wayframe.operators import assemble as A
from wayframe.operators import joins as J
from wayframe.operators import quality as QU
from wayframe.operators import route as RO

ARRIVAL = ["line", "part", "supp", "cents"]


@query("nearby_actors", f"WITH {Q.NEARBY} SELECT tick, line, part, supp, cents FROM near")
def _(spark, sf):
    return J.nearby_actors(egos(spark, sf), actors(spark, sf)).select("tick", *ARRIVAL)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.object_tokens(J.nearby_actors(egos(spark, sf_dir), actors(spark, sf_dir)))


FLOATS = ["x_ego", "y_ego", "yaw", "vx", "vy", "length", "width"]


@query(
    "object_tokens",
    f"WITH {Q.TOKENS} SELECT tick, line, part, supp, cents, type_id, oncoming_flag, priority_flag, "
    f"{Q.r6('sin(yaw)', 'sin_yaw')}, {Q.r6('cos(yaw)', 'cos_yaw')}, {', '.join(Q.r6(c, c) for c in FLOATS)} FROM tokens",
)
def _(spark, sf):
    return tokens(spark, sf).select(
        "tick", *ARRIVAL, "type_id", "oncoming_flag", "priority_flag", r6("sin_yaw"), r6("cos_yaw"), *[r6(c) for c in FLOATS]
    )


@query(
    "near_light",
    f"""WITH {Q.EGOS},{Q.LIGHTS} SELECT tick, EXISTS (SELECT 1 FROM lights l WHERE l.tick = egos.tick
  AND sqrt(stop_x * stop_x + stop_y * stop_y) < 15) AS near_light FROM egos""",
)
def _(spark, sf):
    return J.near_light(egos(spark, sf).select("tick"), lights(spark, sf)).select("tick", "near_light")


@query(
    "traffic_violation",
    f"""WITH {Q.EGOS},{Q.LIGHTS} SELECT tick, tick % 11 = 0 OR EXISTS (SELECT 1 FROM lights l WHERE l.tick = egos.tick
  AND stop_x BETWEEN 0 AND 8 AND abs(stop_y) <= 8 AND state IN (0, 1)) AS stop_line_violation FROM egos""",
)
def _(spark, sf):
    out = J.traffic_violation(egos(spark, sf).select("tick"), lights(spark, sf), lane_event=F.col("tick") % 11 == 0)
    return out.select("tick", "stop_line_violation")


@query(
    "route_geometry",
    f"""WITH {Q.ROUTES},
st AS (SELECT *, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS by_, lead(x) OVER w - x AS ax, lead(y) OVER w - y AS ay
       FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
d AS (SELECT *, coalesce(sqrt(bx * bx + by_ * by_), 0) AS d FROM st),
s AS (SELECT *, sum(d) OVER (PARTITION BY route_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s, sum(d) OVER (PARTITION BY route_id) AS total FROM d)
SELECT route_id, idx, {Q.r6('coalesce(bx, ax, 0)', 'dx')}, {Q.r6('coalesce(by_, ay, 0)', 'dy')},
  {Q.r6('CASE WHEN total > 0 THEN s / total ELSE 0 END', 's_frac')},
  {Q.r6('coalesce(abs(bx * ay - by_ * ax) / (sqrt(bx * bx + by_ * by_) * sqrt(ax * ax + ay * ay) + 1e-6), 0)', 'curvature')} FROM s""",
)
def _(spark, sf):
    out = RO.route_geometry(route_points(spark, sf))
    return out.select("route_id", "idx", r6("dx"), r6("dy"), r6("s_frac"), r6("curvature"))


@query(
    "drop_consumed",
    f"""WITH {Q.ROUTES},
f AS (SELECT *, coalesce(lead(x, 7) OVER w, last_value(x) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fx,
             max(idx) OVER (PARTITION BY route_id) AS mx FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
s AS (SELECT *, coalesce(min(CASE WHEN x >= 0 AND fx >= 1 THEN idx END) OVER (PARTITION BY route_id), mx) AS st FROM f)
SELECT route_id, idx FROM s WHERE idx >= st""",
)
def _(spark, sf):
    return RO.drop_consumed(route_points(spark, sf)).select("route_id", "idx")


@query(
    "resample_polyline",
    f"""WITH RECURSIVE {Q.ROUTES},
walk AS (SELECT route_id, idx, x, y, 0e0 AS run, 1 AS kept, true AS emit FROM route_points WHERE idx = 0
  UNION ALL
  SELECT p.route_id, p.idx, p.x, p.y,
    CASE WHEN w.run + sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) >= 2 THEN 0e0
         ELSE w.run + sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) END,
    w.kept + CASE WHEN w.run + sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) >= 2 AND w.kept < 8 THEN 1 ELSE 0 END,
    w.run + sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) >= 2 AND w.kept < 8
  FROM walk w JOIN route_points p ON p.route_id = w.route_id AND p.idx = w.idx + 1)
SELECT route_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY idx) - 1 AS INTEGER) AS idx, {Q.r6('x', 'x')}, {Q.r6('y', 'y')} FROM walk WHERE emit""",
)
def _(spark, sf):
    out = RO.resample_polyline(route_points(spark, sf), k=8)
    return out.select("route_id", "idx", r6("x"), r6("y"))


@query(
    "describe_route",
    f"""WITH {Q.ROUTES},
e AS (SELECT route_id, degrees(atan2(arg_min(y, idx), arg_min(x, idx))) AS h0, degrees(atan2(arg_max(y, idx), arg_max(x, idx))) AS h1,
             sqrt(pow(arg_max(x, idx), 2) + pow(arg_max(y, idx), 2)) AS d FROM route_points WHERE idx <= 7 GROUP BY 1),
t AS (SELECT *, h1 - h0 + 180 - 360 * floor((h1 - h0 + 180) / 360) - 180 AS turn FROM e)
SELECT route_id, CASE WHEN abs(turn) < 15 THEN 'continue straight' WHEN turn > 0 THEN 'curving left' ELSE 'curving right' END AS shape,
  {Q.r6('turn', 'turn')}, {Q.r6('h0', 'first_heading')}, {Q.r6('h1', 'far_heading')}, {Q.r6('d', 'far_dist')} FROM t""",
)
def _(spark, sf):
    out = RO.describe_route(route_points(spark, sf))
    return out.select("route_id", "shape", r6("turn"), r6("first_heading"), r6("far_heading"), r6("far_dist"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with route, objects and a short future, each child cut from its own table."""
    poses = egos(spark, sf_dir)
    route = route_points(spark, sf_dir).withColumn("tick", F.col("route_id") % 100_000)
    future = lights(spark, sf_dir).select("tick", F.lit(1).alias("i"), F.col("stop_x").alias("x"), F.col("stop_y").alias("y"), F.lit(3.0).alias("v"))
    return A.assemble_samples(
        poses, route, tokens(spark, sf_dir), future, ["tick"],
        route_order=["route_id", "idx"], object_order=ARRIVAL, future_order=["i", "x", "y"], k=6, m=2, n=3,
    )


SAMPLES = Q.ROUTES + "," + Q.TOKENS + "," + Q.LIGHTS + """,
rt AS (SELECT route_id % 100000 AS tick, x, y, row_number() OVER (PARTITION BY route_id % 100000 ORDER BY route_id, idx) AS j FROM route_points),
ob AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY line, part, supp, cents) AS j FROM tokens),
fu AS (SELECT tick, stop_x, stop_y, row_number() OVER (PARTITION BY tick ORDER BY stop_x, stop_y) AS j FROM lights)"""


@query(
    "assemble_samples_route",
    f"""WITH {SAMPLES} SELECT e.tick, CAST(g.j AS INTEGER) AS j, {Q.r6('coalesce(rt.x, 0)', 'x')}, {Q.r6('coalesce(rt.y, 0)', 'y')}
FROM egos e CROSS JOIN range(1, 7) g(j) LEFT JOIN rt ON rt.tick = e.tick AND rt.j = g.j""",
)
def _(spark, sf):
    s = samples(spark, sf).select("tick", F.posexplode("route").alias("p", "q"))
    return s.select("tick", (F.col("p") + 1).alias("j"), r6(F.col("q")[0], "x"), r6(F.col("q")[1], "y"))


@query(
    "assemble_samples_objects",
    f"""WITH {SAMPLES} SELECT e.tick, CAST(g.j AS INTEGER) AS j, CASE WHEN ob.tick IS NULL THEN 0e0 ELSE 1e0 END AS mask,
  coalesce(CAST(type_id AS DOUBLE), 0) AS type_id, {Q.r6('coalesce(x_ego, 0)', 'x')}, {Q.r6('coalesce(cos(yaw), 0)', 'cos_yaw')}, {Q.r6('coalesce(vy, 0)', 'vy')}
FROM egos e CROSS JOIN range(1, 3) g(j) LEFT JOIN ob ON ob.tick = e.tick AND ob.j = g.j""",
)
def _(spark, sf):
    z = F.arrays_zip("objects", "object_mask")
    s = samples(spark, sf).select("tick", F.posexplode(z).alias("p", "q"))
    o = F.col("q.objects")
    return s.select(
        "tick", (F.col("p") + 1).alias("j"), F.col("q.object_mask").alias("mask"), o[0].alias("type_id"),
        r6(o[1], "x"), r6(o[4], "cos_yaw"), r6(o[8], "vy"),
    )


@query(
    "assemble_samples_futures",
    f"""WITH {SAMPLES} SELECT e.tick, CAST(g.j AS INTEGER) AS j, CASE WHEN fu.tick IS NULL THEN 0e0 ELSE 1e0 END AS mask,
  coalesce(stop_x, 0) AS x, coalesce(stop_y, 0) AS y, CASE WHEN fu.tick IS NULL THEN 0e0 ELSE 3e0 END AS v
FROM egos e CROSS JOIN range(1, 4) g(j) LEFT JOIN fu ON fu.tick = e.tick AND fu.j = g.j""",
)
def _(spark, sf):
    z = F.arrays_zip("future_xy", "future_v", "future_mask")
    s = samples(spark, sf).select("tick", F.posexplode(z).alias("p", "q"))
    return s.select(
        "tick", (F.col("p") + 1).alias("j"), F.col("q.future_mask").alias("mask"),
        F.col("q.future_xy")[0].alias("x"), F.col("q.future_xy")[1].alias("y"), F.col("q.future_v").alias("v"),
    )


@query(
    "audit_completeness",
    f"""WITH {Q.TOKENS},{Q.LIGHTS}
SELECT tick, CAST(NULL AS BIGINT) AS actor_id, 'no_raster' AS problem FROM egos WHERE NOT EXISTS (SELECT 1 FROM actors a WHERE a.tick = egos.tick)
UNION ALL
SELECT tick, NULL, 'no_futures' FROM egos WHERE NOT EXISTS (SELECT 1 FROM lights l WHERE l.tick = egos.tick)
UNION ALL
SELECT tick, cents, 'no_token' FROM actors WHERE NOT EXISTS (SELECT 1 FROM tokens t WHERE t.tick = actors.tick AND t.cents = actors.cents)""",
)
def _(spark, sf):
    seen = actors(spark, sf).withColumn("actor_id", F.col("cents"))
    done = tokens(spark, sf).withColumn("actor_id", F.col("cents"))
    return QU.audit_completeness(egos(spark, sf), seen.select("tick"), lights(spark, sf), seen, done, ["tick"])


@query(
    "in_window",
    f"WITH {Q.LIGHTS} SELECT tick, tl_id, stop_x, stop_y FROM lights WHERE abs(stop_x) <= 10 AND abs(stop_y) <= 10",
)
def _(spark, sf):
    from wayframe.functions.geometry import in_window

    return lights(spark, sf).where(in_window("stop_x", "stop_y", 20.0)).select("tick", "tl_id", "stop_x", "stop_y")
