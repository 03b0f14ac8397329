"""Queries for geometry, command and normalisation expressions, and value checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.views import actors, egos, frames, r6, route_points, table, tensors
from wayframe.functions import geometry as G
from wayframe.functions import normalise as N
from wayframe.operators import quality as QU

KEY = ["episode_ord", "frame_id"]


@query(
    "to_ego_xy",
    f"""WITH {Q.EGOS},{Q.ACTORS} SELECT tick, line, part, supp, cents,
  {Q.r6('(x_w - ego_x) * cos(radians(ego_yaw)) + (y_w - ego_y) * sin(radians(ego_yaw))', 'x')},
  {Q.r6('(y_w - ego_y) * cos(radians(ego_yaw)) - (x_w - ego_x) * sin(radians(ego_yaw))', 'y')} FROM actors JOIN egos USING (tick)""",
)
def _(spark, sf):
    x, y = G.to_ego_xy("x_w", "y_w", "ego_x", "ego_y", "ego_yaw")
    j = actors(spark, sf).join(egos(spark, sf), "tick")
    return j.select("tick", "line", "part", "supp", "cents", r6(x, "x"), r6(y, "y"))


@query(
    "rotate_to_ego",
    f"""WITH {Q.FRAMES} SELECT episode_ord, frame_id,
  {Q.r6('accel_long * cos(radians(sun_azimuth)) + accel_lat * sin(radians(sun_azimuth))', 'ax')},
  {Q.r6('accel_lat * cos(radians(sun_azimuth)) - accel_long * sin(radians(sun_azimuth))', 'ay')} FROM frames""",
)
def _(spark, sf):
    ax, ay = G.rotate_to_ego("accel_long", "accel_lat", "sun_azimuth")
    return frames(spark, sf).select(*KEY, r6(ax, "ax"), r6(ay, "ay"))


@query(
    "wrap_pi",
    f"""WITH {Q.FRAMES}, a AS (SELECT episode_ord, frame_id, radians(sun_azimuth * 3 - 1000) AS a FROM frames)
SELECT episode_ord, frame_id, {Q.r6('CASE WHEN a > pi() THEN a - 2 * pi() * ceil((a - pi()) / (2 * pi())) WHEN a < -pi() THEN a + 2 * pi() * ceil((-a - pi()) / (2 * pi())) ELSE a END', 'a')} FROM a""",
)
def _(spark, sf):
    a = F.radians(F.col("sun_azimuth") * 3 - 1000)
    return frames(spark, sf).select(*KEY, r6(G.wrap_pi(a), "a"))


@query(
    "wrap_deg",
    f"""WITH {Q.FRAMES}, a AS (SELECT episode_ord, frame_id, sun_azimuth * 3 - 1080 AS a FROM frames)
SELECT episode_ord, frame_id, a + 180 - 360 * floor((a + 180) / 360) - 180 AS a FROM a""",
)
def _(spark, sf):
    return frames(spark, sf).select(*KEY, G.wrap_deg(F.col("sun_azimuth") * 3 - 1080).alias("a"))


@query(
    "kinematics",
    f"""WITH {Q.FRAMES} SELECT episode_ord, frame_id, {Q.r6('sqrt(accel_long * accel_long + accel_lat * accel_lat + yaw_rate * yaw_rate)', 'norm')},
  {Q.r6('yaw_rate / greatest(speed_mps, 5e-1)', 'curvature')}, {Q.r6('atan(2875e-3 * yaw_rate / greatest(speed_mps, 5e-1))', 'steer_angle')} FROM frames""",
)
def _(spark, sf):
    curv = G.path_curvature("yaw_rate", "speed_mps")
    norm = G.speed3("accel_long", "accel_lat", "yaw_rate")
    return frames(spark, sf).select(*KEY, r6(norm, "norm"), r6(curv, "curvature"), r6(G.steer_angle(curv), "steer_angle"))


@query(
    "repair_speed_limit",
    f"""WITH {Q.FRAMES}, v AS (SELECT episode_ord, frame_id, CASE WHEN speed_limit_kmh > 30 THEN speed_limit_kmh / 36e-1 ELSE speed_limit_kmh END AS v FROM frames)
SELECT episode_ord, frame_id, {Q.r6('v', 'unit_only')}, {Q.r6('CASE WHEN v <= 0 THEN 139e-1 ELSE v END', 'with_default')}, v <= 0 AS is_default, 8e0 AS forced FROM v""",
)
def _(spark, sf):
    raw, _ = G.repair_speed_limit("speed_limit_kmh")
    fixed, missing = G.repair_speed_limit("speed_limit_kmh", default=13.9)
    forced, _ = G.repair_speed_limit("speed_limit_kmh", default=13.9, force=8.0)
    return frames(spark, sf).select(
        *KEY, r6(raw, "unit_only"), r6(fixed, "with_default"), missing.alias("is_default"), forced.alias("forced")
    )


@query(
    "time_of_day",
    f"WITH {Q.FRAMES} SELECT episode_ord, frame_id, {Q.r6('sin(radians(sun_azimuth % 360))', 'tod_sin')}, {Q.r6('cos(radians(sun_azimuth % 360))', 'tod_cos')} FROM frames",
)
def _(spark, sf):
    s, c = G.time_of_day("sun_azimuth")
    return frames(spark, sf).select(*KEY, r6(s, "tod_sin"), r6(c, "tod_cos"))


OPTION = """CASE event_type WHEN 'signup' THEN 'RoadOption.LaneFollow' WHEN 'click' THEN 'RoadOption.Left' WHEN 'view' THEN 'ChangeLaneRight'
  WHEN 'purchase' THEN 'RoadOption.Straight' ELSE 'RoadOption.Void' END"""


@query(
    "encode_command",
    f"""SELECT event_id, CASE {OPTION} WHEN 'RoadOption.LaneFollow' THEN 0 WHEN 'RoadOption.Left' THEN 1 WHEN 'ChangeLaneRight' THEN 5
  WHEN 'RoadOption.Straight' THEN 3 ELSE 0 END AS command FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", G.encode_command(F.expr(OPTION)).alias("command"))


LABEL = """CASE CAST(event_id % 8 AS INTEGER) WHEN 0 THEN 'LaneFollow' WHEN 1 THEN 'Left' WHEN 2 THEN 'Right' WHEN 3 THEN 'Straight'
  WHEN 4 THEN 'ChangeLaneLeft' WHEN 5 THEN 'ChangeLaneRight' ELSE 'Unknown(' || CAST(event_id % 8 AS VARCHAR) || ')' END"""


@query("command_label", f"SELECT event_id, {LABEL} AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", G.command_label(F.col("event_id") % 8).alias("label"))


@query(
    "command_text",
    f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Continue following lane' WHEN 1 THEN 'Prepare for left turn'
  WHEN 2 THEN 'Prepare for right turn' WHEN 3 THEN 'Proceed straight through intersection' WHEN 4 THEN 'Change lane to the left'
  WHEN 5 THEN 'Change lane to the right' ELSE {LABEL} END AS text FROM events""",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", G.command_text(F.col("event_id") % 8).alias("text"))


@query(
    "command_from_yaw",
    f"""WITH {Q.FRAMES}, d AS (SELECT *, sun_azimuth - frame_id AS a FROM frames),
t AS (SELECT *, a + 180 - 360 * floor((a + 180) / 360) - 180 AS turn FROM d)
SELECT episode_ord, frame_id, CASE WHEN NOT (gear = 1 OR command = 2) THEN 0 WHEN abs(turn) < 15 THEN 3 WHEN turn > 0 THEN 1 ELSE 2 END AS yaw_command FROM t""",
)
def _(spark, sf):
    c = G.command_from_yaw("frame_id", "sun_azimuth", F.col("gear") == 1, F.col("command") == 2)
    return frames(spark, sf).select(*KEY, c.alias("yaw_command"))


EGO_VEC = """[speed_mps / 5e1, least(greatest(yaw_rate / 1e1, -1), 1), accel_long / 2e1, accel_lat / 2e1,
  least(greatest(yaw_rate / greatest(speed_mps, 5e-1), -1), 1), atan(2875e-3 * yaw_rate / greatest(speed_mps, 5e-1)) / pi(),
  steer_norm, throttle, brake, CASE WHEN speed_limit_kmh > 30 THEN speed_limit_kmh / 36e-1 ELSE speed_limit_kmh END / 5e1,
  command / 5e0, gear / 6e0, sin(radians(sun_azimuth % 360)), cos(radians(sun_azimuth % 360))]"""


@query(
    "ego_vector",
    f"""WITH {Q.FRAMES}, v AS (SELECT episode_ord, frame_id, {EGO_VEC} AS v FROM frames)
SELECT episode_ord, frame_id, CAST(j - 1 AS INTEGER) AS j, {Q.r6('v[j]', 'value')} FROM v CROSS JOIN range(1, 15) r(j)""",
)
def _(spark, sf):
    curv = G.path_curvature("yaw_rate", "speed_mps")
    s, c = G.time_of_day("sun_azimuth")
    f = (
        frames(spark, sf)
        .withColumn("curvature", curv)
        .withColumn("steer_angle_rad", G.steer_angle("curvature"))
        .withColumn("speed_limit_mps", G.limit_to_mps("speed_limit_kmh"))
        .withColumn("time_of_day_sin", s)
        .withColumn("time_of_day_cos", c)
    )
    return f.select(*KEY, F.posexplode(N.ego_vector()).alias("j", "value")).select(*KEY, "j", r6("value"))


CLAMP = "least(greatest({}, {}), {})"


@query(
    "normalize_route",
    f"WITH {Q.ROUTES} SELECT route_id, idx, {Q.r6(CLAMP.format('x * 6 / 1e2', -1, 1), 'x')}, {Q.r6(CLAMP.format('y * 6 / 1e2', -1, 1), 'y')} FROM route_points",
)
def _(spark, sf):
    p = F.array(F.array(F.col("x") * 6, F.col("y") * 6))
    n = N.normalize_route(p)[0]
    return route_points(spark, sf).select("route_id", "idx", r6(n[0], "x"), r6(n[1], "y"))


@query(
    "route_mask",
    f"WITH {Q.ROUTES} SELECT route_id, idx, abs(x / 2e1 / 1e2) + abs(y / 2e1 / 1e2) > 1e-3 AS real FROM route_points",
)
def _(spark, sf):
    p = N.normalize_route(F.array(F.array(F.col("x") / 20, F.col("y") / 20)))
    return route_points(spark, sf).select("route_id", "idx", N.route_mask(p)[0].alias("real"))


@query(
    "normalize_futures",
    f"""WITH {Q.FRAMES} SELECT episode_ord, frame_id, {Q.r6(CLAMP.format('x_m / 1e2', -1, 1), 'x')}, {Q.r6(CLAMP.format('y_m / 1e2', -1, 1), 'y')},
  {Q.r6(CLAMP.format('(speed_mps - 2) / 5e1', 0, 1), 'v')} FROM frames""",
)
def _(spark, sf):
    xy, v = N.normalize_futures(F.array(F.array("x_m", "y_m")), F.array(F.col("speed_mps") - 2))
    return frames(spark, sf).select(*KEY, r6(xy[0][0], "x"), r6(xy[0][1], "y"), r6(v[0], "v"))


@query(
    "denormalize_futures",
    f"WITH {Q.FRAMES} SELECT episode_ord, frame_id, {Q.r6('steer_norm * 1e2', 'x')}, {Q.r6('throttle * 1e2', 'y')}, {Q.r6('brake * 5e1', 'v')} FROM frames",
)
def _(spark, sf):
    xy, v = N.denormalize_futures(F.array(F.array("steer_norm", "throttle")), F.array("brake"))
    return frames(spark, sf).select(*KEY, r6(xy[0][0], "x"), r6(xy[0][1], "y"), r6(v[0], "v"))


@query(
    "normalize_objects",
    f"""WITH {Q.TENSORS}, o AS (SELECT vec_id, i, j, v[i * 11 + j + 1] * 500 AS x FROM tensors CROSS JOIN range(0, 5) a(i) CROSS JOIN range(0, 11) b(j))
SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {Q.r6('''CASE WHEN j IN (1, 2) THEN least(greatest(x / 1e2, -1), 1) WHEN j = 5 THEN least(greatest(x / 1e1, 0), 1)
  WHEN j = 6 THEN least(greatest(x / 5e0, 0), 1) WHEN j IN (7, 8) THEN least(greatest(x / 5e1, -1), 1) ELSE x END''', 'value', 5)} FROM o""",
)
def _(spark, sf):
    big = F.transform("objects", lambda o: F.transform(o, lambda v: v * 500))
    t = tensors(spark, sf).select("vec_id", F.posexplode(N.normalize_objects(big)).alias("i", "o"))
    return t.select("vec_id", "i", F.posexplode("o").alias("j", "value")).select("vec_id", "i", "j", r6("value", digits=5))


@query(
    "normalize_cell",
    f"""WITH {Q.FRAMES}, c AS (SELECT episode_ord, frame_id, CAST(run_tick % 18 AS INTEGER) AS channel, x_m AS value FROM frames)
SELECT episode_ord, frame_id, channel, {Q.r6('''CASE WHEN channel IN (15, 16) THEN least(greatest(value / 4e1, -1), 1)
  WHEN channel = 17 THEN least(greatest(value / 5e1, 0), 1) ELSE value END''', 'value')} FROM c""",
)
def _(spark, sf):
    f = frames(spark, sf).withColumn("channel", (F.col("run_tick") % 18).cast("int"))
    return f.select(*KEY, "channel", r6(N.normalize_cell("channel", "x_m"), "value"))


@query(
    "pad_to",
    f"""WITH {Q.ROUTES}, n AS (SELECT route_id, list(x ORDER BY idx) AS xs FROM route_points GROUP BY 1)
SELECT route_id, CAST(j - 1 AS INTEGER) AS j, {Q.r6('coalesce(xs[j], 0)', 'x')}, CASE WHEN j <= least(len(xs), 12) THEN 1e0 ELSE 0e0 END AS mask FROM n CROSS JOIN range(1, 13) r(j)""",
)
def _(spark, sf):
    pts = route_points(spark, sf).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("p"))
    xs = F.transform("p", lambda s: s["x"])
    both = F.arrays_zip(N.pad_to(xs, 12, F.lit(0.0)).alias("x"), N.pad_mask(xs, 12).alias("m"))
    out = pts.select("route_id", F.posexplode(both).alias("j", "q"))
    return out.select("route_id", "j", r6(F.col("q.x"), "x"), F.col("q.m").alias("mask"))


@query(
    "check_fields",
    """SELECT * FROM (SELECT 'frame_id' AS field, 'null' AS problem, count(*) FILTER (WHERE event_id % 5 = 0) AS rows FROM events
UNION ALL SELECT 'route', 'null', count(*) FILTER (WHERE value > 100) FROM events
UNION ALL SELECT f, 'absent', 0 FROM (SELECT unnest(['bev', 'objects', 'object_mask', 'future_xy', 'future_v', 'future_mask']) AS f)) WHERE problem = 'absent' OR rows > 0""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("frame_id"),
        F.col("user_id").alias("episode_id"),
        F.array("value").alias("ego_vec"),
        F.when(F.col("value") <= 100, F.array("value")).alias("route"),
    )
    return QU.check_fields(ev, "bc")


@query(
    "check_object_width",
    "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 3",
)
def _(spark, sf):
    t = tensors(spark, sf).withColumn(
        "objects",
        F.when(F.col("vec_id") % 7 == 3, F.transform("objects", lambda o: F.slice(o, 1, 9))).otherwise(F.col("objects")),
    )
    return QU.check_object_width(t).select("vec_id")


@query(
    "check_finite",
    f"""WITH {Q.TENSORS} SELECT vec_id, field, position FROM (
  SELECT vec_id, 'ego_vec' AS field, CAST(j - 1 AS INTEGER) AS position FROM tensors CROSS JOIN range(1, 15) r(j) WHERE v[j] > 2e-1
  UNION ALL SELECT vec_id, 'objects', CAST(j - 1 AS INTEGER) FROM tensors CROSS JOIN range(1, 56) r(j) WHERE v[j] < -3e-1)""",
)
def _(spark, sf):
    inf, nan = F.lit(float("-inf")), F.lit(float("nan"))
    t = tensors(spark, sf).select(
        "vec_id",
        F.transform("ego_vec", lambda v: F.when(v > 0.2, nan).otherwise(v)).alias("ego_vec"),
        F.transform("objects", lambda o: F.transform(o, lambda v: F.when(v < -0.3, inf).otherwise(v))).alias("objects"),
    )
    return QU.check_finite(t, "vec_id", ["ego_vec", "objects"])


@query(
    "goal_distance",
    f"WITH {Q.EGOS} SELECT tick, {Q.r6('sqrt((ego_x - 50) * (ego_x - 50) + (ego_y - 40) * (ego_y - 40))', 'goal_dist_m')} FROM egos",
)
def _(spark, sf):
    return egos(spark, sf).select("tick", r6(G.goal_distance("ego_x", "ego_y", 50, 40), "goal_dist_m"))


@query(
    "object_type",
    f"""WITH {Q.ACTORS} SELECT type_name, CASE WHEN starts_with(type_name, 'walker.') THEN 1 WHEN contains(type_name, 'bike') THEN 2
  WHEN starts_with(type_name, 'vehicle.') THEN 0 END AS type_id, count(*) AS n FROM actors GROUP BY 1, 2""",
)
def _(spark, sf):
    a = actors(spark, sf).withColumn("type_id", G.object_type("type_name"))
    return a.groupBy("type_name", "type_id").agg(F.count(F.lit(1)).alias("n"))
