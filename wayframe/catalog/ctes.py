"""The same views as DuckDB SQL fragments, for the comparison queries.

Decimal points are written in exponent form because DuckDB reads a plain
``0.1`` as a decimal.
"""

FRAMES = """
ev AS (SELECT event_id AS e, CAST(user_id % 15 AS INTEGER) AS ep, event_type AS ty, value,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events),
ix AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY e) - 1 AS n, count(*) OVER (PARTITION BY ep) AS cnt,
              CAST(sum(CASE WHEN ty = 'error' AND e % 7 = 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY ep ORDER BY e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS coll,
              CAST(sum(CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY ep ORDER BY e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lane FROM ev),
frames AS (SELECT 'run0' AS run_id, ep AS episode_ord, n AS frame_id, e AS run_tick, n * 100000 AS t_us, epoch_us(ts) AS ts_us,
  n >= cnt - 20 AS is_tail,
  CASE ep % 5 WHEN 1 THEN least(n, 29) * 10
              WHEN 2 THEN 10 * n + CASE WHEN ty = 'error' AND e % 3 = 0 THEN 700 ELSE 0 END
              WHEN 3 THEN -10 * n ELSE 10 * n END / 1e1 AS x_m,
  CASE WHEN ep % 5 = 4 THEN 3 * n ELSE 0 END / 1e1 AS y_m,
  CASE WHEN ep % 5 = 4 THEN 17e0 ELSE 0e0 END AS yaw_deg,
  CASE WHEN n IN (3, 7) THEN 5e-1 WHEN ep % 5 = 1 AND n >= 30 THEN 1e-1 ELSE value / 1e1 + 1e0 END AS speed_mps,
  CASE WHEN e % 10 = 0 THEN 8e-1 ELSE 0e0 END AS brake,
  (e * 3 % 101) / 1e2 AS throttle, (e * 7 % 201 - 100) / 1e2 AS steer_norm,
  (k - 50) / 1e1 AS accel_long, (e % 21 - 10) / 1e1 AS accel_lat, (e % 13 - 6) / 1e1 AS yaw_rate,
  CASE ty WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS command,
  CAST(e % 6 AS INTEGER) AS gear, e % 13 * 1e1 AS speed_limit_kmh, CAST(e % 720 AS DOUBLE) AS sun_azimuth,
  CASE WHEN e % 9 <> 0 THEN 1 WHEN e % 18 = 0 THEN 2 END AS lane_type,
  CAST(cnt - n AS DOUBLE) AS goal_dist_m, coll AS collisions_cum, lane AS lane_events_cum
  FROM ix)"""

EGOS = """
egos AS (SELECT o_orderkey AS tick, CAST(o_custkey % 100 AS DOUBLE) AS ego_x, CAST(o_orderkey % 80 AS DOUBLE) AS ego_y,
                CAST(o_orderkey % 360 AS DOUBLE) AS ego_yaw FROM orders)"""

ACTORS = """
actors AS (SELECT l_orderkey AS tick, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE l_linenumber % 4 WHEN 0 THEN 'vehicle.tesla.model3' WHEN 1 THEN 'walker.pedestrian.0001'
       WHEN 2 THEN 'vehicle.diamondback.bike' ELSE 'traffic.sign' END AS type_name,
  CAST(l_partkey % 121 - 10 AS DOUBLE) AS x_w, CAST(l_suppkey % 81 AS DOUBLE) AS y_w,
  CAST(l_partkey % 360 AS DOUBLE) AS yaw_w, l_quantity / 5e0 - 5e0 AS vx_w, l_discount * 5e1 AS vy_w,
  l_suppkey % 5 / 4e0 + 1e0 AS extent_x, l_suppkey % 3 / 4e0 + 5e-1 AS extent_y FROM lineitem)"""

LIGHTS = """
lights AS (SELECT l_orderkey AS tick, l_partkey AS tl_id, CAST(l_partkey % 3 AS INTEGER) AS state,
  l_quantity - 1e1 AS stop_x, CAST(l_partkey % 21 - 10 AS DOUBLE) AS stop_y FROM lineitem WHERE l_linenumber = 1)"""

ROUTES = FRAMES + """,
route_points AS (SELECT episode_ord * 100000 + frame_id // 20 AS route_id, CAST(frame_id % 20 AS INTEGER) AS idx,
  frame_id % 20 * 15e-1 - 3e0 AS x, frame_id * frame_id % 7 * 3e-1 AS y FROM frames)"""

TENSORS = """
tensors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS target FROM embeddings)"""

FILES = """
files AS (SELECT *, l_returnflag || l_linestatus AS file FROM lineitem)"""

# Forward as-of lookup: the first sample at or after each target, never less than one row further per step.
def futures(n: int, step: int, time: str = "t_us", source: str = "frames", bases: str = "NOT is_tail") -> str:
    return f"""
smp AS (SELECT *, {time} AS tm, row_number() OVER (PARTITION BY episode_ord ORDER BY frame_id) - 1 AS idx,
               max({time}) OVER (PARTITION BY episode_ord) AS last_tm FROM {source}),
bas AS (SELECT * FROM smp WHERE {bases}),
tgt AS (SELECT episode_ord, frame_id, k, tm + k * {step} AS target
        FROM bas, range(1, {n} + 1) r(k) WHERE tm + {n} * CAST({step} AS BIGINT) <= last_tm),
hit AS (SELECT tgt.episode_ord, tgt.frame_id, tgt.k, smp.idx AS b FROM tgt ASOF JOIN smp
        ON tgt.episode_ord = smp.episode_ord AND tgt.target <= smp.tm),
pos AS (SELECT episode_ord, frame_id, k,
               k + max(b - k) OVER (PARTITION BY episode_ord, frame_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS idx FROM hit),
fut AS (SELECT pos.episode_ord, pos.frame_id, CAST(pos.k AS INTEGER) AS i, s.tm AS f_us, s.x_m AS f_x, s.y_m AS f_y, s.speed_mps AS f_v
        FROM pos JOIN smp s ON s.episode_ord = pos.episode_ord AND s.idx = pos.idx)"""


# The future points in the base frame's own axes, and the extrema over them.
def waypoints() -> str:
    return """
way AS (SELECT f.episode_ord, f.frame_id, f.i, f_us, f_v AS v,
          (f_x - b.x_m) * cos(radians(b.yaw_deg)) + (f_y - b.y_m) * sin(radians(b.yaw_deg)) AS x,
          (f_y - b.y_m) * cos(radians(b.yaw_deg)) - (f_x - b.x_m) * sin(radians(b.yaw_deg)) AS y
        FROM fut f JOIN bas b ON b.episode_ord = f.episode_ord AND b.frame_id = f.frame_id),
stp AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step
        FROM way WINDOW w AS (PARTITION BY episode_ord, frame_id ORDER BY i)),
ext AS (SELECT episode_ord, frame_id, count(*) AS points, coalesce(max(step), 0e0) AS max_step,
          sqrt((arg_max(x, i) - arg_min(x, i)) * (arg_max(x, i) - arg_min(x, i))
             + (arg_max(y, i) - arg_min(y, i)) * (arg_max(y, i) - arg_min(y, i))) AS displacement,
          max(v) AS max_speed, max(x) AS max_forward, arg_max(x, i) AS last_x, arg_max(y, i) AS last_y
        FROM stp GROUP BY ALL)"""


# Recording gate on raw ticks: the first tick that ends a run of `ticks` good ones.
def gate(ticks: int = 15, source: str = "frames") -> str:
    return f"""
gat AS (SELECT *, CASE WHEN sum(CASE WHEN speed_mps >= 1 THEN 1 ELSE 0 END) OVER
          (PARTITION BY episode_ord ORDER BY frame_id ROWS BETWEEN {ticks - 1} PRECEDING AND CURRENT ROW) >= {ticks}
          THEN frame_id END AS ready FROM {source}),
gated AS (SELECT * EXCLUDE (ready, start_at), coalesce(frame_id >= start_at, false) AS recording FROM
          (SELECT *, min(ready) OVER (PARTITION BY episode_ord) AS start_at FROM gat))"""


def mix(key: str, seed: int = 0) -> str:
    """The draw of functions/hashing.py; ``key`` may be several expressions with commas between them."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 12) AS BIGINT)"


def uniform(key: str, seed: int = 0) -> str:
    return f"({mix(key, seed)} / 281474976710656e0)"


def normal(key: str, seed: int = 0) -> str:
    return f"(sqrt(-2e0 * ln(greatest({uniform(key, seed)}, 1e-9))) * cos(2e0 * pi() * {uniform(key, seed + 1)}))"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


# Actors within 40 m of the vehicle, with their features in its axes.
NEARBY = EGOS + "," + ACTORS + """,
near AS (SELECT a.*, ego_x, ego_y, ego_yaw, radians(ego_yaw) AS er FROM actors a JOIN egos g ON a.tick = g.tick
         WHERE (x_w - ego_x) * (x_w - ego_x) + (y_w - ego_y) * (y_w - ego_y) <= 1600)"""

TOKENS = NEARBY + """,
tk0 AS (SELECT *, CASE WHEN starts_with(type_name, 'walker.') THEN 1
    WHEN contains(type_name, 'bike') OR contains(type_name, 'bicycle') OR contains(type_name, 'motorcycle') THEN 2 ELSE 0 END AS type_id,
    (x_w - ego_x) * cos(er) + (y_w - ego_y) * sin(er) AS x_ego, (y_w - ego_y) * cos(er) - (x_w - ego_x) * sin(er) AS y_ego,
    vx_w * cos(er) + vy_w * sin(er) AS vx, vy_w * cos(er) - vx_w * sin(er) AS vy,
    radians(yaw_w) - er AS dyaw, 2 * extent_x AS length, 2 * extent_y AS width
    FROM near WHERE starts_with(type_name, 'vehicle.') OR starts_with(type_name, 'walker.')),
tokens AS (SELECT *, CASE WHEN dyaw > pi() THEN dyaw - 2 * pi() WHEN dyaw < -pi() THEN dyaw + 2 * pi() ELSE dyaw END AS yaw,
    CASE WHEN vx < -1 THEN 1 ELSE 0 END AS oncoming_flag, CASE WHEN type_id = 0 THEN 1 ELSE 0 END AS priority_flag FROM tk0)"""
