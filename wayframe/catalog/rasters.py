"""Queries for sparse rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.objects import tokens
from wayframe.catalog.registry import query
from wayframe.catalog.views import egos, lights, r6, route_points
from wayframe.operators import raster as R
from wayframe.operators.sampling import raster_dropout

GRID = R.Grid()
H, W = GRID.height, GRID.width


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes as point arrays; the coordinates are doubled so that some points leave the grid."""
    p = route_points(spark, sf_dir).groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    pts = F.transform("p", lambda q: F.struct((q["x"] * 2).alias("x"), (q["y"] * 2).alias("y")))
    return p.select((F.col("route_id") % 100_000).alias("tick"), "route_id", pts.alias("points"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select(
        "tick",
        "route_id",
        (F.col("route_id") % 2).cast("int").alias("kind"),
        F.transform("points", lambda q: q["x"]).alias("coords_x"),
        F.transform("points", lambda q: q["y"]).alias("coords_y"),
        (F.col("route_id") % 13 * 10).cast("double").alias("speed_limit"),
    )


def checks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint of a raster per frame and channel."""
    return cells.groupBy(*keys, "channel").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("row").alias("rows"),
        F.sum("col").alias("cols"),
        F.sum(F.col("row").cast("bigint") * F.col("col")).alias("cross"),
        r6(F.sum("value"), "total", 5),
    )


CHECK = """count(*) AS n, CAST(sum("row") AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols, CAST(sum("row" * col) AS BIGINT) AS "cross", round(sum(value), 5) + 0e0 AS total"""


def cell(x: str, y: str, r: str = "r", c: str = "c") -> str:
    return (
        f"CAST(round_even({H // 2} - ({x}) / 4e-1, 0) AS INTEGER) AS {r}, CAST(round_even({W // 2} + ({y}) / 4e-1, 0) AS INTEGER) AS {c}"
    )


def stamped(source: str, radius: str, keys: str, extra: str = "1e0") -> str:
    """Cells around (r, c) of each source row."""
    return f"""SELECT DISTINCT {keys}, r + a.d AS "row", c + b.d AS col, {extra} AS value FROM {source}
  CROSS JOIN range(-14, 15) a(d) CROSS JOIN range(-14, 15) b(d)
  WHERE abs(a.d) <= {radius} AND abs(b.d) <= {radius} AND r + a.d BETWEEN 0 AND {H - 1} AND c + b.d BETWEEN 0 AND {W - 1}"""


def walked(source: str, keys: str) -> str:
    """Centres on the grid of the segments (r0, c0) to (r1, c1) of each source row."""
    return f"""SELECT DISTINCT {keys}, r, c FROM (SELECT {keys},
  CAST(round_even(r0 + (r1 - r0) * (k / CAST(st AS DOUBLE)), 0) AS INTEGER) AS r, CAST(round_even(c0 + (c1 - c0) * (k / CAST(st AS DOUBLE)), 0) AS INTEGER) AS c
  FROM (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0), 1) AS st FROM {source}), LATERAL (SELECT unnest(range(0, st + 1)) AS k))
  WHERE r BETWEEN 0 AND {H - 1} AND c BETWEEN 0 AND {W - 1}"""


ROUTE_CELLS = Q.ROUTES + f""",
pts AS (SELECT route_id, idx, x * 2 AS x, y * 2 AS y FROM route_points),
rc AS (SELECT *, {cell('x', 'y')} FROM pts),
cnt AS (SELECT route_id, count(*) AS n FROM pts GROUP BY 1),
sg AS (SELECT route_id, idx, x, y, r AS r0, c AS c0, lead(r) OVER w AS r1, lead(c) OVER w AS c1, lead(x) OVER w AS x1, lead(y) OVER w AS y1
       FROM rc WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
centres AS ({walked('(SELECT * FROM sg WHERE r1 IS NOT NULL)', 'route_id')}
  UNION ALL SELECT rc.route_id, r, c FROM rc JOIN cnt ON rc.route_id = cnt.route_id AND n = 1)"""

ROUTE_LAYERS = ROUTE_CELLS + f""",
rlay AS (SELECT route_id, 8 AS channel, "row", col, value FROM ({stamped('centres', '0', 'route_id')})
  UNION ALL SELECT route_id, 7, "row", col, value FROM ({stamped('centres', str(GRID.pixels(3.0) - 1), 'route_id')}))"""


@query(
    "xy_to_cell",
    f"WITH {Q.LIGHTS} SELECT tick, tl_id, {cell('stop_x', 'stop_y')} FROM lights",
)
def _(spark, sf):
    r, c = R.xy_to_cell("stop_x", "stop_y", GRID)
    return lights(spark, sf).select("tick", "tl_id", r.alias("r"), c.alias("c"))


@query(
    "stamp_points",
    f"""WITH {Q.LIGHTS}, p AS (SELECT tick, {cell('stop_x * 2', 'stop_y * 2')} FROM lights), s AS ({stamped('p', '3', 'tick')})
SELECT tick, 0 AS channel, {CHECK} FROM s GROUP BY 1""",
)
def _(spark, sf):
    cells = R.stamp(*R.xy_to_cell(F.col("stop_x") * 2, F.col("stop_y") * 2, GRID), 3, GRID)
    raw = lights(spark, sf).select("tick", F.lit(0).alias("channel"), F.explode(cells).alias("cell"), F.lit(1.0).alias("value"))
    return checks(R.merge_cells(raw, ["tick"], GRID), ["tick"])


@query(
    "draw_polyline",
    f"WITH {ROUTE_CELLS}, s AS ({stamped('centres', '3', 'route_id')}) SELECT route_id, 0 AS channel, {CHECK} FROM s GROUP BY 1",
)
def _(spark, sf):
    raw = R.spread(routes(spark, sf)).select(
        "route_id", F.lit(0).alias("channel"), F.explode(R.draw_polyline("points", 4, GRID)).alias("cell"), F.lit(1.0).alias("value")
    )
    return checks(R.merge_cells(raw, ["route_id"], GRID), ["route_id"])


@query("route_layers", f"WITH {ROUTE_LAYERS} SELECT route_id, channel, {CHECK} FROM rlay GROUP BY 1, 2")
def _(spark, sf):
    return checks(R.rasterize(["route_id"], routes=routes(spark, sf), grid=GRID), ["route_id"])


LIGHT_LAYERS = Q.LIGHTS + f""",
lp AS (SELECT tick, state, {cell('stop_x', 'stop_y')} FROM lights),
ls AS ({stamped('lp', '2', 'tick, state')}),
llay AS (SELECT DISTINCT tick, 4 AS channel, "row", col, value FROM ls UNION ALL SELECT DISTINCT tick, 9 + state, "row", col, value FROM ls)"""


@query("light_layers", f"WITH {LIGHT_LAYERS} SELECT tick, channel, {CHECK} FROM llay GROUP BY 1, 2")
def _(spark, sf):
    return checks(R.rasterize(["tick"], lights=lights(spark, sf), grid=GRID), ["tick"])


ACTOR_LAYERS = Q.TOKENS + f""",
ap AS (SELECT tick, type_id, vx, vy, {cell('x_ego', 'y_ego')}, CASE WHEN type_id = 0 THEN {GRID.pixels(1.2)} ELSE {max(1, GRID.pixels(1.2) - 1)} END AS rad FROM tokens),
ac AS (SELECT * FROM ap WHERE r BETWEEN 0 AND {H - 1} AND c BETWEEN 0 AND {W - 1}),
alay AS (SELECT DISTINCT tick, 12 + type_id AS channel, "row", col, value FROM ({stamped('ap', 'rad', 'tick, type_id')})
  UNION ALL SELECT tick, 15, r, c, least(greatest(sum(vx), -40), 40) FROM ac GROUP BY ALL
  UNION ALL SELECT tick, 16, r, c, least(greatest(sum(vy), -40), 40) FROM ac GROUP BY ALL)"""


@query("actor_layers", f"WITH {ACTOR_LAYERS} SELECT tick, channel, {CHECK} FROM alay GROUP BY 1, 2")
def _(spark, sf):
    return checks(R.rasterize(["tick"], tokens=tokens(spark, sf), grid=GRID), ["tick"])


HALF = "175e-2"
BOUNDARY = f"""sb AS (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len FROM sg WHERE x1 IS NOT NULL AND route_id % 2 = 0),
nb AS (SELECT *, -(y1 - y) / len AS nx, (x1 - x) / len AS ny FROM sb WHERE len >= 1e-3),
bl AS (SELECT route_id, {cell(f'x + nx * {HALF}', f'y + ny * {HALF}', 'r0', 'c0')}, {cell(f'x1 + nx * {HALF}', f'y1 + ny * {HALF}', 'r1', 'c1')} FROM nb),
br AS (SELECT route_id, {cell(f'x - nx * {HALF}', f'y - ny * {HALF}', 'r0', 'c0')}, {cell(f'x1 - nx * {HALF}', f'y1 - ny * {HALF}', 'r1', 'c1')} FROM nb)"""

LANE_LAYERS = ROUTE_CELLS + f""",
lc AS (SELECT * FROM centres WHERE route_id % 2 = 0),
lim AS (SELECT route_id, r, c, route_id % 13 * 1e1 AS v FROM lc WHERE route_id % 13 > 0), {BOUNDARY},
klay AS (SELECT route_id, 1 AS channel, "row", col, value FROM ({stamped('lc', str(GRID.pixels(0.6) - 1), 'route_id')})
  UNION ALL SELECT route_id, 0, "row", col, value FROM ({stamped('lc', str(GRID.pixels(6.0) - 1), 'route_id')})
  UNION ALL SELECT route_id, 2, r, c, 1e0 FROM ({walked('bl', 'route_id')})
  UNION ALL SELECT route_id, 3, r, c, 1e0 FROM ({walked('br', 'route_id')})
  UNION ALL SELECT route_id, 17, "row", col, CASE WHEN v > 30 THEN v / 36e-1 ELSE v END FROM ({stamped('lim', str(GRID.pixels(3.0) - 1), 'route_id, v')}))"""


@query("lane_layers", f"WITH {LANE_LAYERS} SELECT route_id, channel, {CHECK} FROM klay GROUP BY 1, 2")
def _(spark, sf):
    return checks(R.rasterize(["route_id"], segments=segments(spark, sf), grid=GRID), ["route_id"])


# Lanes, lights, routes and actors that fall on the same tick share its raster.
def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rasterize(
        ["tick"],
        segments=segments(spark, sf_dir),
        lights=lights(spark, sf_dir),
        routes=routes(spark, sf_dir),
        tokens=tokens(spark, sf_dir),
        grid=GRID,
    )


WHOLE = (
    LANE_LAYERS
    + "," + ROUTE_LAYERS[len(ROUTE_CELLS) + 1 :]
    + "," + LIGHT_LAYERS
    + "," + ACTOR_LAYERS
    + """,
every AS (SELECT route_id % 100000 AS tick, channel, "row", col, value FROM klay UNION ALL SELECT route_id % 100000, channel, "row", col, value FROM rlay
  UNION ALL SELECT tick, channel, "row", col, value FROM llay UNION ALL SELECT tick, channel, "row", col, value FROM alay),
whole AS (SELECT tick, channel, "row", col, max(value) AS value FROM every GROUP BY ALL)"""
)


@query("rasterize", f"WITH {WHOLE} SELECT tick, channel, {CHECK} FROM whole GROUP BY 1, 2")
def _(spark, sf):
    return checks(whole(spark, sf), ["tick"])


@query(
    "fill_speed_limit",
    f"""WITH {ROUTE_LAYERS},{Q.EGOS}, f AS (SELECT route_id % 100000 AS tick, channel, "row", col, value FROM rlay
  UNION ALL SELECT tick, 17, NULL, NULL, ego_x / 4 FROM egos)
SELECT channel, count(*) AS n, count("row") AS drawn, {Q.r6('sum(value)', 'total')} FROM f GROUP BY 1""",
)
def _(spark, sf):
    r = routes(spark, sf)
    cells = R.rasterize(["route_id"], routes=r, grid=GRID).withColumn("tick", F.col("route_id") % 100_000).drop("route_id")
    out = R.fill_speed_limit(cells, egos(spark, sf).withColumn("limit", F.col("ego_x") / 4), ["tick"], "limit", GRID)
    return out.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.count("row").alias("drawn"), r6(F.sum("value"), "total")
    )


@query(
    "channel_stats",
    f"""WITH {ACTOR_LAYERS} SELECT tick, channel, {Q.r6('least(min(value), 0)', 'min')}, {Q.r6('greatest(max(value), 0)', 'max')},
  {Q.r6(f'sum(value) / {H * W}', 'mean', 8)} FROM (SELECT tick, channel, value FROM alay UNION ALL SELECT tick, CAST(c AS INTEGER), 0 FROM (SELECT DISTINCT tick FROM alay), range(18) r(c)) GROUP BY 1, 2""",
)
def _(spark, sf):
    s = R.channel_stats(R.rasterize(["tick"], tokens=tokens(spark, sf), grid=GRID), ["tick"], GRID)
    return s.select("tick", "channel", r6("min"), r6("max"), r6("mean", digits=8))


def _int(key: str, seed: int, lo: int, hi: str) -> str:
    return f"CAST(floor({Q.uniform(key, seed)} * ({hi} - {lo} + 1)) + {lo} AS INTEGER)"


@query(
    "raster_dropout",
    f"""WITH {LIGHT_LAYERS},
z AS (SELECT *, {_int('tick', 18, 10, '30')} AS rh, {_int('tick', 19, 10, '30')} AS rw FROM llay),
o AS (SELECT *, {_int('tick', 20, 0, f'({W} - rw)')} AS x0, {_int('tick', 21, 0, f'({H} - rh)')} AS y0 FROM z)
SELECT tick, channel, {CHECK} FROM o WHERE NOT ({Q.uniform('tick', 17)} < 5e-1 AND col BETWEEN x0 AND x0 + rw - 1 AND "row" BETWEEN y0 AND y0 + rh - 1)
  AND NOT ({Q.uniform('tick', 22)} < 3e-1 AND channel = {_int('tick', 23, 0, '17')}) GROUP BY 1, 2""",
)
def _(spark, sf):
    cells = R.rasterize(["tick"], lights=lights(spark, sf), grid=GRID)
    return checks(raster_dropout(cells, H, W, 17, 0.5, (10, 30), 0.3, key="tick"), ["tick"])
