"""Sparse bird's-eye-view rasters.

A raster is never built dense.  A line or point becomes an array of cell codes
(``row * width + col``) inside its own row, with array functions only; the one
shuffle merges equal cells of a frame, after a map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions.geometry import limit_to_mps
from wayframe.sources.shared import settle

CH = K.CHANNELS
#: Rows of one layer in one frame from which the frame's rows are dealt to several tasks.
CROWDED = 2_000
#: Cells that a task draws and merges: about 0.4 GB in the merge.
CELLS_PER_TASK = 3_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Grid:
    """Raster extent and line widths in metres; the vehicle is in the middle, x points up and y right."""

    meters_x: float = 80.0
    meters_y: float = 60.0
    resolution: float = 0.4
    lane_width: float = K.LANE_WIDTH_M
    corridor_width: float = 6.0
    centre_thickness: float = 0.6
    drivable_thickness: float = 6.0
    actor_radius: float = 1.2

    @property
    def width(self) -> int:
        return round(self.meters_x / self.resolution)

    @property
    def height(self) -> int:
        return round(self.meters_y / self.resolution)

    def pixels(self, meters: float) -> int:
        return max(1, round(meters / self.resolution))


def xy_to_cell(x, y, grid: Grid) -> tuple[Column, Column]:
    """Row and column of a point; halves go to the even number, and the cell may lie outside."""
    row = F.rint(F.lit(float(grid.height // 2)) - _c(x) / grid.resolution).cast("int")
    col = F.rint(F.lit(float(grid.width // 2)) + _c(y) / grid.resolution).cast("int")
    return row, col


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once: array functions repeat an argument that is written twice."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _span(centre: Column, radius: int, size: int) -> Column:
    """Positions within ``radius`` of the centre that lie on the grid (empty if none)."""
    lo, hi = F.greatest(centre - radius, F.lit(0)), F.least(centre + radius, F.lit(size - 1))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def stamp(row, col, radius: int, grid: Grid) -> Column:
    """Cells of a square around one point, clipped to the grid."""
    cols = _span(_c(col), radius, grid.width)
    return F.flatten(
        F.transform(_span(_c(row), radius, grid.height), lambda r: F.transform(cols, lambda c: r * grid.width + c))
    )


def _stretch(codes: Column, radius: int, size: int) -> Column:
    """Widen cells along the minor axis of their codes (``major * size + minor``), without repeats.

    The codes are sorted, so each cell only adds what the one before it on the
    same line has not covered: the work is that of the result.
    """

    def added(c: Column, p: Column) -> Column:
        line = c - c % size
        lo = F.greatest(F.greatest(c - radius, line), F.when(p >= line, p + radius + 1).otherwise(line))
        hi = F.least(c + radius, line + (size - 1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    def widen(s: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        return F.flatten(F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), added))

    return _once(F.sort_array(codes), widen)


def _swap(codes: Column, size: int, other: int) -> Column:
    """Codes ``major * size + minor`` with the axes exchanged; ``other`` is the major axis' size."""
    return F.transform(codes, lambda c: (c % size) * other + F.floor(c / size).cast("int"))


def polyline_centres(points, grid: Grid) -> Column:
    """Cells a polyline ``array<struct<x, y>>`` passes through, each once.

    Each segment is walked in unit steps of its longer side; steps off the grid
    are left out.
    """
    pts = _c(points)
    h, w = grid.height, grid.width

    def cell(p: Column) -> Column:
        r, c = xy_to_cell(p["x"], p["y"], grid)
        return F.struct(r.alias("r"), c.alias("c"))

    def walk(a: Column, b: Column) -> Column:
        dr, dc = b["r"] - a["r"], b["c"] - a["c"]
        steps = F.greatest(F.abs(dr), F.abs(dc), F.lit(1))

        def at(k: Column) -> Column:
            r = F.rint(a["r"] + dr * (k / steps)).cast("int")
            c = F.rint(a["c"] + dc * (k / steps)).cast("int")
            return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w), r * w + c)

        # A segment wholly to one side of the grid has no step on it.
        beside = (
            (F.greatest(a["r"], b["r"]) < 0) | (F.least(a["r"], b["r"]) >= h)
            | (F.greatest(a["c"], b["c"]) < 0) | (F.least(a["c"], b["c"]) >= w)
        )
        return F.when(beside, F.array().cast("array<int>")).otherwise(
            F.array_compact(F.transform(F.sequence(F.lit(0), steps), at))
        )

    def join(cells: Column) -> Column:
        k = F.greatest(F.size(cells) - 1, F.lit(0))
        return F.array_distinct(F.flatten(F.zip_with(F.slice(cells, F.lit(1), k), F.slice(cells, F.lit(2), k), walk)))

    return _once(F.transform(pts, cell), join)


def thicken(points, centres, thickness: int, grid: Grid) -> Column:
    """Cells of the stamped polyline, from :func:`polyline_centres`; a single point is stamped as it is."""
    pts, centres = _c(points), _c(centres)
    radius = max(0, thickness - 1)

    def alone(p: Column) -> Column:
        return stamp(*xy_to_cell(p["x"], p["y"], grid), radius, grid)

    drawn = centres
    if radius:
        tall = _stretch(_swap(centres, grid.width, grid.height), radius, grid.height)
        drawn = _stretch(_swap(tall, grid.height, grid.width), radius, grid.width)
    return F.when(F.size(pts) < 2, F.flatten(F.transform(F.slice(pts, 1, 1), alone))).otherwise(drawn)


def draw_polyline(points, thickness: int, grid: Grid) -> Column:
    """Cells of a polyline given as ``array<struct<x, y>>``, stamped with squares; no cell twice."""
    return thicken(points, polyline_centres(points, grid), thickness, grid)


def spread(df: DataFrame, placed: bool = False, cells: int | None = None) -> DataFrame:
    """Deal the rows out evenly before drawing, unless they are ``placed`` already.

    One input row becomes up to ``cells`` cells (those of a line, by default), so input partitions sized by bytes
    are far too big.  The rows are written once and counted, and the number of tasks goes by them; dealing by row keeps a frame
    with very many lines from filling one task.
    """
    if placed:
        return df
    stored = settle(df, "layer")
    return stored.repartition(_tasks(stored, stored.count(), cells or _line_cells(Grid())))


def _line_cells(grid: Grid) -> int:
    """Cells of one layer of a line that crosses the grid at its widest, boundaries and centre line aside."""
    return (2 * grid.pixels(grid.drivable_thickness) - 1) * max(grid.height, grid.width)


def _stamp_cells(radius: int) -> int:
    return (2 * radius + 1) ** 2


def _tasks(df: DataFrame, rows: int, cells: int) -> int:
    """As many tasks as the session shuffles with, and no more than CELLS_PER_TASK cells in each if rows draw ``cells``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * cells // CELLS_PER_TASK))


def _layers(df: DataFrame, keys: Sequence[str], *layers: tuple[Column | int, Column, Column | float]) -> DataFrame:
    """Rows (keys, channel, cell, value) from (channel, cells, value) triples of each row."""
    parts = F.array(
        *[
            F.struct(
                (ch if isinstance(ch, Column) else F.lit(ch)).cast("int").alias("channel"),
                cells.alias("cells"),
                (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias("value"),
            )
            for ch, cells, v in layers
        ]
    )
    return (
        df.select(*keys, F.inline(parts))
        .select(*keys, "channel", F.explode("cells").alias("cell"), "value")
    )


def lane_layers(segments: DataFrame, keys: Sequence[str], grid: Grid = Grid(), placed: bool = False) -> DataFrame:
    """Centre line, drivable area, both boundaries and speed limit of the lane segments.

    Reads ``kind`` (only 0 is drawn), ``coords_x``, ``coords_y`` and ``speed_limit``.
    """
    lines = spread(segments, placed).where((F.col("kind") == 0) & (F.size("coords_x") > 0) & (F.size("coords_x") == F.size("coords_y")))
    lines = lines.withColumn(
        "_p", F.zip_with("coords_x", "coords_y", lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    )
    lines = lines.withColumn("_c", polyline_centres("_p", grid))
    half = grid.lane_width * 0.5
    k = F.greatest(F.size("_p") - 1, F.lit(0))

    def boundary(side: float) -> Column:
        def one(a: Column, b: Column) -> Column:
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            length = F.hypot(dx, dy)
            nx, ny = -dy / length * (half * side), dx / length * (half * side)
            ends = F.array(
                F.struct((a["x"] + nx).alias("x"), (a["y"] + ny).alias("y")),
                F.struct((b["x"] + nx).alias("x"), (b["y"] + ny).alias("y")),
            )
            return F.when(length >= 1e-3, draw_polyline(ends, 1, grid)).otherwise(F.array().cast("array<int>"))

        pairs = F.zip_with(F.slice("_p", F.lit(1), k), F.slice("_p", F.lit(2), k), one)
        return F.array_distinct(F.flatten(pairs))

    limit = F.coalesce(F.col("speed_limit").cast("double"), F.lit(0.0))

    def band(meters: float) -> Column:
        return thicken("_p", "_c", grid.pixels(meters), grid)

    zone = F.when(limit > 0.0, band(grid.corridor_width * 0.5))
    return _layers(
        lines,
        keys,
        (CH["lane_centre"], band(grid.centre_thickness), 1.0),
        (CH["drivable"], band(grid.drivable_thickness), 1.0),
        (CH["lane_left"], boundary(1.0), 1.0),
        (CH["lane_right"], boundary(-1.0), 1.0),
        (CH["speed_limit"], zone, limit_to_mps(limit)),
    )


def light_layers(lights: DataFrame, keys: Sequence[str], grid: Grid = Grid(), radius: int = 2, placed: bool = False) -> DataFrame:
    """Stop lines, and the light's state on the channel of its colour."""
    cells = stamp(*xy_to_cell("stop_x", "stop_y", grid), radius, grid)
    colour = (
        F.when(F.col("state") == K.RED, CH["light_red"])
        .when(F.col("state") == K.YELLOW, CH["light_yellow"])
        .when(F.col("state") == K.GREEN, CH["light_green"])
    )
    return _layers(spread(lights, placed), keys, (CH["stop_line"], cells, 1.0), (colour, cells, 1.0)).where("channel IS NOT NULL")


def route_layers(routes: DataFrame, keys: Sequence[str], grid: Grid = Grid(), points: str = "points", placed: bool = False) -> DataFrame:
    """Route centre line and corridor, from ``array<struct<x, y>>`` per frame."""
    lines = spread(routes, placed).withColumn("_c", polyline_centres(points, grid))
    return _layers(
        lines,
        keys,
        (CH["route_centre"], thicken(points, "_c", 1, grid), 1.0),
        (CH["route_corridor"], thicken(points, "_c", grid.pixels(grid.corridor_width * 0.5), grid), 1.0),
    )


def actor_layers(tokens: DataFrame, keys: Sequence[str], grid: Grid = Grid(), placed: bool = False) -> DataFrame:
    """Presence of each actor by class, and its velocity at the centre cell."""
    row, col = xy_to_cell("x_ego", "y_ego", grid)
    r = grid.pixels(grid.actor_radius)
    small = max(1, r - 1)
    kind = F.col("type_id")
    channel = F.when(kind == K.VEHICLE, CH["vehicle"]).when(kind == K.WALKER, CH["walker"]).otherwise(CH["bike"])
    cells = F.when(kind == K.VEHICLE, stamp(row, col, r, grid)).otherwise(stamp(row, col, small, grid))
    centre = stamp(row, col, 0, grid)
    return _layers(
        spread(tokens, placed),
        keys,
        (channel, cells, 1.0),
        (CH["velocity_x"], centre, F.col("vx")),
        (CH["velocity_y"], centre, F.col("vy")),
    )


def merge_cells(cells: DataFrame, keys: Sequence[str], grid: Grid = Grid()) -> DataFrame:
    """One value per cell: the largest, but velocities add up and are clipped to +-40."""
    limit = K.RASTER_VELOCITY_SCALE
    total = F.least(F.greatest(F.sum("value"), F.lit(-limit)), F.lit(limit))
    moving = F.col("channel").isin(CH["velocity_x"], CH["velocity_y"])
    g = cells.groupBy(*keys, "channel", "cell").agg(F.max("value").alias("_max"), total.alias("_sum"))
    return g.select(
        *keys,
        "channel",
        F.expr(f"cell div {grid.width}").cast("int").alias("row"),
        (F.col("cell") % grid.width).alias("col"),
        F.when(moving, F.col("_sum")).otherwise(F.col("_max")).alias("value"),
    )


def rasterize(
    keys: Sequence[str],
    segments: DataFrame | None = None,
    lights: DataFrame | None = None,
    routes: DataFrame | None = None,
    tokens: DataFrame | None = None,
    grid: Grid = Grid(),
) -> DataFrame:
    """Sparse raster (keys, channel, row, col, value) of all layers given.

    The layers own different channels, so each is merged alone.  A layer's rows, which are few beside their cells, are written once.
    They are placed by frame before they are drawn, and their cells then meet without another shuffle; only frames
    with more than CROWDED rows in a layer are dealt out row by row, and their cells shuffled after a map-side merge.
    The number of tasks goes by the rows of a layer and the cells that one of them may draw.
    """
    line, actor = _line_cells(grid), _stamp_cells(grid.pixels(grid.actor_radius))
    # Each layer's rows, how they are drawn, and the cells of one row at most
    layers = (
        (segments, lane_layers, 2 * line),
        (lights, light_layers, 2 * _stamp_cells(2)),
        (routes, route_layers, line),
        (tokens, actor_layers, actor + 2),
    )
    parts = []
    for source, draw, each in layers:
        if source is not None:
            source = settle(source, "layer")
            crowded = settle(source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED), "crowded_frames")
            many = crowded.agg(F.sum("_n")).first()[0] or 0
            by_frame = source.join(crowded, list(keys), "left_anti").repartition(_tasks(source, source.count() - many, each), *keys)
            dealt = source.join(crowded, list(keys), "left_semi").repartition(_tasks(source, many, each))
            parts += [merge_cells(draw(rows, keys, grid, placed=True), keys, grid) for rows in (by_frame, dealt)]
    if not parts:
        raise ValueError("nothing to draw")
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return cells


def fill_speed_limit(cells: DataFrame, frames: DataFrame, keys: Sequence[str], limit: str, grid: Grid = Grid()) -> DataFrame:
    """Option of behaviour-cloning logs: channel 17 is the frame's own limit everywhere.

    Returned as one row per frame with null row and column, standing for all cells.
    """
    whole = frames.select(
        *keys,
        F.lit(CH["speed_limit"]).alias("channel"),
        F.lit(None).cast("int").alias("row"),
        F.lit(None).cast("int").alias("col"),
        F.col(limit).cast("double").alias("value"),
    )
    return cells.where(F.col("channel") != CH["speed_limit"]).unionByName(whole)


def channel_stats(cells: DataFrame, keys: Sequence[str], grid: Grid = Grid(), frames: DataFrame | None = None) -> DataFrame:
    """Minimum, maximum and mean per channel over all cells, the implicit zeros included.

    Every channel of every frame has a row, also those without cells; ``frames`` lists the frames
    (columns ``keys``), by default those with a cell.
    """
    n = grid.height * grid.width
    full = F.count(F.lit(1)) == n
    lo, hi = F.min("value"), F.max("value")
    drawn = cells.groupBy(*keys, "channel").agg(
        F.when(full, lo).otherwise(F.least(lo, F.lit(0.0))).alias("min"),
        F.when(full, hi).otherwise(F.greatest(hi, F.lit(0.0))).alias("max"),
        (F.sum("value") / n).alias("mean"),
    )
    listed = (cells if frames is None else frames).select(*keys).distinct()
    every = listed.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(K.RASTER_CHANNELS - 1))))
    j = every.join(drawn.withColumnsRenamed({k: f"_{k}" for k in [*keys, "channel"]}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "channel"]], "left")
    return j.select(*keys, "channel", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("min", "max", "mean")])
