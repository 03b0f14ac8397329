"""Joins between frames and their actors and lights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions.geometry import object_type, rotate_to_ego, to_ego_xy, wrap_pi
from wayframe.plans.segments import ROWS_PER_TASK, dealt


def nearby_actors(egos: DataFrame, actors: DataFrame, radius: float = K.ACTOR_RADIUS_M, tick: str = "tick") -> DataFrame:
    """Actors within ``radius`` of the vehicle at the same tick, border included.

    ``egos`` has one row per tick, so the join never multiplies actor rows, and
    adaptive execution can split a hot tick on the actor side.
    """
    j = actors.join(egos, tick)
    dx, dy = F.col("x_w") - F.col("ego_x"), F.col("y_w") - F.col("ego_y")
    return j.where(dx * dx + dy * dy <= radius * radius)


def object_tokens(df: DataFrame) -> DataFrame:
    """Object features in the vehicle's axes, for actor rows joined with the vehicle's pose.

    Rows that are neither vehicles nor walkers are dropped.
    """
    x, y = to_ego_xy("x_w", "y_w", "ego_x", "ego_y", "ego_yaw")
    vx, vy = rotate_to_ego("vx_w", "vy_w", "ego_yaw")
    typed = df.withColumn("type_id", object_type("type_name")).where(F.col("type_id").isNotNull())
    out = typed.select(
        *typed.columns,
        x.alias("x_ego"),
        y.alias("y_ego"),
        wrap_pi(F.radians("yaw_w") - F.radians("ego_yaw")).alias("yaw"),
        (F.col("extent_x") * 2.0).alias("length"),
        (F.col("extent_y") * 2.0).alias("width"),
        vx.alias("vx"),
        vy.alias("vy"),
    )
    return out.select(
        "*",
        F.sin("yaw").alias("sin_yaw"),
        F.cos("yaw").alias("cos_yaw"),
        (F.col("vx") < -1.0).cast("int").alias("oncoming_flag"),
        (F.col("type_id") == K.VEHICLE).cast("int").alias("priority_flag"),
    )


def _any_per_tick(lights: DataFrame, condition: Column, name: str, keys: Sequence[str]) -> DataFrame:
    """One row per tick that has a light fulfilling the condition (combined before the shuffle)."""
    return lights.where(condition).select(*keys).distinct().withColumn(name, F.lit(True))


def near_light(
    frames: DataFrame, lights: DataFrame, radius: float = K.LIGHT_RADIUS_M, keys: Sequence[str] = ("tick",), rows: int = 0
) -> DataFrame:
    """Add ``near_light``: a light's stop point lies within ``radius`` of the vehicle.  ``rows``: see segments.scan."""
    close = F.hypot("stop_x", "stop_y") < radius
    hits = _any_per_tick(lights, close, "near_light", keys)
    frames = dealt(frames, keys, rows) if rows > ROWS_PER_TASK else frames
    return frames.join(hits, list(keys), "left").withColumn("near_light", F.coalesce("near_light", F.lit(False)))


def traffic_violation(
    frames: DataFrame,
    lights: DataFrame,
    reach: float = K.STOP_LINE_REACH_M,
    lane_event: Column | None = None,
    keys: Sequence[str] = ("tick",),
) -> DataFrame:
    """Add ``stop_line_violation``: a red or yellow stop line just ahead, or a new lane invasion."""
    ahead = F.col("stop_x").between(0.0, reach) & (F.abs("stop_y") <= reach) & F.col("state").isin(K.RED, K.YELLOW)
    hits = _any_per_tick(lights, ahead, "stop_line_violation", keys)
    flag = F.coalesce("stop_line_violation", F.lit(False))
    if lane_event is not None:
        flag = flag | lane_event
    return frames.join(hits, list(keys), "left").withColumn("stop_line_violation", flag)
