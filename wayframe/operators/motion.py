"""Tick-to-tick quantities: comfort, progress, counter events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe.operators.futures import EPISODE
from wayframe.plans.segments import WIDTH, Running, neighbours, scan


def jerk(along: Column, across: Column, prev_along: Column, prev_across: Column, dt: float) -> Column:
    """Size of the acceleration change per second; 0 without a previous tick."""
    if dt <= 0:
        return F.lit(0.0)
    return F.coalesce(F.hypot((along - prev_along) / dt, (across - prev_across) / dt), F.lit(0.0))


def comfort(
    df: DataFrame, dt: float, keys: Sequence[str] = EPISODE, index: str = "frame_id", width: int = WIDTH
) -> DataFrame:
    """Add ``jerk`` and ``steer_change``; the first tick's steering change is against 0."""
    was = F.struct("accel_long", "accel_lat", "steer_norm")
    out = neighbours(df, keys, index, width=width, _was=was)
    return out.select(
        *df.columns,
        jerk(F.col("accel_long"), F.col("accel_lat"), F.col("_was.accel_long"), F.col("_was.accel_lat"), dt).alias("jerk"),
        F.abs(F.col("steer_norm") - F.coalesce(F.col("_was.steer_norm"), F.lit(0.0))).alias("steer_change"),
    )


def progress_delta(
    df: DataFrame,
    start: Column | None = None,
    keys: Sequence[str] = EPISODE,
    index: str = "frame_id",
    width: int = WIDTH,
) -> DataFrame:
    """Add ``route_progress_delta``, the distance gained on the goal since the previous tick, at least 0.

    ``start`` is the goal distance at the episode's start, before its first tick.
    """
    out = neighbours(df, keys, index, width=width, _was=F.col("goal_dist_m"))
    before = F.col("_was") if start is None else F.coalesce(F.col("_was"), start)
    gained = F.greatest(F.lit(0.0), F.coalesce(before - F.col("goal_dist_m"), F.lit(0.0)))
    return out.select(*df.columns, gained.alias("route_progress_delta"))


def goal_progress(
    df: DataFrame, keys: Sequence[str] = EPISODE, index: str = "frame_id", width: int = WIDTH
) -> DataFrame:
    """Add ``route_progress_m``: distance gained on the goal since the episode's first tick, at least 0."""
    first = F.struct(F.col(index), F.col("goal_dist_m").alias("d"))
    out = scan(df, keys, index, width, _first=Running("min", first, "all"))
    gained = F.greatest(F.lit(0.0), F.col("_first.d") - F.col("goal_dist_m"))
    return out.select(*df.columns, gained.alias("route_progress_m"))


def counter_increased(
    df: DataFrame,
    counter: str,
    name: str,
    keys: Sequence[str] = EPISODE,
    index: str = "frame_id",
    width: int = WIDTH,
) -> DataFrame:
    """Add a flag: the cumulative counter grew since the previous tick (it starts from 0)."""
    out = neighbours(df, keys, index, width=width, _was=F.col(counter))
    return out.select(*df.columns, (F.col(counter) > F.coalesce(F.col("_was"), F.lit(0))).alias(name))
