"""Normalisation, padding and validity masks as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayframe import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def ego_vector() -> Column:
    """Ego state as 14 numbers, from the frame columns; yaw rate and curvature are clamped, the rest is not."""
    col = F.col
    return F.array(
        col("speed_mps") / K.SPEED_SCALE,
        clamp(col("yaw_rate") / K.YAW_RATE_SCALE, -1.0, 1.0),
        col("accel_long") / K.ACCEL_SCALE,
        col("accel_lat") / K.ACCEL_SCALE,
        clamp(col("curvature") / K.CURVATURE_SCALE, -1.0, 1.0),
        col("steer_angle_rad") / F.pi(),
        col("steer_norm").cast("double"),
        col("throttle").cast("double"),
        col("brake").cast("double"),
        col("speed_limit_mps") / K.SPEED_LIMIT_SCALE,
        col("command") / K.COMMAND_SCALE,
        col("gear") / K.GEAR_SCALE,
        col("time_of_day_sin").cast("double"),
        col("time_of_day_cos").cast("double"),
    )


def normalize_xy(points) -> Column:
    """``array<array<double>>`` of metres to [-1, 1]."""
    return F.transform(_c(points), lambda p: F.transform(p, lambda v: clamp(v / K.SPATIAL_SCALE, -1.0, 1.0)))


normalize_route = normalize_xy


def normalize_speed(v) -> Column:
    return F.transform(_c(v), lambda s: clamp(s / K.SPEED_SCALE, 0.0, 1.0))


def normalize_futures(xy, v) -> tuple[Column, Column]:
    return normalize_xy(xy), normalize_speed(v)


def normalize_objects(objects) -> Column:
    """Object feature rows of 11; type, yaw and flag columns stay as they are."""

    def feature(o: Column, i: int) -> Column:
        v = o[i]
        if i in (1, 2):
            return clamp(v / K.SPATIAL_SCALE, -1.0, 1.0)
        if i == 5:
            return clamp(v / K.LENGTH_SCALE, 0.0, 1.0)
        if i == 6:
            return clamp(v / K.BREADTH_SCALE, 0.0, 1.0)
        if i in (7, 8):
            return clamp(v / K.SPEED_SCALE, -1.0, 1.0)
        return v

    return F.transform(_c(objects), lambda o: F.array(*[feature(o, i) for i in range(K.OBJECT_WIDTH)]))


def normalize_cell(channel, value) -> Column:
    """Raster cell value by channel; zero stays zero, so a sparse grid stays sparse."""
    ch, v = _c(channel), _c(value)
    moving = ch.isin(K.CHANNELS["velocity_x"], K.CHANNELS["velocity_y"])
    return (
        F.when(moving, clamp(v / K.RASTER_VELOCITY_SCALE, -1.0, 1.0))
        .when(ch == K.CHANNELS["speed_limit"], clamp(v / K.SPEED_LIMIT_SCALE, 0.0, 1.0))
        .otherwise(v)
    )


def denormalize_xy(points) -> Column:
    return F.transform(_c(points), lambda p: F.transform(p, lambda v: v * K.SPATIAL_SCALE))


def denormalize_speed(v) -> Column:
    return F.transform(_c(v), lambda s: s * K.SPEED_SCALE)


def denormalize_futures(xy, v) -> tuple[Column, Column]:
    return denormalize_xy(xy), denormalize_speed(v)


def route_mask(route) -> Column:
    """1 where a normalised route point is real: anything nearer than 0.1 m counts as padding."""
    return F.transform(_c(route), lambda p: (F.abs(p[0]) + F.abs(p[1])) > 1e-3)


def pad_to(arr, n: int, zero: Column) -> Column:
    """Cut or fill an array to ``n`` elements."""
    empty = F.array_repeat(zero, 0)
    a = F.slice(F.coalesce(_c(arr), empty), 1, n)
    return F.concat(a, F.array_repeat(zero, F.lit(n) - F.size(a)))


def pad_mask(arr, n: int) -> Column:
    """1.0 for real elements, 0.0 for padding, after :func:`pad_to`."""
    real = F.least(F.coalesce(F.size(_c(arr)), F.lit(0)), F.lit(n))
    real = F.greatest(real, F.lit(0))
    return F.concat(F.array_repeat(F.lit(1.0), real), F.array_repeat(F.lit(0.0), F.lit(n) - real))
