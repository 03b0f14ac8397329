"""Training samples: one row per frame with padded children and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions import normalise as N

OBJECT_FEATURES = (
    "type_id", "x_ego", "y_ego", "sin_yaw", "cos_yaw", "length", "width", "vx", "vy", "oncoming_flag", "priority_flag",
)


SALT = 64


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per key, numbered in ``_rn``.

    A key may hold a large part of the table, so its rows are first dealt into
    salted parts of which each keeps its own first ``n``; the final order is
    taken over those.  Spark also limits each part before the shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALT)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    whole = W.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n)


def children(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], n: int, name: str) -> DataFrame:
    """The first ``n`` child rows per frame as an array of feature arrays."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    top = first_rows(df, keys, order, n)
    return top.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", values.alias("v")))), lambda s: s["v"]).alias(name)
    )


def assemble_samples(
    frames: DataFrame,
    route: DataFrame,
    objects: DataFrame,
    futures: DataFrame,
    keys: Sequence[str],
    route_order: Sequence[str] = ("idx",),
    object_order: Sequence[str] = ("idx",),
    future_order: Sequence[str] = ("i",),
    k: int = K.ROUTE_POINTS,
    m: int = K.MAX_OBJECTS,
    n: int = K.FUTURE_STEPS,
) -> DataFrame:
    """Frames with ``route[k][2]``, ``objects[m][11]``, ``future_xy[n][2]``, ``future_v[n]`` and their masks.

    Children beyond the size are cut in arrival order; missing ones are zeros
    with mask 0.
    """
    keys = list(keys)
    r = children(route, keys, route_order, ("x", "y"), k, "_route")
    o = children(objects, keys, object_order, OBJECT_FEATURES, m, "_objects")
    f = children(futures, keys, future_order, ("x", "y", "v"), n, "_futures")
    j = frames.join(r, keys, "left").join(o, keys, "left").join(f, keys, "left")
    pair, row = F.array_repeat(F.lit(0.0), 2), F.array_repeat(F.lit(0.0), K.OBJECT_WIDTH)
    xy = F.transform("_futures", lambda p: F.slice(p, 1, 2))
    v = F.transform("_futures", lambda p: p[2])
    return j.select(
        *frames.columns,
        N.pad_to("_route", k, pair).alias("route"),
        N.pad_to("_objects", m, row).alias("objects"),
        N.pad_mask("_objects", m).alias("object_mask"),
        N.pad_to(xy, n, pair).alias("future_xy"),
        N.pad_to(v, n, F.lit(0.0)).alias("future_v"),
        N.pad_mask("_futures", n).alias("future_mask"),
    )
