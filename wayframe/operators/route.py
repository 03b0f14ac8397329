"""Route polylines: geometry, consumed prefix, resampling, description.

A route is the short polyline of one frame (its point number is a small
integer), so windows per route stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions.geometry import wrap_deg
from wayframe.operators.futures import future_samples
from wayframe.plans.segments import SEG, WIDTH, dealt, segment_of
from wayframe.sources.shared import settle


def route_geometry(df: DataFrame, keys: Sequence[str] = ("route_id",), index: str = "idx") -> DataFrame:
    """Add ``dx``, ``dy``, ``s_frac`` (arc length fraction) and ``curvature`` to route points."""
    w = W.partitionBy(*keys).orderBy(index)
    step = df.select(
        *df.columns,
        (F.col("x") - F.lag("x").over(w)).alias("_bx"),
        (F.col("y") - F.lag("y").over(w)).alias("_by"),
        (F.lead("x").over(w) - F.col("x")).alias("_ax"),
        (F.lead("y").over(w) - F.col("y")).alias("_ay"),
    )
    step = step.withColumn("_d", F.coalesce(F.hypot("_bx", "_by"), F.lit(0.0)))
    s = F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_d").over(W.partitionBy(*keys))
    cross = F.abs(F.col("_bx") * F.col("_ay") - F.col("_by") * F.col("_ax"))
    bend = cross / (F.hypot("_bx", "_by") * F.hypot("_ax", "_ay") + 1e-6)
    zero = F.lit(0.0)
    return step.select(
        *df.columns,
        F.coalesce("_bx", "_ax", zero).alias("dx"),
        F.coalesce("_by", "_ay", zero).alias("dy"),
        F.when(total > 0, s / total).otherwise(0.0).alias("s_frac"),
        F.coalesce(bend, zero).alias("curvature"),
    )


def drop_consumed(
    df: DataFrame,
    min_x: float = 0.0,
    min_far_x: float = 1.0,
    lookahead: int = 7,
    keys: Sequence[str] = ("route_id",),
    index: str = "idx",
) -> DataFrame:
    """Drop the points already passed: keep from the first one that is ahead and leads ahead, else the last point only."""
    w = W.partitionBy(*keys).orderBy(index)
    whole = W.partitionBy(*keys)
    last_x = F.max_by("x", index).over(whole)
    far_x = F.coalesce(F.lead("x", lookahead).over(w), last_x)
    ok = (F.col("x") >= min_x) & (far_x >= min_far_x)
    marked = df.withColumn("_at", F.when(ok, F.col(index))).withColumn("_end", F.max(index).over(whole))
    start = F.coalesce(F.min("_at").over(whole), F.col("_end"))
    return marked.withColumn("_start", start).where(F.col(index) >= F.col("_start")).drop("_at", "_end", "_start")


#: Lengths are counted in whole parts of a metre, so that sums do not depend on where they start.
PARTS_PER_M = 1_000_000_000


def travelled(df: DataFrame, keys: Sequence[str], index: str, width: int = WIDTH) -> DataFrame:
    """Add ``_s``, the length from the route's first point to each point; a route is cut into segments of ``width`` numbers."""
    order = W.partitionBy(*keys, SEG).orderBy(index)
    base = dealt(df.withColumn(SEG, segment_of(index, width)), [*keys, SEG])
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    local = base.withColumn("_step", F.rint(step * PARTS_PER_M).cast("bigint"))
    local = settle(local.withColumn("_s", F.sum("_step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_step"), "route_points")
    ends = local.groupBy(*keys, SEG).agg(F.max("_s").alias("_len"), F.min_by(F.struct("x", "y"), index).alias("_a"), F.max_by(F.struct("x", "y"), index).alias("_b"))
    along = W.partitionBy(*keys).orderBy(SEG)
    gap = F.coalesce(F.hypot(F.col("_a.x") - F.lag("_b.x").over(along), F.col("_a.y") - F.lag("_b.y").over(along)), F.lit(0.0))
    ends = ends.select(*keys, SEG, "_len", F.rint(gap * PARTS_PER_M).cast("bigint").alias("_gap"))
    before = F.sum(F.col("_gap")).over(along) + F.coalesce(F.sum("_len").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select(*keys, SEG, before.alias("_before"))
    return matched(local, starts, [*keys, SEG], local.count()).withColumn("_s", F.col("_s") + F.col("_before")).drop(SEG, "_before")


def matched(left: DataFrame, right: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """Equi-join of written tables of at most so many rows, which no task and not the driver holds.

    Spark goes by the size of files: points compress so well that it would broadcast millions of them.
    """
    return dealt(left, by, rows).join(dealt(right, by, rows).hint("merge"), list(by))


def resample_polyline(
    df: DataFrame,
    k: int = K.ROUTE_POINTS,
    spacing: float = 2.0,
    keys: Sequence[str] = ("route_id",),
    index: str = "idx",
    width: int = WIDTH,
) -> DataFrame:
    """Thin a polyline to points at least ``spacing`` of travelled length apart, at most ``k``.

    The first point is kept; after a kept point the length starts again from 0
    (nothing is carried over).  So each point points to the one that would be kept after it: the first at least
    ``spacing`` further on, an as-of lookup on the travelled length.  The kept points are what the first one
    reaches; pointers are composed with themselves, so ``k`` points take log2(k) rounds.  A step leads to the next stretch
    of ``spacing`` that holds a point, or the one after, so only the first ``2 * k`` such stretches of a route take part.
    No task or row holds a route.  Lengths are compared in nanometres.
    """
    keys = list(keys)
    gap = round(spacing * PARTS_PER_M)
    points = dealt(travelled(df.select(*keys, index, "x", "y"), keys, index, width), keys)
    stretch = F.dense_rank().over(W.partitionBy(*keys).orderBy(F.expr(f"_s div {gap}")))
    points = settle(points.withColumn("_nth", stretch).where(F.col("_nth") <= 2 * k).drop("_nth"), "route_points")
    count = points.count()  # only footers are read
    ahead = future_samples(points, 1, gap, keys, index, "_s", (index,), tail=None)
    then = settle(ahead.select(*keys, F.col(index).alias("_at"), F.get("samples", F.lit(0))[index].alias("_to")).where("_to IS NOT NULL"), "pointers")
    reached = dealt(points.select(*keys, index), keys, count).groupBy(*keys).agg(F.min(index).alias("_at")).withColumn("_hop", F.lit(0))
    rounds = max(k - 1, 0).bit_length()
    for r in range(rounds):
        far = matched(reached, then, [*keys, "_at"], count).select(*keys, F.col("_to").alias("_at"), (F.col("_hop") + 2**r).alias("_hop"))
        reached = settle(dealt(reached.union(far), keys, count), "reached")
        if r == rounds - 1:
            break
        after = then.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        then = settle(matched(then, after, [*keys, "_to"], count).select(*keys, "_at", F.col("_next").alias("_to")), "pointers")
    kept = reached.where(F.col("_hop") < k).select(*keys, F.col("_at").alias(index), "_hop")
    return matched(kept, points, [*keys, index], count).select(*keys, F.col("_hop").alias(index), "x", "y")


def describe_route(df: DataFrame, lookahead: int = 7, keys: Sequence[str] = ("route_id",), index: str = "idx") -> DataFrame:
    """One sentence per route: straight or curving, with headings of its first point and the one looked ahead to."""
    near = df.where(F.col(index) <= lookahead)
    point = F.struct("x", "y")
    ends = near.groupBy(*keys).agg(F.min_by(point, index).alias("a"), F.max_by(point, index).alias("b"))
    heading = lambda p: F.degrees(F.atan2(p["y"], p["x"]))
    out = ends.select(
        *keys,
        heading(F.col("a")).alias("first_heading"),
        heading(F.col("b")).alias("far_heading"),
        F.hypot("b.x", "b.y").alias("far_dist"),
    ).withColumn("turn", wrap_deg(F.col("far_heading") - F.col("first_heading")))
    shape = (
        F.when(F.abs("turn") < 15.0, "continue straight").when(F.col("turn") > 0, "curving left").otherwise("curving right")
    )
    return out.withColumn("shape", shape).withColumn(
        "description",
        F.format_string(
            "%s (Δheading=%+.1f°, first=%+.1f°, lookahead=%+.1f°, lookahead_dist=%.1fm)",
            "shape", "turn", "first_heading", "far_heading", "far_dist",
        ),
    )
