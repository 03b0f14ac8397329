"""Future labels: forward as-of lookups along an episode, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions.geometry import command_from_path
from wayframe.plans.segments import SEG, dealt
from wayframe.sources.shared import settle

EPISODE = ("run_id", "episode_ord")
BUCKET_HORIZONS = 256


def future_samples(
    df: DataFrame,
    n: int = K.FUTURE_STEPS,
    step_us: int = K.FUTURE_STEP_US,
    keys: Sequence[str] = EPISODE,
    order: str = "frame_id",
    time: str = "t_us",
    values: Sequence[str] = ("x_m", "y_m", "speed_mps"),
    tail: str | None = "is_tail",
    bucket_us: int | None = None,
) -> DataFrame:
    """Label every base row with its next ``n`` samples (array column ``samples``).

    Target ``k`` is ``time + k * step_us``.  The sample taken is the first one at
    or after the target, but at least one row after the sample taken for
    ``k - 1``.  The array is null when the episode's samples end before the last
    target, and shorter than ``n`` when the forced progress runs off the end.
    Rows flagged by ``tail`` serve as samples only and are not returned.

    Plan: rows are put into time buckets at least one horizon wide.  A bucket
    needs, besides its own rows, the rows before its last target and ``n`` more;
    those are copied into it, so that one shuffle on (episode, bucket) brings
    everything together.  Windows over the bucket, latest rows first, then carry the
    first sample at or after each target and how many rows follow it; rows are never collected
    into arrays.  Where the forced progress moves a step on to a later row than that, and only there,
    the sample is fetched by its place: an equi-join on (episode, bucket, place) with the written rows.
    The rows are written once for this, to the shared folder.  They are counted first, and the number of tasks goes by them.  A bucket's size is bounded by the tick rate,
    however long the episode is; narrower buckets (``bucket_us``) give smaller tasks.
    """
    horizon = n * step_us
    width = max(bucket_us or horizon * BUCKET_HORIZONS, horizon)
    keys = list(keys)
    count = df.count()  # of a written table, this only reads footers
    base = df.withColumn(SEG, F.expr(f"`{time}` div {int(width)}"))

    # One row per bucket: its extent, the episode's end, and the earlier buckets that look into it.
    by_bucket = W.partitionBy(*keys).orderBy(SEG)
    stats = base.groupBy(*keys, SEG).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(time).alias("_t0"), F.max(time).alias("_t1")
    )
    stats = stats.select(
        *keys,
        SEG,
        "_t0",
        (F.col("_t1") + horizon).alias("_reach"),
        F.max("_t1").over(W.partitionBy(*keys)).alias("_end"),
        F.row_number().over(by_bucket).alias("_ord"),
        (F.sum("_rows").over(by_bucket) - F.col("_rows")).alias("_off"),
    )
    # Rows before the first bucket that starts at or after the reach; that is the next bucket or the one after.
    past = F.when(F.lead("_t0", 1).over(by_bucket) >= F.col("_reach"), F.lead("_off", 1).over(by_bucket)).otherwise(
        F.lead("_off", 2).over(by_bucket)
    )
    stats = stats.withColumn("_past", past)
    looking = F.collect_list(F.struct(F.col(SEG).alias("s"), "_reach", "_past", "_ord")).over(
        by_bucket.rowsBetween(-(n + 1), -1)
    )
    stats = stats.withColumn("_looking", looking)
    stats = stats.select(
        *keys,
        SEG,
        "_end",
        F.filter(
            "_looking",
            lambda b: (F.col("_ord") - b["_ord"] == 1) | (F.col("_off") - b["_past"] < n),
        ).alias("_looking"),
    )

    payload = [c for c in df.columns if c not in keys]

    # Copy a row into an earlier bucket if fewer than n samples lie between that bucket's reach and the row.
    # The hint: by its compressed file, a table of many short episodes looks small enough to be broadcast.
    in_bucket = W.partitionBy(*keys, SEG).orderBy(time, order)
    rows = dealt(base, [*keys, SEG], count).join(stats.hint("shuffle_hash"), [*keys, SEG]).withColumn("_nth_before", F.lag(time, n).over(in_bucket))
    earlier = F.filter("_looking", lambda b: F.col("_nth_before").isNull() | (F.col("_nth_before") < b["_reach"]))
    places = F.concat(
        F.array(F.struct(F.col(SEG).alias("s"), F.lit(True).alias("own"))),
        F.transform(earlier, lambda b: F.struct(b["s"].alias("s"), F.lit(False).alias("own"))),
    )
    placed = (
        rows.withColumn("_place", F.explode(places))
        .withColumn(SEG, F.col("_place.s"))
        .withColumn("_own", F.col("_place.own"))
        .drop("_place", "_looking", "_nth_before")
    )

    # With the latest rows first, the frame of target k holds the samples at or after it: its least is the first of them, and
    # its size is what is left of the bucket from there.  Counted from the bucket's end, a step moves on to what the step before
    # left less one, if that is further.
    sample = F.struct(F.col(time).alias("t"), F.col(order).alias("o"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    latest = dealt(placed, [*keys, SEG], count).withColumn("_back", -F.col(time)).withColumn("_is_base", F.col("_own") & (~F.col(tail) if tail else F.lit(True)))
    back = W.partitionBy(*keys, SEG).orderBy("_back")
    frames = {k: back.rangeBetween(W.unboundedPreceding, -k * step_us) for k in range(1, n + 1)}
    # The places come first: their sort of the bare rows serves the frames, too.
    latest = latest.withColumn("_left", F.row_number().over(W.partitionBy(*keys, SEG).orderBy("_back", F.desc(order))))
    ranked = latest.select(
        *keys, SEG, "_is_base", "_end", *payload, "_left",
        *[F.count(F.lit(1)).over(w).alias(f"_l{k}") for k, w in frames.items()],
        *[F.min(sample).over(w).alias(f"_s{k}") for k, w in frames.items()],
    )
    # what is left from the sample of step k on; 0 and less: run off the end
    left = [F.col("_l1")]
    left += [F.least(*[F.col(f"_l{j}") + (j - k) for j in range(1, k + 1)]) for k in range(2, n + 1)]
    known = F.col("_is_base") & (F.col("_end") >= F.col(time) + horizon)
    taken = [
        F.struct(F.lit(k).alias("i"), x.cast("int").alias("left"), F.when(x == F.col(f"_l{k}"), F.col(f"_s{k}")).alias("s"))
        for k, x in enumerate(left, 1)
    ]
    steps = F.when(known, F.filter(F.array(*taken), lambda p: p["left"] > 0))
    stored = settle(ranked.select(*keys, SEG, "_left", "_is_base", *payload, steps.alias("_steps")), "future_steps")

    def shown(i: Column, s: Column) -> Column:
        return F.struct(i.alias("i"), s["t"].alias("t_us"), *[s[f"v{j}"].alias(v) for j, v in enumerate(values)])

    moved = F.exists("_steps", lambda p: p["s"].isNull())
    bases = stored.where("_is_base")
    straight = bases.where(~F.coalesce(moved, F.lit(False))).select(*df.columns, F.transform("_steps", lambda p: shown(p["i"], p["s"])).alias("samples"))
    if n == 1:  # a first step is moved on by none
        return straight
    # These are few unless samples are sparser than the steps.
    asked = bases.where(moved).select(*keys, SEG, F.col("_left").alias("_who"), F.inline(F.filter("_steps", lambda p: p["s"].isNull())))
    place = [*keys, SEG, "left"]
    there = stored.select(*keys, SEG, F.col("_left").cast("int").alias("left"), sample.alias("s"))
    got = asked.drop("s").join(there, place).groupBy(*keys, SEG, F.col("_who").alias("_left")).agg(F.collect_list(F.struct("i", "s")).alias("_got"))
    direct = F.transform(F.filter("_steps", lambda p: p["s"].isNotNull()), lambda p: F.struct(p["i"].alias("i"), p["s"].alias("s")))
    both = F.array_sort(F.concat(direct, "_got"), lambda a, b: a["i"] - b["i"])
    forced = bases.where(moved).join(got, [*keys, SEG, "_left"]).select(*df.columns, F.transform(both, lambda p: shown(p["i"], p["s"])).alias("samples"))
    return straight.unionByName(forced)


def future_waypoints(df: DataFrame) -> DataFrame:
    """Samples in the base frame's own axes: ``futures`` = array of (i, t_us, x, y, v)."""
    a = F.radians("yaw_deg")
    c, s = F.cos(a), F.sin(a)
    base = df.withColumn("_c", c).withColumn("_s", s)

    def turn(p: Column) -> Column:
        dx, dy = p["x_m"] - F.col("x_m"), p["y_m"] - F.col("y_m")
        return F.struct(
            p["i"].alias("i"),
            p["t_us"].alias("t_us"),
            (dx * F.col("_c") + dy * F.col("_s")).alias("x"),
            (dy * F.col("_c") - dx * F.col("_s")).alias("y"),
            p["speed_mps"].alias("v"),
        )

    # As a generated column: later filters and columns then read it and don't repeat the lookups and turns.
    out = base.select("*", F.inline(F.array(F.struct(F.transform("samples", turn).alias("futures")))))
    return out.drop("_c", "_s", "samples")


def _steps(futures: Column, f) -> Column:
    """``f(later, earlier)`` over neighbouring points."""
    k = F.greatest(F.size(futures) - 1, F.lit(0))
    return F.zip_with(F.slice(futures, F.lit(2), k), F.slice(futures, F.lit(1), k), f)


def future_extrema(df: DataFrame) -> DataFrame:
    """Largest step, first-to-last displacement, top speed and furthest forward reach of ``futures``."""
    f = F.col("futures")
    first, last = F.get(f, F.lit(0)), F.element_at(f, -1)
    some = F.size(f) > 0
    return df.select(
        "*",
        F.coalesce(
            F.array_max(_steps(f, lambda b, a: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))), F.lit(0.0)
        ).alias("max_step"),
        F.when(some, F.hypot(last["x"] - first["x"], last["y"] - first["y"])).otherwise(0.0).alias("displacement"),
        F.when(some, F.array_max(F.transform(f, lambda p: p["v"]))).otherwise(0.0).alias("max_speed"),
        F.when(some, F.array_max(F.transform(f, lambda p: p["x"]))).otherwise(0.0).alias("max_forward"),
    )


def command_from_futures(df: DataFrame, lane_width: float = K.LANE_WIDTH_M) -> DataFrame:
    """Command implied by the driven path, and whether it differs from the stored one."""
    last = F.element_at(F.col("futures"), -1)
    seen = command_from_path(last["x"], last["y"], F.size("futures"), lane_width)
    return df.withColumn("exec_command", seen).withColumn(
        "command_disagrees", F.col("exec_command").isNotNull() & (F.col("exec_command") != F.col("command"))
    )


def future_variation(df: DataFrame) -> DataFrame:
    """Mean absolute change between neighbouring future points, per sample (x, y, v)."""

    def mean_change(field: str) -> Column:
        d = _steps(F.col("futures"), lambda b, a: F.abs(b[field] - a[field]))
        return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(d)

    return df.where(F.size("futures") > 1).select(
        "*", *[mean_change(c).alias(f"variation_{c}") for c in ("x", "y", "v")]
    )


def future_variation_report(df: DataFrame) -> DataFrame:
    """Means over samples of :func:`future_variation`, and how many hardly vary at all."""
    v = future_variation(df)
    return v.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("variation_x").alias("mean_variation_x"),
        F.avg("variation_y").alias("mean_variation_y"),
        F.avg("variation_v").alias("mean_variation_v"),
        F.count_if(F.col("variation_x") < 1e-4).alias("flat_x"),
        F.count_if(F.col("variation_y") < 1e-5).alias("flat_y"),
    )
