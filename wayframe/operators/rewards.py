"""Offline-RL labels: reward components, running normalisation, terminals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.operators.futures import EPISODE
from wayframe.operators.futures import future_samples, future_waypoints
from wayframe.operators.gates import cut_at_terminal, mark_gate, mark_terminal
from wayframe.operators.motion import jerk
from wayframe.plans.segments import SEG, WIDTH, neighbours, segment_of
from wayframe.sources.shared import settle


def offroad_flag(lane_type: str = "lane_type", driving: int = K.DRIVING_LANE) -> Column:
    """No lane at the position, or not a driving lane."""
    return F.coalesce(F.col(lane_type) != driving, F.lit(True))


def rewards(
    df: DataFrame, weights: Mapping[str, float] | None = None, clip: tuple[float, float] = K.REWARD_CLIP
) -> DataFrame:
    """Add the six weighted components, their sum ``reward_raw`` and ``reward_clipped``.

    Reads ``route_progress_delta``, ``collision_flag``, ``offroad_flag``,
    ``violation_flag``, ``jerk``, ``steer_change`` and ``route_completed``.
    """
    w = {**K.REWARD_WEIGHTS, **(weights or {})}
    flag = {"collision": "collision_flag", "offroad": "offroad_flag", "violation": "violation_flag", "completion": "route_completed"}
    parts = {
        "progress": F.greatest(F.lit(0.0), F.col("route_progress_delta")) * w["progress"],
        **{n: F.col(c).cast("double") * w[n] for n, c in flag.items()},
        "comfort": (F.abs("jerk") + F.abs("steer_change")) * w["comfort"],
    }
    out = df.select("*", *[c.alias(f"reward_{n}") for n, c in parts.items()])
    raw = sum((F.col(f"reward_{n}") for n in ("progress", "collision", "offroad", "violation", "comfort", "completion")), F.lit(0.0))
    out = out.withColumn("reward_raw", raw)
    return out.withColumn("reward_clipped", F.least(F.greatest("reward_raw", F.lit(clip[0])), F.lit(clip[1])))


def running_normalise(
    df: DataFrame,
    value: str = "reward_clipped",
    keys: Sequence[str] = ("run_id",),
    order: str = "run_tick",
    gate: str | None = "recording",
    width: int = WIDTH,
) -> DataFrame:
    """Add ``reward_mean``, ``reward_std`` (population) and ``reward_normalized``, running over the whole run.

    Only gated rows count.  A gated row gets ``(x - mean) / std``, or 0 while the
    deviation is at most 1e-6; other rows keep ``x`` with statistics 0.

    A run is one long sequence, so its segments are summarised (count, mean, sum
    of squared deviations), the summaries are accumulated, and each row's local
    statistics are merged with those before its segment by the pairwise formula
    of Chan, Golub and LeVeque.
    """
    keys = list(keys)
    used = F.col(value) if gate is None else F.when(F.col(gate), F.col(value))
    base = df.withColumn("_x", used.cast("double")).withColumn(SEG, segment_of(order, width))

    s = base.groupBy(*keys, SEG).agg(
        F.count("_x").alias("_n"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("_x")).alias("_q")
    )
    prior = W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    s = s.select(*keys, SEG, "_n", "_m", "_q", F.sum("_n").over(prior).alias("_n0"), F.sum(F.col("_n") * F.col("_m")).over(prior).alias("_s0"))
    s = s.withColumn("_m0", F.col("_s0") / F.nullif(F.col("_n0"), F.lit(0)))
    # Squared deviations accumulate as each segment's own plus the shift between its mean and the mean before it.
    gain = F.coalesce(F.col("_q"), F.lit(0.0)) + F.coalesce(
        (F.col("_m") - F.col("_m0")) ** 2 * F.col("_n") * F.col("_n0") / F.nullif(F.col("_n") + F.col("_n0"), F.lit(0)), F.lit(0.0)
    )
    s = s.withColumn("_gain", gain)
    s = s.select(
        *keys,
        SEG,
        F.coalesce("_n0", F.lit(0)).alias("_n0"),
        F.coalesce("_m0", F.lit(0.0)).alias("_m0"),
        F.coalesce(F.sum("_gain").over(prior), F.lit(0.0)).alias("_q0"),
    )

    local = W.partitionBy(*keys, SEG).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    j = base.join(s, [*keys, SEG]).select(
        *df.columns,
        "_x", "_n0", "_m0", "_q0",
        F.count("_x").over(local).alias("_n1"),
        F.coalesce(F.avg("_x").over(local), F.lit(0.0)).alias("_m1"),
        F.coalesce(F.var_pop("_x").over(local), F.lit(0.0)).alias("_v1"),
    )
    n0, n1 = F.col("_n0"), F.col("_n1")
    n = n0 + n1
    shift = F.col("_m1") - F.col("_m0")
    mean = F.col("_m0") + shift * n1 / n
    spread = F.sqrt(F.greatest((F.col("_q0") + F.col("_v1") * n1 + shift * shift * n0 * n1 / n) / n, F.lit(0.0)))
    gated = F.col("_x").isNotNull()
    j = j.withColumn("reward_mean", F.when(gated, mean).otherwise(0.0)).withColumn(
        "reward_std", F.when(gated, spread).otherwise(0.0)
    )
    z = (
        F.when(~gated, F.col(value))
        .when(F.col("reward_std") > 1e-6, (F.col(value) - F.col("reward_mean")) / F.col("reward_std"))
        .otherwise(0.0)
    )
    return j.select(*df.columns, "reward_mean", "reward_std", z.alias("reward_normalized"))


def tick_events(
    df: DataFrame, dt: float, start: Column | None = None, reach: float = K.GOAL_REACH_M,
    keys: Sequence[str] = EPISODE, index: str = "frame_id", width: int = WIDTH, rows: int = 0,
) -> DataFrame:
    """All tick-to-tick inputs of the reward with one look at the previous tick.

    Adds ``jerk``, ``steer_change``, ``route_progress_delta``, ``collision_flag``,
    ``lane_flag``, ``offroad_flag``, ``violation_flag`` and ``route_completed``.
    A column ``stop_line_violation`` (see joins.traffic_violation) is honoured.  ``rows``: see segments.scan.
    """
    was = F.struct("accel_long", "accel_lat", "steer_norm", "goal_dist_m", "collisions_cum", "lane_events_cum")
    out = neighbours(df, keys, index, width=width, rows=rows, _was=was)
    w = lambda c: F.col(f"_was.{c}")
    grew = lambda c: F.col(c) > F.coalesce(w(c), F.lit(0))
    before = w("goal_dist_m") if start is None else F.coalesce(w("goal_dist_m"), start)
    lane = grew("lane_events_cum")
    stop = F.coalesce(F.col("stop_line_violation"), F.lit(False)) if "stop_line_violation" in df.columns else F.lit(False)
    return out.select(
        *df.columns,
        jerk(F.col("accel_long"), F.col("accel_lat"), w("accel_long"), w("accel_lat"), dt).alias("jerk"),
        F.abs(F.col("steer_norm") - F.coalesce(w("steer_norm"), F.lit(0.0))).alias("steer_change"),
        F.greatest(F.lit(0.0), F.coalesce(before - F.col("goal_dist_m"), F.lit(0.0))).alias("route_progress_delta"),
        grew("collisions_cum").alias("collision_flag"),
        lane.alias("lane_flag"),
        offroad_flag().alias("offroad_flag"),
        (lane | stop).alias("violation_flag"),
        (F.col("goal_dist_m") <= reach).alias("route_completed"),
    )


def rl_labels(
    df: DataFrame,
    dt: float,
    weights: Mapping[str, float] | None = None,
    clip: tuple[float, float] = K.REWARD_CLIP,
    termination: Mapping[str, bool] | None = None,
    reach: float = K.GOAL_REACH_M,
    start: Column | None = None,
    run: Sequence[str] = ("run_id",),
    run_order: str = "run_tick",
    width: int = WIDTH,
    horizon: tuple[int, int] | None = None,
    gaps: bool = False,
) -> DataFrame:
    """Rewards, running statistics, episode end and terminal marks of the recorded frames.

    With ``horizon`` (steps, microseconds per step) recorded frames get their ``futures``, those without all
    of them are dropped, and the last frame that is left is the terminal one.  ``gaps``: see gates.mark_gate.
    Rewards are computed on every tick, the running statistics count from the
    moment the gate opens, an episode ends at its first terminal tick, and its
    last recorded frame is marked.  The controls are carried as actions.
    """
    # Each step reads its input more than once, so the ticks are written between them and the plan stays flat.
    steps = settle(tick_events(settle(mark_gate(df, width=width, gaps=gaps), "ticks"), dt, start, reach, width=width), "ticks")
    # Ticks after the end of an episode do not exist for the run statistics.
    t = dict(termination or {})
    cut = cut_at_terminal(steps, t.get("collision", True), t.get("offroad", True), t.get("completion", True), width=width)
    scored = running_normalise(rewards(cut, weights, clip), keys=run, order=run_order, width=width)
    kept = settle(scored, "ticks").where("recording").select(
        "*",
        F.col("steer_norm").alias("action_steer"),
        F.col("throttle").alias("action_throttle"),
        F.col("brake").alias("action_brake"),
    )
    if horizon is not None:
        n, step_us = horizon
        kept = future_waypoints(future_samples(kept, n, step_us, tail=None)).where(F.size("futures") == n)
        kept = settle(kept, "ticks")
    return mark_terminal(kept, width=width)
