"""Which ticks of an episode are recorded: gate, cuts and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions.hashing import uniform
from wayframe.operators.futures import EPISODE
from wayframe.plans.segments import SEG, WIDTH, Running, dealt, dense_index, halo, own_rows, scan


def drop_action_mismatch(df: DataFrame) -> DataFrame:
    """Drop ticks that brake and accelerate at speed."""
    return df.where(~((F.col("speed_mps") > 0.5) & (F.col("brake") > 0.5) & (F.col("throttle") > 0.2)))


def mark_gate(
    df: DataFrame,
    ticks: int = K.GATE_TICKS,
    min_speed: float = K.GATE_SPEED_MPS,
    has_route: Column | None = None,
    keys: Sequence[str] = EPISODE,
    index: str = "frame_id",
    width: int = WIDTH,
    gaps: bool = False,
    rows: int = 0,
) -> DataFrame:
    """Add ``recording``: true from the tick that completes the first run of ``ticks`` good ticks.

    Needs a look-back of ``ticks - 1`` rows and one minimum per episode, so it
    works per segment: no task holds a whole episode.  Ticks are counted as rows:
    with ``gaps`` the counter ``index`` may jump, and rows are numbered first;
    without, it has to be consecutive, and a jump in it is an error when the rows are read.
    ``rows``: see segments.scan.
    """
    good = F.col("speed_mps") >= min_speed
    if has_route is not None:
        good = good & has_route
    at = "_row" if gaps else index
    ticked = dense_index(df, keys, index, at, width, rows=rows) if gaps else df
    spread = dealt(halo(ticked.withColumn("_good", good.cast("int")), at, back=ticks - 1, width=width), [*keys, SEG], rows)
    run = W.partitionBy(*keys, SEG).orderBy(at).rowsBetween(-(ticks - 1), 0)
    ready = F.sum("_good").over(run) >= ticks
    marked = own_rows(spread.withColumn("_ready", ready), keep_segment=True)
    start = Running("min", F.when(F.col("_ready"), F.col(at)), "all")
    whole = {} if gaps else {
        "_rows": Running("sum", F.lit(1).cast("bigint"), "all"), "_low": Running("min", F.col(at), "all"), "_high": Running("max", F.col(at), "all"),
    }
    out = scan(marked, keys, at, width, _start=start, **whole)
    recording = F.coalesce(F.col(at) >= F.col("_start"), F.lit(False))
    if not gaps:
        error = F.raise_error(F.lit(f"{index} has gaps or repeats; see the option gaps")).cast("boolean")
        recording = F.when(F.col("_high") - F.col("_low") + 1 == F.col("_rows"), recording).otherwise(error)
    return out.withColumn("recording", recording).drop("_good", "_ready", "_start", *whole, *(["_row"] if gaps else []))


def recording_gate(df: DataFrame, **options) -> DataFrame:
    """Keep the ticks from the one that opens the gate; it never closes again."""
    return mark_gate(df, **options).where("recording").drop("recording")


def cut_at_goal(
    df: DataFrame,
    reach: float = K.GOAL_REACH_M,
    keys: Sequence[str] = EPISODE,
    index: str = "frame_id",
    width: int = WIDTH,
) -> DataFrame:
    """End the episode before its first tick within ``reach`` of the goal (that tick is dropped)."""
    first = Running("min", F.when(F.col("goal_dist_m") <= reach, F.col(index)), "all")
    out = scan(df, keys, index, width, _first=first)
    return out.where(F.col("_first").isNull() | (F.col(index) < F.col("_first"))).drop("_first")


def cut_at_terminal(
    df: DataFrame,
    collision: bool = True,
    offroad: bool = True,
    completion: bool = True,
    keys: Sequence[str] = EPISODE,
    index: str = "frame_id",
    width: int = WIDTH,
) -> DataFrame:
    """End the episode at its first terminal tick, which is kept, and name the reason.

    Reads the flags ``collision_flag``, ``offroad_flag``, ``route_completed``; on
    one tick a collision wins over leaving the road, and that over completion.
    """
    event = F.lit(None).cast("string")
    for on, flag, name in (
        (completion, "route_completed", "goal"),
        (offroad, "offroad_flag", "offroad"),
        (collision, "collision_flag", "collision"),
    ):
        if on:
            event = F.when(F.col(flag), F.lit(name)).otherwise(event)
    marked = df.withColumn("_event", event)
    first = F.when(F.col("_event").isNotNull(), F.struct(F.col(index).alias("at"), F.col("_event").alias("reason")))
    out = scan(marked, keys, index, width, _first=Running("min", first, "all"))
    kept = out.where(F.col("_first").isNull() | (F.col(index) <= F.col("_first.at")))
    return kept.withColumn("termination", F.coalesce(F.col("_first.reason"), F.lit("none"))).drop("_first", "_event")


def thin_stationary(
    df: DataFrame,
    ratio: float = K.STATIONARY_KEEP_RATIO,
    max_run: int = K.STATIONARY_MAX_RUN,
    key: Sequence[str] = ("run_id", "episode_ord", "frame_id"),
    seed: int = 0,
    keys: Sequence[str] = EPISODE,
    index: str = "idx",
    width: int = WIDTH,
    rows: int = 0,
) -> DataFrame:
    """Add ``keep``: stationary frames survive near a light, or by chance early in a standstill.

    Reads ``stationary`` and ``near_light``.  A frame is early while it is at
    most the ``max_run``-th stationary frame since the vehicle last moved, which
    a look-back of ``max_run`` rows decides.  ``index`` numbers the rows of an
    episode consecutively; ``key``, the whole key of a frame, feeds the hash that decides the chance.
    ``rows``: see segments.scan.
    """
    spread = dealt(halo(df, index, back=max_run, width=width), [*keys, SEG], rows)
    run = W.partitionBy(*keys, SEG).orderBy(index).rowsBetween(-max_run, 0)
    standing = F.sum(F.col("stationary").cast("int")).over(run)
    early = standing <= max_run
    chance = uniform([F.col(x) for x in key], seed) < ratio
    keep = ~F.col("stationary") | F.col("near_light") | (early & chance)
    return own_rows(spread.withColumn("keep", keep))


def mark_terminal(
    df: DataFrame, keys: Sequence[str] = EPISODE, index: str = "frame_id", width: int = WIDTH
) -> DataFrame:
    """Flag the last surviving row of each episode: ``done`` true and ``discount`` 0 there."""
    out = scan(df, keys, index, width, _last=Running("max", F.col(index), "all"))
    done = F.col(index) == F.col("_last")
    return out.select(*df.columns, done.alias("done"), F.when(done, 0.0).otherwise(1.0).alias("discount"))
