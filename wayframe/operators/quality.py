"""Frame quality: ordered rejection reasons, checks and completeness audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayframe import constants as K
from wayframe.operators.futures import EPISODE
from wayframe.plans.segments import dealt

REASONS = ("future_missing", "stationary", "behind", "jump", "written")


def has_full_horizon(n: int = K.FUTURE_STEPS) -> Column:
    return F.coalesce(F.size("futures") == n, F.lit(False))


def require_full_horizon(df: DataFrame, n: int = K.FUTURE_STEPS) -> DataFrame:
    return df.where(has_full_horizon(n))


def stationary_flag() -> Column:
    return (
        (F.col("max_step") < K.STATIONARY_STEP_M)
        & (F.col("displacement") < K.STATIONARY_SHIFT_M)
        & (F.col("max_speed") < K.STATIONARY_SPEED_MPS)
    )


def is_behind() -> Column:
    return F.col("max_forward") < K.BEHIND_M


def is_jump() -> Column:
    return F.col("max_step") > K.JUMP_M


def drop_behind(df: DataFrame) -> DataFrame:
    return df.where(~is_behind())


def drop_jump(df: DataFrame) -> DataFrame:
    return df.where(~is_jump())


def rejection_reason(df: DataFrame, n: int = K.FUTURE_STEPS) -> DataFrame:
    """Add ``reason``, the first of :data:`REASONS` that applies.

    Uses ``keep`` (see :func:`wayframe.operators.gates.thin_stationary`) if the
    table has it; otherwise every stationary frame is rejected.
    """
    standing = ~F.coalesce(F.col("keep"), F.lit(True)) if "keep" in df.columns else stationary_flag()
    return df.withColumn(
        "reason",
        F.when(~has_full_horizon(n), "future_missing")
        .when(standing, "stationary")
        .when(is_behind(), "behind")
        .when(is_jump(), "jump")
        .otherwise("written"),
    )


def episode_report(df: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Per episode: frames by reason, and speed, command and standstill figures of the written ones."""
    written = F.col("reason") == "written"
    kept_standing = F.count_if(F.col("stationary") & F.col("keep"))
    standing = F.count_if(F.col("reason") == "stationary") + kept_standing
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS],
        kept_standing.alias("kept_stationary"),
        (kept_standing / F.greatest(standing, F.lit(1))).alias("stationary_ratio"),
        (F.coalesce(F.sum(F.when(written, F.col("speed_mps"))), F.lit(0.0)) / F.greatest(F.count_if(written), F.lit(1))).alias(
            "mean_speed"
        ),
        *[F.count_if(written & (F.col("command") == c)).alias(f"command_{c}") for c in K.COMMANDS.values()],
        F.count_if(written & F.col("command_disagrees")).alias("command_disagree"),
        F.count_if(F.col("limit_is_default")).alias("speed_limit_fallback"),
    )


def check_fields(df: DataFrame, mode: str = "bc") -> DataFrame:
    """One row per required field that is absent, or null somewhere (with the number of nulls)."""
    if mode not in ("bc", "rl"):
        raise ValueError("mode is 'bc' or 'rl'")
    wanted = [*K.BC_FIELDS, *(K.RL_FIELDS if mode == "rl" else ())]
    present = [f for f in wanted if f in df.columns]
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in present] or [F.count(F.lit(1)).alias("_none")])
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit("null" if f in present else "absent").alias("problem"),
                (F.col(f) if f in present else F.lit(0)).cast("bigint").alias("rows"),
            )
            for f in wanted
        ]
    )
    return counts.select(F.inline(rows)).where("problem = 'absent' OR rows > 0")


def check_object_width(df: DataFrame, column: str = "objects", width: int = K.OBJECT_WIDTH) -> DataFrame:
    """Rows holding an object whose feature count is not ``width``, null objects included."""
    return df.where(F.exists(column, lambda o: o.isNull() | (F.size(o) != width)))


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def check_finite(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Positions of NaN and infinite values: (key, field, 0-based position in the flattened value)."""
    found = []
    for c in columns:
        kind = df.schema[c].dataType
        depth = 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        flat = F.col(c) if depth else F.array(c)
        for _ in range(depth - 1):
            flat = F.flatten(flat)
        bad = F.filter(
            F.transform(flat, lambda v, i: F.struct(F.lit(c).alias("field"), i.alias("position"), _not_finite(v).alias("bad"))),
            lambda s: s["bad"],
        )
        found.append(bad)
    return (
        df.select(key, F.explode(F.concat(*found)).alias("b"))
        .select(key, F.col("b.field").alias("field"), F.col("b.position").alias("position"))
    )


# --- fixed values: range rules ---
DEFAULT_RULES = {"max_speed_mps": 50.0, "max_abs_accel_mps2": 12.0, "min_route_cov": 0.6}


def check_ranges(df: DataFrame, rules: Mapping[str, float] = DEFAULT_RULES, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of rows outside the configured ranges (speed, acceleration, share of filled route points)."""
    fast = F.count_if(F.col("speed_mps") > rules["max_speed_mps"]).alias("too_fast")
    accel = F.greatest(F.abs("accel_long"), F.abs("accel_lat")) > rules["max_abs_accel_mps2"]
    aggs = [F.count(F.lit(1)).alias("rows"), fast, F.count_if(accel).alias("too_hard")]
    if "route_cov" in df.columns:
        aggs.append(F.count_if(F.col("route_cov") < rules["min_route_cov"]).alias("short_route"))
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def audit_completeness(
    frames: DataFrame, rasters: DataFrame, futures: DataFrame, actors: DataFrame, tokens: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Frames without a raster or futures, and actors without a token: (keys, actor_id, problem)."""
    keys = list(keys)
    none = F.lit(None).cast("bigint").alias("actor_id")

    def lacking(other: DataFrame, name: str) -> DataFrame:
        return frames.select(*keys).join(other.select(*keys), keys, "left_anti").select(*keys, none, F.lit(name).alias("problem"))

    # Placed by a stated number of tasks, as adaptive execution would merge millions of narrow rows into one task that sorts them.
    seen = dealt(actors.select(*keys, "actor_id"), [*keys, "actor_id"], actors.count())
    bare = seen.join(tokens.select(*keys, "actor_id"), [*keys, "actor_id"], "left_anti")
    return (
        lacking(rasters, "no_raster")
        .unionByName(lacking(futures, "no_futures"))
        .unionByName(bare.select(*keys, F.col("actor_id").cast("bigint").alias("actor_id"), F.lit("no_token").alias("problem")))
    )
