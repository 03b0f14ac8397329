"""Splits, shuffles, batches and augmentation; all draws come from hashed keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe import constants as K
from wayframe.functions import hashing as H
from wayframe.functions.normalise import clamp
from wayframe.plans.ranges import number_rows
from wayframe.plans.segments import dense_index


def split_by_shard(df: DataFrame, part: str, ratio: float = 0.2, shard: str = "shard_idx") -> DataFrame:
    """The rows of the training or validation shards.

    Shards are taken in order: the first ``trunc(n * (1 - ratio))``, at least
    one, train; the rest validate.  No samples at all are an error, and so is an empty part when its rows are read.
    """
    if part not in ("train", "val", "all"):
        raise ValueError("part is 'train', 'val' or 'all'")
    shards = number_rows(df.select(shard).distinct(), [shard], "_at")
    if shards.isEmpty():
        raise ValueError(f"part {part!r} holds no samples")
    if part == "all":
        return df
    n = F.count(F.lit(1))
    cut = F.greatest(F.floor(n * (1 - ratio)), F.lit(1))
    error = F.raise_error(F.lit(f"part {part!r} holds no samples")).cast("bigint")
    end = shards.agg(F.when(cut >= n, error).otherwise(cut) if part == "val" else cut).scalar()
    mine = F.col("_at") >= end if part == "val" else F.col("_at") < end
    return df.join(shards.where(mine).select(shard), shard, "left_semi")


def shuffle_keys(df: DataFrame, seed: int, shard: str = "shard_idx", sample: str = "sample_idx") -> DataFrame:
    """Add the sort keys of a shuffle: shards in hashed order, samples in hashed order inside each."""
    return df.withColumn("_shard_key", H.hash_int(shard, seed)).withColumn("_sample_key", H.hash_int(sample, seed + 1))


def shuffle(df: DataFrame, seed: int, shard: str = "shard_idx", sample: str = "sample_idx") -> DataFrame:
    """Rows in shuffled order (a distributed sort on hashed keys)."""
    keyed = shuffle_keys(df, seed, shard, sample)
    return keyed.orderBy("_shard_key", shard, "_sample_key", sample).drop("_shard_key", "_sample_key")


def shuffle_rank(df: DataFrame, seed: int, shard: str = "shard_idx", sample: str = "sample_idx") -> DataFrame:
    """Add ``position``, the row's place in the shuffled order.

    Segments are ranges of the hashed shard key: at most 65 536 of them, all
    about equally filled.
    """
    keyed = shuffle_keys(df, seed, shard, sample)
    out = dense_index(keyed, [], ["_shard_key", shard, "_sample_key", sample], "position", width=H.MODULUS // 65_536)
    return out.drop("_shard_key", "_sample_key")


def batches(df: DataFrame, size: int, position: str = "position", fields: Sequence[str] = ("sample_idx",)) -> DataFrame:
    """Full batches of ``size`` rows in order: one array per field; an incomplete last batch is dropped."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    rows = F.sort_array(F.collect_list(F.struct(position, *fields)))
    b = df.groupBy(F.expr(f"`{position}` div {int(size)}").alias("batch")).agg(rows.alias("_r"))
    full = b.where(F.size("_r") == size)


    def column(name: str) -> Column:
        return F.transform("_r", lambda r: r[name]).alias(name)

    return full.select("batch", *[column(f) for f in fields])


def sample_indices(df: DataFrame, n: int, seed: int = 42, key: str = "sample_idx") -> DataFrame:
    """``n`` keys drawn without replacement."""
    return df.select(key).withColumn("_h", H.hash_int(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def head_n(df: DataFrame, n: int, index: str = "sample_idx") -> DataFrame:
    """The first ``n`` samples in file order."""
    return df.where(F.col(index) < n)


# --- fixed values: default augmentation settings ---
AUGMENT = {
    "p_drop_bev": 0.05,
    "p_drop_objects": 0.05,
    "p_ego_noise": 0.1,
    "ego_noise_scale": 0.02,
    "p_speed_scale": 0.2,
    "speed_scale_lo": 0.8,
    "speed_scale_hi": 1.2,
    "p_trajectory_noise": 0.3,
    "trajectory_noise_std": 0.02,
    "p_lateral_shift": 0.2,
    "max_lateral_shift": 0.05,
}

# Each kind of draw has its own seed offset, so that the choices are independent.
_DRAW = {
    "bev": 0, "objects": 1, "ego": 2, "ego_value": 10, "speed": 3, "speed_value": 4, "path": 5, "path_value": 20,
    "shift": 6, "shift_value": 7,
}


def _hit(key: Column, seed: int, what: str, p: float) -> Column:
    return H.uniform(key, seed + _DRAW[what]) < p


def augment(df: DataFrame, seed: int, settings: Mapping[str, float] | None = None, key: str = "sample_idx") -> DataFrame:
    """Per-sample augmentation of normalised samples; every step has its own probability.

    Works on whichever of ``bev_cells``, ``objects``, ``object_mask``,
    ``ego_vec``, ``future_v``, ``future_xy`` and ``route`` are present.  The
    lateral shift moves route and future one way and objects the other, as the
    sample format has it.
    """
    c = {**AUGMENT, **(settings or {})}
    k = F.col(key)
    has = set(df.columns)
    out = df

    def put(name: str, new: Column) -> None:
        nonlocal out
        if name in has:
            out = out.withColumn(name, new)

    def map2(rows: str, at: int, f) -> Column:
        return F.transform(rows, lambda p: F.transform(p, lambda v, i: F.when(i == at, f(v)).otherwise(v)))

    if "bev_cells" in has:
        put("bev_cells", F.when(_hit(k, seed, "bev", c["p_drop_bev"]), F.slice("bev_cells", 1, 0)).otherwise(F.col("bev_cells")))
    drop = _hit(k, seed, "objects", c["p_drop_objects"])
    if "objects" in has:
        put("objects", F.when(drop, F.transform("objects", lambda o: F.transform(o, lambda v: v * 0.0))).otherwise(F.col("objects")))
    if "object_mask" in has:
        put("object_mask", F.when(drop, F.transform("object_mask", lambda v: v * 0.0)).otherwise(F.col("object_mask")))
    if "ego_vec" in has:
        # One draw per element: the element number goes into the key.
        noise = F.transform(
            "ego_vec",
            lambda v, i: clamp(v + H.normal([k, i], seed + _DRAW["ego_value"]) * c["ego_noise_scale"], -1.0, 1.0),
        )
        put("ego_vec", F.when(_hit(k, seed, "ego", c["p_ego_noise"]), noise).otherwise(F.col("ego_vec")))
    faster = _hit(k, seed, "speed", c["p_speed_scale"])
    factor = H.uniform_range(k, seed + _DRAW["speed_value"], c["speed_scale_lo"], c["speed_scale_hi"])
    if "future_v" in has:
        put("future_v", F.when(faster, F.transform("future_v", lambda v: clamp(v * factor, 0.0, 1.0))).otherwise(F.col("future_v")))
    if "ego_vec" in has:
        scaled = F.transform("ego_vec", lambda v, i: F.when(i == 0, clamp(v * factor, 0.0, 1.0)).otherwise(v))
        put("ego_vec", F.when(faster, scaled).otherwise(F.col("ego_vec")))
    shifted = _hit(k, seed, "shift", c["p_lateral_shift"])
    shift = H.uniform_range(k, seed + _DRAW["shift_value"], -c["max_lateral_shift"], c["max_lateral_shift"])
    if "future_xy" in has:
        noise = F.transform(
            "future_xy",
            lambda p, i: F.transform(
                p,
                lambda v, j: clamp(
                    v + H.normal([k, i, j], seed + _DRAW["path_value"]) * c["trajectory_noise_std"], -1.0, 1.0
                ),
            ),
        )
        put("future_xy", F.when(_hit(k, seed, "path", c["p_trajectory_noise"]), noise).otherwise(F.col("future_xy")))
    for name, at, sign in (("route", 1, 1.0), ("future_xy", 1, 1.0), ("objects", 2, -1.0)):
        if name in has:
            moved = map2(name, at, lambda v, sign=sign: clamp(v + shift * sign, -1.0, 1.0))
            put(name, F.when(shifted, moved).otherwise(F.col(name)))
    return out


def rotation(df: DataFrame, seed: int, p: float, max_deg: float = 20.0, key: str = "sample_idx") -> DataFrame:
    """Add ``angle``: a random rotation in radians, 0 for the samples left alone."""
    k = F.col(key)
    deg = (H.uniform(k, seed + 1) * 2.0 - 1.0) * max_deg
    return df.withColumn("angle", F.when(H.uniform(k, seed) < p, F.radians(deg)).otherwise(0.0))


def rotate_samples(df: DataFrame, angle: str = "angle") -> DataFrame:
    """Rotate route, futures and objects (position, velocity, heading) by the angle."""
    c, s = F.cos(angle), F.sin(angle)
    out = df.withColumn("_c", c).withColumn("_s", s)
    c, s = F.col("_c"), F.col("_s")

    def turn(p: Column) -> Column:
        return F.array(p[0] * c - p[1] * s, p[0] * s + p[1] * c)

    for name in ("route", "future_xy"):
        if name in df.columns:
            out = out.withColumn(name, F.transform(name, turn))
    if "objects" in df.columns:

        def feature(o: Column, i: int) -> Column:
            if i in (1, 7):
                return o[i] * c - o[i + 1] * s
            if i in (2, 8):
                return o[i - 1] * s + o[i] * c
            if i == 3:
                return o[3] * c + o[4] * s
            if i == 4:
                return o[4] * c - o[3] * s
            return o[i]

        out = out.withColumn("objects", F.transform("objects", lambda o: F.array(*[feature(o, i) for i in range(K.OBJECT_WIDTH)])))
    return out.drop("_c", "_s")


def raster_dropout(
    cells: DataFrame,
    height: int,
    width: int,
    seed: int,
    p_cutout: float = 0.2,
    size_range: tuple[int, int] = (10, 30),
    p_channel: float = 0.1,
    key: str = "sample_idx",
) -> DataFrame:
    """Blank a random rectangle and a random channel of some samples' sparse grids (cells are dropped)."""
    k = F.col(key)
    lo, hi = size_range
    rh, rw = H.uniform_int(k, seed + 1, lo, hi), H.uniform_int(k, seed + 2, lo, hi)
    x0, y0 = H.uniform_int(k, seed + 3, 0, F.lit(width) - rw), H.uniform_int(k, seed + 4, 0, F.lit(height) - rh)
    fits = (F.lit(width) > rw) & (F.lit(height) > rh)
    cut = (
        (H.uniform(k, seed) < p_cutout)
        & fits
        & F.col("col").between(x0, x0 + rw - 1)
        & F.col("row").between(y0, y0 + rh - 1)
    )
    gone = (H.uniform(k, seed + 5) < p_channel) & (F.col("channel") == H.uniform_int(k, seed + 6, 0, K.RASTER_CHANNELS - 1))
    return cells.where(~(cut | gone))


# --- fixed values: default control noise ---
CONTROL_NOISE = {"probability": 0.2, "steer_std": 0.1, "throttle_std": 0.05, "brake_std": 0.05}


def inject_noise(
    df: DataFrame, seed: int, settings: Mapping[str, float] | None = None, key: Sequence[str] = ("run_id", "episode_ord", "frame_id")
) -> DataFrame:
    """Perturb steer, throttle and brake of some ticks and flag them; ``key`` is the whole key of a tick."""
    c = {**CONTROL_NOISE, **(settings or {})}
    k = [F.col(x) for x in key]
    hit = H.uniform(k, seed) < c["probability"]

    def noisy(name: str, draw: int, std: float, lo: float) -> Column:
        moved = clamp(F.col(name) + H.normal(k, seed + draw) * std, lo, 1.0)
        return F.when(hit, moved).otherwise(F.col(name)).alias(name)

    changed = {
        "steer_norm": noisy("steer_norm", 10, c["steer_std"], -1.0),
        "throttle": noisy("throttle", 20, c["throttle_std"], 0.0),
        "brake": noisy("brake", 30, c["brake_std"], 0.0),
    }
    return df.select(*[changed.get(n, F.col(n)) for n in df.columns], hit.alias("noise_injected"))
