"""Dataset audits, evaluation metrics and summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayframe import constants as K
from wayframe.functions.geometry import command_label
from wayframe.plans.segments import WIDTH, Running, scan


def _depth(kind: T.DataType) -> int:
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    return depth


def _flat(df: DataFrame, name: str) -> Column:
    """A column's numbers as one flat array."""
    depth = _depth(df.schema[name].dataType)
    c = F.col(name) if depth else F.array(name)
    for _ in range(depth - 1):
        c = F.flatten(F.filter(c, lambda inner: inner.isNotNull()))
    numbers = F.filter(F.transform(c, lambda v: v.cast("double")), lambda v: v.isNotNull())
    return F.coalesce(numbers, F.array().cast("array<double>"))


def _shape(df: DataFrame, name: str) -> Column:
    """A row's extent in each dimension; null if the arrays inside differ in length, or are null."""
    depth = _depth(df.schema[name].dataType)

    def extents(c: Column, left: int) -> Column:
        here = F.array(F.when(c.isNotNull(), F.size(c)).cast("bigint"))
        if left == 1:
            return here
        inner = F.array_distinct(F.transform(c, lambda x: extents(x, left - 1)))
        return F.concat(here, F.when(F.size(inner) <= 1, F.coalesce(F.get(inner, F.lit(0)), F.array(*[F.lit(0).cast("bigint")] * (left - 1)))))

    if not depth:
        return F.array().cast("array<bigint>")
    e = extents(F.col(name), depth)
    return F.when(~F.exists(e, lambda x: x.isNull()), e)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _moments(xs: Column) -> Column:
    """An array's count, least, greatest, mean and sum of squares about the mean, in its row."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    n = F.size(xs)

    def about(mean: Column) -> Column:
        m2 = total(F.transform(xs, lambda x: (x - mean) * (x - mean)))
        return F.struct(n.alias("n"), F.array_min(xs).alias("lo"), F.array_max(xs).alias("hi"), mean.alias("mean"), m2.alias("m2"))

    return _let(F.when(n > 0, total(xs) / n), about)


def tensor_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per field: count, minimum, maximum, mean and sample deviation of all its numbers, and its ``shape``.

    Null numbers don't count.  ``shape`` is the number of rows and the extent of each further dimension; null if rows differ
    in shape or are null.  Each array is folded to its moments in its own row.  Rows are merged by the number of
    values that they hold, so that they weigh alike, and the few sums of different numbers are merged pairwise (Chan, Golub and
    LeVeque); nothing cancels, and no row is multiplied by its numbers.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("field"), _moments(_flat(df, c)).alias("m"), _shape(df, c).alias("shape")) for c in columns])
    x = df.select(F.inline(parts)).select("field", "m.*", "shape")
    by = x.groupBy("field", "n", "shape").agg(
        F.count(F.lit(1)).alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("mean").alias("mean"), F.var_pop("mean").alias("spread"), F.sum("m2").alias("m2")
    )
    # n values in each of the rows: their means spread by n * rows * var_pop(mean)
    count = (F.col("n") * F.col("rows")).cast("double")
    by = by.select("field", "rows", "shape", "lo", "hi", F.struct(count.alias("n"), "mean", (F.col("m2") + count * F.col("spread")).alias("m2")).alias("m"))

    def merge(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    out = by.groupBy("field").agg(
        F.aggregate(F.sort_array(F.collect_list("m")), none, merge).alias("m"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sum("rows").alias("rows"), F.count_distinct("shape").alias("shapes"), F.count_if(F.col("shape").isNull()).alias("odd"), F.first("shape", ignorenulls=True).alias("shape"),
    )
    n = F.col("m.n")
    return out.select(
        "field", n.cast("bigint").alias("n"), "min", "max", F.when(n > 0, F.col("m.mean")).alias("mean"), F.when(n > 1, F.sqrt(F.col("m.m2") / (n - 1))).alias("std"),
        F.when((F.col("shapes") == 1) & (F.col("odd") == 0), F.concat(F.array("rows"), F.col("shape"))).alias("shape"),
    )


def _bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin number; the top edge belongs to the last bin, values outside to none."""
    at = F.floor((x - lo) * n / (hi - lo)).cast("int")
    return F.when((x >= lo) & (x <= hi), F.when(hi > lo, F.least(F.lit(n - 1), at)).otherwise(0))


def _binned(df: DataFrame, value: Column, lo: Column, hi: Column, n: int) -> DataFrame:
    """Counts per bin; empty bins get 0, and the share is of all rows."""
    counts = df.groupBy(_bin(value, lo, hi, n).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    counts = counts.withColumn("_all", total).where("bin IS NOT NULL")
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    j = bins.join(counts, "bin", "left")
    share = F.coalesce(F.col("count") * 100.0 / F.col("_all"), F.lit(0.0))
    return j.select(
        "bin",
        (lo + (hi - lo) * F.col("bin") / n).alias("from"),
        (lo + (hi - lo) * (F.col("bin") + 1) / n).alias("to"),
        F.coalesce("count", F.lit(0)).alias("count"),
        share.alias("percent"),
    )


def histogram(df: DataFrame, value: Column | str, lo: float, hi: float, n: int = 10) -> DataFrame:
    """Histogram over a fixed range, empty bins included."""
    v = F.col(value) if isinstance(value, str) else value
    return _binned(df, v, F.lit(float(lo)), F.lit(float(hi)), n)


def reward_histogram(df: DataFrame, value: str = "reward_clipped", n: int = 20) -> DataFrame:
    """Histogram over the data's own range; all filled bins."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return _binned(df, F.col(value), lo, hi, n).where("count > 0")


def _selected(df: DataFrame, value: str, **aggregates: Column) -> DataFrame:
    """One row: ``n``, the two middle values ``lower`` and ``upper``, and the aggregates, in two passes.

    The first pass takes the aggregates and brackets the middle by a quantile sketch; its one row is joined once.  The second
    counts the values of the bracket, with all rows below it as one more, lowest value.  Counts are added up in
    parts of the bracket.  No task sorts or holds the whole column.
    """
    first = df.withColumn("_v", F.col(value).cast("double"))
    first = first.agg(F.percentile_approx("_v", [0.4995, 0.5005], 10_000).alias("_q"), F.count("_v").alias("n"), *[a.alias(k) for k, a in aggregates.items()])
    first = first.select(F.struct("n", *aggregates).alias("_all"), F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    v = F.col("_v")
    # One row without a value keeps the result's row where the column has none.
    values = df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").union(df.sparkSession.range(1).select(F.lit(None).cast("double")))
    met = values.select("_v", v.isNotNull().cast("int").alias("_is")).join(F.broadcast(first), v.isNull() | (v <= F.col("_hi")))
    inside = v >= F.col("_lo")
    span = F.col("_hi") - F.col("_lo")
    part = F.when(~inside, -1).when(span > 0, F.floor((v - F.col("_lo")) / span * 65_535)).otherwise(0).cast("bigint")
    counted = met.groupBy("_all", part.alias("_b"), F.when(inside, v).alias("_v")).agg(F.sum("_is").alias("_n"))
    upto = scan(counted, [], ["_b", "_v"], 1, _upto=Running("sum", F.col("_n")))
    n = F.col("_all.n")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    out = upto.groupBy("_all").agg(at(F.floor((n + 1) / 2)).alias("lower"), at(F.floor(n / 2) + 1).alias("upper"))
    return out.select("_all.*", "lower", "upper")


def middle_values(df: DataFrame, value: str) -> DataFrame:
    """Exact middle of a column of any size: one row ``n, lower, upper``.

    ``lower`` and ``upper`` are the two middle values (equal for an odd count, null for an empty column); nulls don't count.
    """
    return _selected(df, value).select("n", "lower", "upper")


def distribution(df: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """Minimum, maximum, mean, sample deviation, lower median and mean size, plain and in physical units."""
    c = F.col(value)
    stats = _selected(df, value, min=F.min(c), max=F.max(c), mean=F.avg(c), std=F.stddev_samp(c), abs_mean=F.avg(F.abs(c)))
    names = ["min", "max", "mean", "std", "median", "abs_mean"]
    stats = stats.withColumnRenamed("lower", "median")
    return stats.select(*names, *[(F.col(c) * scale).alias(f"{c}_physical") for c in names])


def command_distribution(df: DataFrame, value: Column) -> DataFrame:
    """Counts of the commands decoded from their normalised form."""
    code = F.rint(value * K.COMMAND_SCALE).cast("int")
    c = df.groupBy(code.alias("command")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    return c.select("command", command_label("command").alias("label"), "count", (F.col("count") * 100.0 / total).alias("percent"))


def reward_report(df: DataFrame) -> DataFrame:
    """Reward components (mean, deviation, sum, events) and the shares of noisy and terminal rows."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in ("progress", "collision", "offroad", "violation", "comfort"):
        x = F.col(f"reward_{c}")
        aggs += [
            F.avg(x).alias(f"{c}_mean"),
            F.stddev_samp(x).alias(f"{c}_std"),
            F.sum(x).alias(f"{c}_sum"),
            F.count_if(x != 0).alias(f"{c}_events"),
        ]
    for flag, name in (("noise_injected", "noise"), ("done", "done")):
        if flag in df.columns:
            aggs += [F.count_if(F.col(flag)).alias(f"{name}_rows"), (F.count_if(F.col(flag)) * 100.0 / F.count(F.lit(1))).alias(f"{name}_percent")]
    return df.agg(*aggs)


# --- fixed values: diversity thresholds ---
DIVERSITY = {"min_speed_std": 2.0, "min_steer_std": 0.1, "min_moving_ratio": 0.7, "max_stationary_ratio": 0.25, "min_samples": 100}


def diversity_report(
    df: DataFrame,
    speed: Column,
    steer: Column,
    rules: Mapping[str, float] | None = None,
) -> DataFrame:
    """Spread of speed and steering, share of moving samples, and which thresholds fail.

    ``speed`` is in m/s.  Issues are shown for any number of samples; ``few_samples``
    says whether there are fewer than the rules ask for.
    """
    r = {**DIVERSITY, **(rules or {})}
    s = df.select(speed.cast("double").alias("_v"), steer.cast("double").alias("_s")).agg(
        F.count(F.lit(1)).alias("samples_checked"),
        F.avg("_v").alias("speed_mean"),
        F.stddev_pop("_v").alias("speed_std"),
        F.stddev_pop("_s").alias("steer_std"),
        (F.count_if(F.col("_v") > 0.5) / F.count(F.lit(1))).alias("moving_ratio"),
    ).withColumn("stationary_ratio", 1.0 - F.col("moving_ratio"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("speed_std") < r["min_speed_std"], F.lit("speed_std")),
            F.when(F.col("steer_std") < r["min_steer_std"], F.lit("steer_std")),
            F.when(F.col("moving_ratio") < r["min_moving_ratio"], F.lit("moving_ratio")),
            F.when(F.col("stationary_ratio") > r["max_stationary_ratio"], F.lit("stationary_ratio")),
        )
    )
    out = s.withColumn("issues", issues).withColumn("few_samples", F.col("samples_checked") < r["min_samples"])
    return out.withColumn("status", F.when(F.size("issues") > 0, "warning").otherwise("ok"))


def require_diversity(report: DataFrame) -> DataFrame:
    """The report, or an error when it is evaluated and has issues."""
    bad = F.concat(F.lit("data diversity check failed: "), F.array_join("issues", ", "))
    return report.withColumn("status", F.when(F.size("issues") > 0, F.raise_error(bad)).otherwise(F.col("status")))


def label_sanity(df: DataFrame, xy: str = "future_xy", v: str = "future_v", min_speed_std: float = 0.1, min_xy_std: float = 0.5) -> DataFrame:
    """Deviation of normalised future speeds and positions in physical units, and whether they vary enough."""
    s = tensor_stats(df, [v, xy])
    std = lambda f, k: F.max(F.when(F.col("field") == f, F.col("std"))) * k
    out = s.agg(std(v, K.SPEED_SCALE).alias("speed_std"), std(xy, K.SPATIAL_SCALE).alias("xy_std"))
    return out.withColumn("speed_ok", F.col("speed_std") >= min_speed_std).withColumn("xy_ok", F.col("xy_std") >= min_xy_std)


def speed_limit_table(df: DataFrame, limit: str) -> DataFrame:
    """How often each speed limit occurs."""
    return df.groupBy(F.col(limit).alias("limit_kmh")).agg(F.count(F.lit(1)).alias("count"))


def speed_limit_report(df: DataFrame, limit: str) -> DataFrame:
    """Extremes, mean and median (mean of the two middle values) of the limits in km/h and m/s."""
    c = F.col(limit)
    s = _selected(df, limit, min=F.min(c), max=F.max(c), mean=F.avg(c)).withColumn("median", (F.col("lower") + F.col("upper")) / 2.0)
    names = ["min", "max", "mean", "median"]
    return s.select("n", *[F.col(c).alias(f"{c}_kmh") for c in names], *[(F.col(c) / 3.6).alias(f"{c}_mps") for c in names])


def episode_evaluation(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per episode from its step log: completion, collision, infractions, mean speed.

    Reads ``speed_mps``, ``collision_events`` (new events at the step) and ``reached``.
    """
    return steps.groupBy(*keys).agg(
        F.max(F.col("reached").cast("double")).alias("completion"),
        F.when(F.sum("collision_events") >= 1, 1.0).otherwise(0.0).alias("collision"),
        F.sum("collision_events").alias("infractions"),
        (F.sum("speed_mps") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("mean_speed"),
        F.max(F.col("reached").cast("double")).alias("success"),
    )


def evaluation_report(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted means of the episode figures."""
    e = episode_evaluation(steps, keys)
    return e.agg(
        F.avg("completion").alias("route_completion_rate"),
        F.avg("collision").alias("collision_rate"),
        F.avg("infractions").alias("infraction_count"),
        F.avg("mean_speed").alias("avg_speed"),
        F.avg("success").alias("success_rate"),
        F.count(F.lit(1)).alias("episodes_run"),
    )


def accuracy(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """Share of rows whose first largest logit is at the target's position."""
    best = F.array_position(logits, F.array_max(logits)) - 1
    hit = F.count_if(best == F.col(target))
    n = F.count(F.lit(1))
    return df.agg(hit.alias("correct"), n.alias("total"), (hit / F.greatest(F.lit(1), n)).alias("accuracy"))


def nll_mean(df: DataFrame, log_prob: Column) -> DataFrame:
    n = F.count(log_prob)
    return df.agg(n.alias("n"), (F.coalesce(F.sum(-log_prob), F.lit(0.0)) / F.greatest(F.lit(1), n)).alias("nll_mean"))


def trajectory_loss(
    df: DataFrame,
    decay: float = 0.0,
    waypoint_weight: float = 1.0,
    speed_weight: float = 1.0,
    batch: str = "batch",
) -> DataFrame:
    """Masked, horizon-weighted trajectory loss in physical units, per batch.

    Reads ``pred_xy``, ``pred_v``, ``future_xy``, ``future_v`` (normalised) and
    ``future_mask``.  A batch without any valid future is an error.
    """

    def weighted(f) -> Column:
        parts = F.transform("future_mask", lambda m, i: m * F.exp(F.lit(-float(decay)) * (i + 1)) * f(i))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    def square(i: Column) -> Column:
        p, t = F.get("pred_xy", i), F.get("future_xy", i)
        dx, dy = (p[0] - t[0]) * K.SPATIAL_SCALE, (p[1] - t[1]) * K.SPATIAL_SCALE
        return dx * dx + dy * dy

    def huber(i: Column) -> Column:
        d = F.abs(F.get("pred_v", i) - F.get("future_v", i)) * K.SPEED_SCALE
        return F.when(d < 1.0, d * d * 0.5).otherwise(d - 0.5)

    per = df.select(
        batch,
        weighted(lambda i: F.lit(1.0)).alias("_w"),
        weighted(square).alias("_xy"),
        weighted(huber).alias("_v"),
    )
    g = per.groupBy(batch).agg(
        F.count(F.lit(1)).alias("batch_size"), F.sum("_w").alias("_w"), F.sum("_xy").alias("_xy"), F.sum("_v").alias("_v")
    )
    w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.raise_error(F.lit("future_mask has no valid entries")).cast("double"))
    g = g.select(
        batch, "batch_size", (F.col("_xy") / (w + 1e-8)).alias("loss_waypoint"), (F.col("_v") / (w + 1e-8)).alias("loss_speed")
    )
    return g.withColumn("loss", F.col("loss_waypoint") * waypoint_weight + F.col("loss_speed") * speed_weight)


def mean_trajectory_loss(losses: DataFrame) -> DataFrame:
    """Batch losses averaged by batch size."""
    n = F.greatest(F.lit(1), F.sum("batch_size"))
    return losses.agg(
        *[(F.sum(F.col(c) * F.col("batch_size")) / n).alias(c) for c in ("loss", "loss_waypoint", "loss_speed")],
        F.sum("batch_size").alias("samples"),
    )


def top_k(df: DataFrame, k: int, objective: str = "objective", maximize: bool = True, order: str = "id") -> DataFrame:
    """The k best rows; equal objectives stay in ``order``."""
    by = F.col(objective).desc() if maximize else F.col(objective).asc()
    return df.orderBy(by, order).limit(k)


def _entries(x, at, epoch, before: float | None, patience: int, min_delta: float) -> dict[str, list]:
    """What a segment of records (falling scores ``x``) does to any accepted best it is entered with.

    The first record that beats the best by more than ``min_delta`` is the entry; what follows depends on it alone.  So each
    entry has its outcome: the last record accepted in the segment, or where training stops inside.  The best is at most
    ``min_delta`` above the least score before the segment (``before``), so only the records down to the first one that
    beats that least by ``min_delta`` can be entries.
    """
    import numpy as np

    n = len(x)
    # Scores fall, so the next one accepted after i is where they first go below x[i] - min_delta.
    after = np.searchsorted(-x, -(x - min_delta), side="right")
    last, stop = np.arange(n), np.full(n, -1)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            if at[j] - at[i] > patience:
                stop[i] = at[i] + patience
            else:
                last[i], stop[i] = last[j], stop[j]
    beats = np.arange(1) if before is None else np.flatnonzero(x < before - min_delta)  # no score before: the first record is accepted
    k = int(beats[0]) + 1 if len(beats) else n
    data = {"_entry_x": x[:k], "_entry_at": at[:k], "_last_x": x[last[:k]], "_last_at": at[last[:k]], "_last_e": epoch[last[:k]], "_stop": stop[:k]}
    return {c: v.tolist() for c, v in data.items()}


def early_stop(
    df: DataFrame,
    patience: int,
    min_delta: float = 1e-4,
    maximize: bool = False,
    run: str = "run",
    epoch: str = "epoch",
    score: str = "score",
    width: int = WIDTH,
) -> DataFrame:
    """Per run: the epoch at which training would stop (null if it never does) and the best one until then.

    An epoch improves if it beats the last accepted best by more than
    ``min_delta``; training stops after ``patience`` epochs in a row without
    improvement.  The first epoch is accepted.

    An accepted epoch is always better than all before it, so a segmented scan drops all but those records.  Records
    are cut into segments of ``width`` epochs, and each is summarised on its own: what it does to the best it is entered
    with.  A run's summaries are then followed in order, in a stream that carries three numbers: the best, the epoch that set it
    and where training stopped.  No task holds a run, even one in which every epoch is a record.
    """
    sign = -1.0 if maximize else 1.0
    base = df.select(run, epoch, (F.col(score) * sign).cast("double").alias("_x"))
    one = F.lit(1).cast("bigint")
    seen = scan(
        base, [run], epoch, width,
        _at=Running("sum", one, "before"), _best=Running("min", F.col("_x"), "before"), _n=Running("sum", one, "all"),
    )
    rec = seen.where(F.col("_x").isNotNull() & (F.col("_best").isNull() | (F.col("_x") < F.col("_best"))))
    rec = rec.select(run, F.expr(f"_at div {int(width)}").alias("_seg"), "_at", "_x", F.col(epoch).cast("bigint").alias("_e"), "_best", "_n")
    kind = dict(df.dtypes)[run]
    lists = "_entry_x array<double>, _entry_at array<bigint>, _last_x array<double>, _last_at array<bigint>, _last_e array<bigint>, _stop array<bigint>"

    def summarise(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list[dict] = []

        def summary() -> dict:
            x, at, e = (np.array([r[c] for r in held]) for c in ("_x", "_at", "_e"))
            first = held[0]
            return {run: first[run], "_seg": first["_seg"], "_n": first["_n"], **_entries(x, at, e, first["_best"], patience, min_delta)}

        kinds = [("_seg", pa.int64()), ("_n", pa.int64()), ("_entry_x", pa.list_(pa.float64())), ("_entry_at", pa.list_(pa.int64())), ("_last_x", pa.list_(pa.float64()))]
        kinds += [(c, pa.list_(pa.int64())) for c in ("_last_at", "_last_e", "_stop")]
        for b in batches:
            schema, done = pa.schema([(run, b.schema.field(run).type), *kinds]), []
            for r in b.to_pylist():
                if held and (held[0]["_seg"] != r["_seg"] or held[0][run] != r[run]):
                    done.append(summary())
                    held = []
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([summary()], schema=schema)

    def follow(batches: Iterator) -> Iterator:
        import bisect

        import pyarrow as pa

        names = [run, "_n", "stop_at", "best_epoch", "best_score"]
        key, state, size = None, None, 0

        def end() -> tuple:
            best, at, e, stop = state
            return (key, size, stop if stop >= 0 else (at + patience if at + patience <= size - 1 else None), e, best * sign)

        for b in batches:
            done = []
            for r in b.to_pylist():
                if state is None or r[run] != key:
                    if state is not None:
                        done.append(end())
                    key, size, state = r[run], r["_n"], (math.inf, None, None, -1)
                best, at, e, stop = state
                if stop >= 0:
                    continue
                # entries fall: the first below the best less min_delta
                k = 0 if at is None else bisect.bisect_right(r["_entry_x"], -(best - min_delta), key=lambda x: -x)
                if k == len(r["_entry_x"]):
                    continue
                if at is not None and r["_entry_at"][k] - at > patience:
                    state = (best, at, e, at + patience)
                else:
                    state = (r["_last_x"][k], r["_last_at"][k], r["_last_e"][k], r["_stop"][k])
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=out_schema(b))
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, end()))], schema=out_schema(b))

    def out_schema(b):
        import pyarrow as pa

        return pa.schema([(run, b.schema.field(run).type), ("_n", pa.int64()), ("stop_at", pa.int64()), ("best_epoch", pa.int64()), ("best_score", pa.float64())])

    placed = rec.repartition(run, "_seg").sortWithinPartitions(run, "_seg", "_at")
    summaries = placed.mapInArrow(summarise, f"`{run}` {kind}, _seg bigint, _n bigint, {lists}")
    ordered = summaries.repartition(run).sortWithinPartitions(run, "_seg")
    return ordered.mapInArrow(follow, f"`{run}` {kind}, _n bigint, stop_at bigint, best_epoch bigint, best_score double").drop("_n")


def run_summary(df: DataFrame, reach: float = K.GOAL_REACH_M, keys: Sequence[str] = ("run_id",), episode: str = "episode_ord") -> DataFrame:
    """Frames, seconds between first and last frame, frames per second and episodes that reached the goal."""
    per = df.groupBy(*keys, episode).agg(
        F.count(F.lit(1)).alias("_n"), F.min("t_us").alias("_a"), F.max("t_us").alias("_b"),
        F.max((F.col("goal_dist_m") <= reach).cast("int")).alias("_g"),
    )
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.sum("_g").alias("reached_goal"),
        F.sum("_n").alias("frames"),
        (F.sum(F.col("_b") - F.col("_a")) / 1e6).alias("seconds"),
    )
    return out.withColumn("frames_per_second", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0))
