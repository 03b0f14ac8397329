"""Queries for reports, audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.labelling import LABELLED, labelled
from wayframe.catalog.registry import query
from wayframe.catalog.rl import REWARDS, start
from wayframe.catalog.views import frames, r6, table, tensors, ticks_in
from wayframe.operators import reports as RP
from wayframe.operators import rewards as R
from wayframe.sources.shared import settle


@query(
    "tensor_stats",
    f"""WITH {Q.TENSORS}, x AS (SELECT 'ego_vec' AS field, v[j] AS x FROM tensors CROSS JOIN range(1, 15) r(j)
  UNION ALL SELECT 'objects', v[j] FROM tensors CROSS JOIN range(1, 56) r(j))
SELECT field, count(*) AS n, {Q.r6('min(x)', 'min')}, {Q.r6('max(x)', 'max')}, {Q.r6('avg(x)', 'mean')}, {Q.r6('stddev_samp(x)', 'std')},
  CASE field WHEN 'ego_vec' THEN (SELECT count(*) FROM tensors)::VARCHAR || ',14' ELSE (SELECT count(*) FROM tensors)::VARCHAR || ',5,11' END AS shape FROM x GROUP BY 1""",
)
def _(spark, sf):
    s = RP.tensor_stats(tensors(spark, sf), ["ego_vec", "objects"])
    return s.select("field", "n", r6("min"), r6("max"), r6("mean"), r6("std"), F.array_join(F.transform("shape", lambda d: d.cast("string")), ",").alias("shape"))


def _hist(source: str, x: str, lo: str, hi: str, n: int) -> str:
    return f"""h AS (SELECT CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN CAST(least({n - 1}, floor(({x} - {lo}) * {n} / ({hi} - {lo}))) AS INTEGER) END AS bin FROM {source}),
c AS (SELECT bin, count(*) AS n FROM h GROUP BY 1), t AS (SELECT count(*) AS total FROM h)
SELECT CAST(b AS INTEGER) AS bin, {Q.r6(f'{lo} + ({hi} - {lo}) * b / {n}', '"from"')}, {Q.r6(f'{lo} + ({hi} - {lo}) * (b + 1) / {n}', '"to"')}, coalesce(n, 0) AS count,
  {Q.r6('coalesce(n, 0) * 1e2 / (SELECT total FROM t)', 'percent')} FROM range(0, {n}) r(b) LEFT JOIN c ON c.bin = r.b"""


def _hist_cols(df: DataFrame) -> DataFrame:
    return df.select("bin", r6("from"), r6("to"), "count", r6("percent"))


@query("histogram_speed", f"WITH {Q.FRAMES}, " + _hist("(SELECT speed_mps / 5e1 AS s FROM frames)", "s", "0e0", "1e0", 10))
def _(spark, sf):
    return _hist_cols(RP.histogram(frames(spark, sf), F.col("speed_mps") / 50.0, 0, 1))


@query(
    "histogram_curvature",
    f"WITH {Q.FRAMES}, " + _hist("(SELECT yaw_rate / greatest(speed_mps, 5e-1) AS s FROM frames)", "s", "-1e0", "1e0", 10),
)
def _(spark, sf):
    return _hist_cols(RP.histogram(frames(spark, sf), F.col("yaw_rate") / F.greatest("speed_mps", F.lit(0.5)), -1, 1))


def rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: the steps that follow read their ticks several times.
    return R.rewards(R.tick_events(settle(frames(spark, sf_dir), "ticks"), 0.1, start(), rows=ticks_in(spark, sf_dir)))


@query(
    "reward_histogram",
    f"WITH {REWARDS}, lim AS (SELECT min(reward_clipped) AS lo, max(reward_clipped) AS hi FROM rc), xs AS (SELECT reward_clipped AS s, lo, hi FROM rc, lim), "
    + f"""h AS (SELECT CAST(least(19, floor((s - lo) * 20 / (hi - lo))) AS INTEGER) AS bin FROM xs),
c AS (SELECT bin, count(*) AS n FROM h GROUP BY 1)
SELECT bin, {Q.r6('lo + (hi - lo) * bin / 20', '"from"')}, {Q.r6('lo + (hi - lo) * (bin + 1) / 20', '"to"')}, n AS count,
  {Q.r6('n * 1e2 / (SELECT count(*) FROM h)', 'percent')} FROM c, lim""",
)
def _(spark, sf):
    return _hist_cols(RP.reward_histogram(rewarded(spark, sf)))


@query(
    "reward_report",
    f"""WITH {REWARDS} SELECT count(*) AS rows, {', '.join(f"{Q.r6(f'avg(reward_{c})', f'{c}_mean')}, {Q.r6(f'stddev_samp(reward_{c})', f'{c}_std')}, {Q.r6(f'sum(reward_{c})', f'{c}_sum', 4)}, count(*) FILTER (WHERE reward_{c} <> 0) AS {c}_events" for c in ('progress', 'collision', 'offroad', 'violation', 'comfort'))},
  count(*) FILTER (WHERE route_completed) AS done_rows, {Q.r6('count(*) FILTER (WHERE route_completed) * 1e2 / count(*)', 'done_percent')} FROM rc""",
)
def _(spark, sf):
    rep = RP.reward_report(rewarded(spark, sf).withColumn("done", F.col("route_completed")))
    cols = [c if c.endswith("_events") or c.endswith("rows") else r6(c, digits=4 if c.endswith("_sum") else 6) for c in rep.columns]
    return rep.select(*cols)


@query(
    "distribution",
    f"""WITH {Q.FRAMES}, x AS (SELECT speed_mps / 5e1 AS s FROM frames),
d AS (SELECT min(s) AS min, max(s) AS max, avg(s) AS mean, stddev_samp(s) AS std, quantile_disc(s, 0.5) AS median, avg(abs(s)) AS abs_mean FROM x)
SELECT {', '.join(Q.r6(c, c) + ', ' + Q.r6(f'{c} * 50', f'{c}_physical', 4) for c in ('min', 'max', 'mean', 'std', 'median', 'abs_mean'))} FROM d""",
)
def _(spark, sf):
    d = RP.distribution(frames(spark, sf).withColumn("s", F.col("speed_mps") / 50.0), "s", 50.0)
    return d.select(*[r6(c, digits=4 if c.endswith("physical") else 6) for c in d.columns])


@query(
    "middle_values",
    "SELECT count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS lower, 2 * median(l_extendedprice) - quantile_disc(l_extendedprice, 0.5) AS upper FROM lineitem",
)
def _(spark, sf):
    m = RP.middle_values(table(spark, sf, "lineitem"), "l_extendedprice")
    return m.select("n", r6("lower"), r6("upper"))


@query(
    "command_distribution",
    f"""WITH {Q.FRAMES}, c AS (SELECT CAST(round_even(command / 5e0 * 5, 0) AS INTEGER) AS command, count(*) AS count FROM frames GROUP BY 1)
SELECT command, CASE command WHEN 0 THEN 'LaneFollow' WHEN 1 THEN 'Left' WHEN 2 THEN 'Right' WHEN 3 THEN 'Straight' WHEN 4 THEN 'ChangeLaneLeft' ELSE 'ChangeLaneRight' END AS label,
  count, {Q.r6('count * 1e2 / sum(count) OVER ()', 'percent')} FROM c""",
)
def _(spark, sf):
    d = RP.command_distribution(frames(spark, sf), F.col("command") / 5.0)
    return d.select("command", "label", "count", r6("percent"))


DIVERSE = """d AS (SELECT count(*) AS samples_checked, avg(speed_mps) AS speed_mean, stddev_pop(speed_mps) AS speed_std, stddev_pop(steer_norm) AS steer_std,
  count(*) FILTER (WHERE speed_mps > 5e-1) / count(*) AS moving_ratio FROM {source})
SELECT samples_checked, {r}, CASE WHEN issues <> '' THEN 'warning' ELSE 'ok' END AS status, samples_checked < 100 AS few_samples, issues FROM (SELECT *, 1 - moving_ratio AS stationary_ratio,
  concat_ws(',', CASE WHEN speed_std < 12 THEN 'speed_std' END, CASE WHEN steer_std < 1e-1 THEN 'steer_std' END, CASE WHEN moving_ratio < 95e-2 THEN 'moving_ratio' END,
  CASE WHEN 1 - moving_ratio > 25e-2 THEN 'stationary_ratio' END) AS issues FROM d)"""
RATIOS = ("speed_mean", "speed_std", "steer_std", "moving_ratio", "stationary_ratio")


def _diverse(source: str) -> str:
    return DIVERSE.format(source=source, r=", ".join(Q.r6(c, c, 5) for c in RATIOS))


def _diverse_cols(df: DataFrame) -> DataFrame:
    return df.select("samples_checked", *[r6(c, digits=5) for c in RATIOS], "status", "few_samples", F.array_join("issues", ",").alias("issues"))


RULES = {"min_speed_std": 12.0, "min_moving_ratio": 0.95}


@query("diversity_report", f"WITH {Q.FRAMES}, {_diverse('frames')}")
def _(spark, sf):
    return _diverse_cols(RP.diversity_report(frames(spark, sf), F.col("speed_mps"), F.col("steer_norm"), RULES))


@query(
    "label_sanity",
    f"""WITH {LABELLED}, v AS (SELECT stddev_samp(least(greatest(v / 5e1, 0), 1)) * 50 AS speed_std FROM way),
p AS (SELECT stddev_samp(p) * 100 AS xy_std FROM (SELECT least(greatest(x / 1e2, -1), 1) AS p FROM way UNION ALL SELECT least(greatest(y / 1e2, -1), 1) FROM way))
SELECT {Q.r6('speed_std', 'speed_std', 5)}, {Q.r6('xy_std', 'xy_std', 5)}, speed_std >= 1e-1 AS speed_ok, xy_std >= 5e-1 AS xy_ok FROM v, p""",
)
def _(spark, sf):
    from wayframe.functions.normalise import normalize_futures

    xy, v = normalize_futures(
        F.transform("futures", lambda p: F.array(p["x"], p["y"])), F.transform("futures", lambda p: p["v"])
    )
    s = RP.label_sanity(labelled(spark, sf).select(xy.alias("future_xy"), v.alias("future_v")))
    return s.select(r6("speed_std", digits=5), r6("xy_std", digits=5), "speed_ok", "xy_ok")


@query("speed_limit_table", f"WITH {Q.FRAMES} SELECT speed_limit_kmh AS limit_kmh, count(*) AS count FROM frames GROUP BY 1")
def _(spark, sf):
    return RP.speed_limit_table(frames(spark, sf), "speed_limit_kmh")


@query(
    "speed_limit_report",
    f"""WITH {Q.FRAMES}, s AS (SELECT count(*) AS n, min(speed_limit_kmh) AS min, max(speed_limit_kmh) AS max, avg(speed_limit_kmh) AS mean, median(speed_limit_kmh) AS median FROM frames)
SELECT n, {', '.join(Q.r6(c, f'{c}_kmh') + ', ' + Q.r6(f'{c} / 36e-1', f'{c}_mps') for c in ('min', 'max', 'mean', 'median'))} FROM s""",
)
def _(spark, sf):
    s = RP.speed_limit_report(frames(spark, sf), "speed_limit_kmh")
    return s.select("n", *[r6(c) for c in s.columns if c != "n"])


STEPS = Q.FRAMES + """,
steps AS (SELECT episode_ord, frame_id, speed_mps, collisions_cum - coalesce(lag(collisions_cum) OVER (PARTITION BY episode_ord ORDER BY frame_id), 0) AS ce,
  goal_dist_m <= 5 AND episode_ord % 3 <> 0 AS reached FROM frames),
per AS (SELECT episode_ord, max(CASE WHEN reached THEN 1e0 ELSE 0e0 END) AS completion, CASE WHEN sum(ce) >= 1 THEN 1e0 ELSE 0e0 END AS collision,
  CAST(sum(ce) AS BIGINT) AS infractions, sum(speed_mps) / count(*) AS mean_speed FROM steps GROUP BY 1)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayframe.operators.futures import EPISODE
    from wayframe.plans.segments import neighbours

    f = neighbours(frames(spark, sf_dir), EPISODE, "frame_id", _was=F.col("collisions_cum"))
    return f.select(
        "episode_ord",
        "speed_mps",
        (F.col("collisions_cum") - F.coalesce("_was", F.lit(0))).alias("collision_events"),
        ((F.col("goal_dist_m") <= 5) & (F.col("episode_ord") % 3 != 0)).alias("reached"),
    )


@query(
    "episode_evaluation",
    f"WITH {STEPS} SELECT episode_ord, completion, collision, infractions, {Q.r6('mean_speed', 'mean_speed', 5)}, completion AS success FROM per",
)
def _(spark, sf):
    e = RP.episode_evaluation(steps(spark, sf), ["episode_ord"])
    return e.select("episode_ord", "completion", "collision", "infractions", r6("mean_speed", digits=5), "success")


@query(
    "evaluation_report",
    f"""WITH {STEPS} SELECT {Q.r6('avg(completion)', 'route_completion_rate')}, {Q.r6('avg(collision)', 'collision_rate')}, {Q.r6('avg(infractions)', 'infraction_count')},
  {Q.r6('avg(mean_speed)', 'avg_speed', 5)}, {Q.r6('avg(completion)', 'success_rate')}, count(*) AS episodes_run FROM per""",
)
def _(spark, sf):
    e = RP.evaluation_report(steps(spark, sf), ["episode_ord"])
    names = ("route_completion_rate", "collision_rate", "infraction_count", "success_rate")
    return e.select(*[r6(c) for c in names], r6("avg_speed", digits=5), "episodes_run")


@query(
    "accuracy",
    f"""WITH {Q.TENSORS}, p AS (SELECT list_position(v[1:10], list_max(v[1:10])) - 1 = target AS hit FROM tensors)
SELECT count(*) FILTER (WHERE hit) AS correct, count(*) AS total, {Q.r6('count(*) FILTER (WHERE hit) / count(*)', 'accuracy')} FROM p""",
)
def _(spark, sf):
    a = RP.accuracy(tensors(spark, sf))
    return a.select("correct", "total", r6("accuracy"))


@query("nll_mean", f"WITH {LABELLED} SELECT count(*) AS n, {Q.r6('avg(abs(v))', 'nll_mean', 5)} FROM way")
def _(spark, sf):
    p = labelled(spark, sf).select(F.inline("futures"))
    n = RP.nll_mean(p, -F.abs("v"))
    return n.select("n", r6("nll_mean", digits=5))


LOSS = LABELLED + """,
w AS (SELECT episode_ord * 10 + frame_id % 10 AS batch, episode_ord, frame_id, exp(-5e-1 * i) * CASE WHEN (i + frame_id) % 5 = 0 THEN 0 ELSE 1 END AS w,
  (frame_id % 7 - 3) / 1e2 AS e FROM way),
l AS (SELECT batch, count(DISTINCT (episode_ord, frame_id)) AS batch_size, sum(w * 2 * e * e) / (sum(w) + 1e-8) AS loss_waypoint,
  sum(w * CASE WHEN abs(e) < 1 THEN 5e-1 * e * e ELSE abs(e) - 5e-1 END) / (sum(w) + 1e-8) AS loss_speed FROM w GROUP BY 1)"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are off by (frame_id % 7 - 3) / 100 in metres and m/s."""
    e = (F.col("frame_id") % 7 - 3) / 100.0
    full = labelled(spark, sf_dir).where(F.size("futures") > 0)
    f = full.select(
        (F.col("episode_ord") * 10 + F.col("frame_id") % 10).alias("batch"),
        F.transform("futures", lambda p: F.array(p["x"] / 100.0, p["y"] / 100.0)).alias("future_xy"),
        F.transform("futures", lambda p: F.array((p["x"] + e) / 100.0, (p["y"] + e) / 100.0)).alias("pred_xy"),
        F.transform("futures", lambda p: p["v"] / 50.0).alias("future_v"),
        F.transform("futures", lambda p: (p["v"] + e) / 50.0).alias("pred_v"),
        F.transform("futures", lambda p: F.when((p["i"] + F.col("frame_id")) % 5 == 0, 0.0).otherwise(1.0)).alias("future_mask"),
    )
    return RP.trajectory_loss(f, 0.5)


@query(
    "trajectory_loss",
    f"WITH {LOSS} SELECT batch, batch_size, {Q.r6('loss_waypoint', 'loss_waypoint')}, {Q.r6('loss_speed', 'loss_speed')}, {Q.r6('loss_waypoint + loss_speed', 'loss')} FROM l",
)
def _(spark, sf):
    return losses(spark, sf).select("batch", "batch_size", r6("loss_waypoint"), r6("loss_speed"), r6("loss"))


@query(
    "mean_trajectory_loss",
    f"""WITH {LOSS} SELECT {Q.r6('sum((loss_waypoint + loss_speed) * batch_size) / sum(batch_size)', 'loss')}, {Q.r6('sum(loss_waypoint * batch_size) / sum(batch_size)', 'loss_waypoint')},
  {Q.r6('sum(loss_speed * batch_size) / sum(batch_size)', 'loss_speed')}, CAST(sum(batch_size) AS BIGINT) AS samples FROM l""",
)
def _(spark, sf):
    m = RP.mean_trajectory_loss(losses(spark, sf))
    return m.select(r6("loss"), r6("loss_waypoint"), r6("loss_speed"), "samples")


@query("top_k_max", "SELECT c_custkey AS id, c_acctbal AS objective FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(spark, sf):
    return RP.top_k(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("objective")), 25)


@query("top_k_min", "SELECT c_custkey AS id, c_acctbal AS objective FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
def _(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("objective"))
    return RP.top_k(t, 25, maximize=False)


def _early(patience: int, delta: str, sign: str) -> str:
    return f"""WITH RECURSIVE m AS (SELECT user_id AS run, event_id AS epoch, {sign}value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
f AS (SELECT run, pos, x AS best, epoch AS best_epoch, 0 AS miss FROM m WHERE pos = 0
  UNION ALL SELECT m.run, m.pos, CASE WHEN x < best - {delta} THEN x ELSE best END, CASE WHEN x < best - {delta} THEN m.epoch ELSE best_epoch END,
    CASE WHEN x < best - {delta} THEN 0 ELSE miss + 1 END FROM f JOIN m ON m.run = f.run AND m.pos = f.pos + 1 WHERE f.miss < {patience}),
e AS (SELECT run, max(pos) AS pos FROM f GROUP BY 1)
SELECT f.run, CASE WHEN miss >= {patience} THEN f.pos END AS stop_at, best_epoch, {sign}best AS best_score FROM f JOIN e USING (run, pos)"""


@query("early_stop", _early(20, "5e-1", ""))
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    return RP.early_stop(ev, 20, 0.5)


@query("early_stop_max", _early(12, "1e0", "-"))
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    return RP.early_stop(ev, 12, 1.0, maximize=True)


@query(
    "run_summary",
    f"""WITH {Q.FRAMES}, p AS (SELECT run_id, episode_ord, count(*) AS n, max(t_us) - min(t_us) AS d, max(CASE WHEN goal_dist_m <= 5 THEN 1 ELSE 0 END) AS g FROM frames GROUP BY 1, 2)
SELECT run_id, count(*) AS episodes, CAST(sum(g) AS BIGINT) AS reached_goal, CAST(sum(n) AS BIGINT) AS frames, {Q.r6('sum(d) / 1e6', 'seconds')}, {Q.r6('sum(n) / (sum(d) / 1e6)', 'frames_per_second')} FROM p GROUP BY 1""",
)
def _(spark, sf):
    s = RP.run_summary(frames(spark, sf))
    return s.select("run_id", "episodes", "reached_goal", "frames", r6("seconds"), r6("frames_per_second"))
