"""Queries for gates, future labels and frame quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.views import frames, lights, r6, ticks_in
from wayframe.functions import geometry as G
from wayframe.operators import futures as FU
from wayframe.operators import gates as GA
from wayframe.operators import joins as JO
from wayframe.operators import quality as QU
from wayframe.plans.segments import dense_index
from wayframe.sources.shared import settle

KEY = ["episode_ord", "frame_id"]


def buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded ticks: gate on all ticks, then the control check.

    Written once: what follows reads its input several times, and stacked plans would double at each step.
    """
    return settle(GA.drop_action_mismatch(GA.recording_gate(frames(spark, sf_dir), rows=ticks_in(spark, sf_dir))), "ticks")


BUFFERED = Q.FRAMES + "," + Q.gate() + """,
buffered AS (SELECT * FROM gated WHERE recording AND NOT (speed_mps > 5e-1 AND brake > 5e-1 AND throttle > 2e-1))"""

LABELLED = BUFFERED + "," + Q.futures(12, 200_000, source="buffered") + "," + Q.waypoints()


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded frames with their future points in their own axes."""
    return FU.future_waypoints(FU.future_samples(buffered(spark, sf_dir)))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded ticks, numbered consecutively per episode, and whether a light was near.

    Done before labelling, while rows are narrow and numbers only cost a count of the ticks; the tail
    ticks come last, so the numbers of the frames stay consecutive without them.
    """
    ticks = buffered(spark, sf_dir)
    return settle(beside_lights(spark, sf_dir, dense_index(ticks, FU.EPISODE, "frame_id", rows=ticks.count())), "ticks")


@query(
    "drop_action_mismatch",
    f"WITH {Q.FRAMES} SELECT episode_ord, frame_id, throttle, brake FROM frames "
    "WHERE NOT (speed_mps > 5e-1 AND brake > 5e-1 AND throttle > 2e-1)",
)
def _(spark, sf):
    return GA.drop_action_mismatch(frames(spark, sf)).select(*KEY, "throttle", "brake")


@query("recording_gate", f"WITH {Q.FRAMES},{Q.gate()} SELECT episode_ord, frame_id FROM gated WHERE recording")
def _(spark, sf):
    return GA.recording_gate(frames(spark, sf), rows=ticks_in(spark, sf)).select(*KEY)


@query(
    "future_samples",
    f"WITH {BUFFERED},{Q.futures(12, 200_000, source='buffered')} SELECT episode_ord, frame_id, i, f_us, f_x, f_v FROM fut",
)
def _(spark, sf):
    out = FU.future_samples(buffered(spark, sf)).select(*KEY, F.inline("samples"))
    return out.select(*KEY, "i", F.col("t_us").alias("f_us"), F.col("x_m").alias("f_x"), F.col("speed_mps").alias("f_v"))


SIX_HOURS = 6 * 3_600_000_000


@query(
    "future_samples_irregular",
    f"WITH {Q.FRAMES},{Q.futures(12, SIX_HOURS, time='ts_us', bases='true')} SELECT episode_ord, frame_id, i, f_us FROM fut",
)
def _(spark, sf):
    f = settle(frames(spark, sf, irregular=True), "ticks")
    out = FU.future_samples(f, step_us=SIX_HOURS, tail=None, bucket_us=12 * SIX_HOURS)
    return out.select(*KEY, F.inline("samples")).select(*KEY, "i", F.col("t_us").alias("f_us"))


@query(
    "future_samples_sparse",
    f"WITH {Q.FRAMES},{Q.futures(12, 60_000_000, time='ts_us', bases='true')} SELECT episode_ord, frame_id, i, f_us FROM fut",
)
def _(spark, sf):
    """Steps of a minute over samples that are minutes to hours apart: the forced progress decides."""
    f = settle(frames(spark, sf, irregular=True), "ticks")
    out = FU.future_samples(f, step_us=60_000_000, tail=None)
    return out.select(*KEY, F.inline("samples")).select(*KEY, "i", F.col("t_us").alias("f_us"))


@query(
    "future_waypoints",
    f"WITH {LABELLED} SELECT episode_ord, frame_id, i, {Q.r6('x', 'x')}, {Q.r6('y', 'y')}, {Q.r6('v', 'v')} FROM way",
)
def _(spark, sf):
    out = labelled(spark, sf).select(*KEY, F.inline("futures"))
    return out.select(*KEY, "i", r6("x"), r6("y"), r6("v"))


@query(
    "future_extrema",
    f"WITH {LABELLED} SELECT episode_ord, frame_id, {Q.r6('max_step', 'max_step')}, {Q.r6('displacement', 'displacement')}, "
    f"{Q.r6('max_speed', 'max_speed')}, {Q.r6('max_forward', 'max_forward')} FROM ext",
)
def _(spark, sf):
    out = FU.future_extrema(labelled(spark, sf).where(F.size("futures") > 0))
    return out.select(*KEY, r6("max_step"), r6("displacement"), r6("max_speed"), r6("max_forward"))


@query(
    "require_full_horizon",
    f"WITH {LABELLED} SELECT episode_ord, frame_id FROM ext WHERE points = 12",
)
def _(spark, sf):
    return QU.require_full_horizon(labelled(spark, sf)).select(*KEY)


def judged(spark: SparkSession, sf_dir: str, ticks: DataFrame | None = None) -> DataFrame:
    """Labelled frames with extrema, the stationary flag and the limit repair."""
    limit, is_default = G.repair_speed_limit(F.col("speed_limit_kmh"), default=13.9)
    ticks = buffered(spark, sf_dir) if ticks is None else ticks
    df = FU.future_extrema(FU.future_waypoints(FU.future_samples(ticks)))
    return (
        df.withColumn("stationary", QU.stationary_flag())
        .withColumn("speed_limit_mps", limit)
        .withColumn("limit_is_default", is_default)
    )


STATIONARY = "(max_step < 5e-2 AND displacement < 2e-1 AND max_speed < 2e-1)"

JUDGED = LABELLED + f""",
ext0 AS (SELECT b.episode_ord, b.frame_id, b.run_tick, b.idx, b.speed_mps, b.command, EXISTS (SELECT 1 FROM lineitem l WHERE l_linenumber = 1 AND l_orderkey = b.run_tick
                  AND sqrt(pow(l_quantity - 10, 2) + pow(l_partkey % 21 - 10, 2)) < 15) AS near_light,
                b.speed_limit_kmh, coalesce(points, 0) AS points, coalesce(max_step, 0) AS max_step,
                coalesce(displacement, 0) AS displacement, coalesce(max_speed, 0) AS max_speed,
                coalesce(max_forward, 0) AS max_forward, last_x, last_y
         FROM bas b LEFT JOIN ext USING (episode_ord, frame_id)),
judged AS (SELECT *, {STATIONARY} AS stationary FROM ext0)"""


@query("stationary_flag", f"WITH {JUDGED} SELECT episode_ord, frame_id, stationary FROM judged WHERE points = 12")
def _(spark, sf):
    return QU.require_full_horizon(judged(spark, sf)).select(*KEY, "stationary")


@query("drop_behind", f"WITH {JUDGED} SELECT episode_ord, frame_id FROM judged WHERE points = 12 AND NOT max_forward < -1")
def _(spark, sf):
    return QU.drop_behind(QU.require_full_horizon(judged(spark, sf))).select(*KEY)


@query("drop_jump", f"WITH {JUDGED} SELECT episode_ord, frame_id FROM judged WHERE points = 12 AND NOT max_step > 60")
def _(spark, sf):
    return QU.drop_jump(QU.require_full_horizon(judged(spark, sf))).select(*KEY)


REASON = """CASE WHEN points < 12 THEN 'future_missing' WHEN {standing} THEN 'stationary'
  WHEN max_forward < -1 THEN 'behind' WHEN max_step > 60 THEN 'jump' ELSE 'written' END"""


@query(
    "rejection_reason",
    f"WITH {JUDGED} SELECT {REASON.format(standing='stationary')} AS reason, count(*) AS frames FROM judged GROUP BY 1",
)
def _(spark, sf):
    return QU.rejection_reason(judged(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("frames"))


#: The test frames are one run.
EPISODE_KEY = ("episode_ord", "frame_id")


def beside_lights(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Whether a light's stop point was near at the frame; the test lights go by the run's tick."""
    ticks = df.withColumn("tick", F.col("run_tick"))
    return JO.near_light(ticks, lights(spark, sf_dir), rows=ticks_in(spark, sf_dir)).drop("tick")


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationary thinning over the frames with a full horizon (the first ones of each episode)."""
    full = QU.require_full_horizon(judged(spark, sf_dir, numbered(spark, sf_dir)))
    return GA.thin_stationary(full, key=EPISODE_KEY, rows=ticks_in(spark, sf_dir))


THINNED = JUDGED + f""",
full_h AS (SELECT *, row_number() OVER (PARTITION BY episode_ord ORDER BY frame_id) AS rn FROM judged WHERE points = 12),
moved AS (SELECT *, coalesce(max(CASE WHEN NOT stationary THEN rn END)
            OVER (PARTITION BY episode_ord ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS moved_at FROM full_h),
thinned AS (SELECT *, NOT stationary OR near_light OR (rn - moved_at <= 5 AND {Q.uniform('episode_ord, frame_id')} < 15e-2) AS keep FROM moved)"""


@query("thin_stationary", f"WITH {THINNED} SELECT episode_ord, frame_id, stationary, keep FROM thinned")
def _(spark, sf):
    return thinned(spark, sf).select(*KEY, "stationary", "keep")


@query(
    "episode_report",
    f"""WITH {THINNED},
rep AS (SELECT j.*, coalesce(t.keep, true) AS keep FROM judged j LEFT JOIN thinned t USING (episode_ord, frame_id)),
cmd AS (SELECT *, degrees(atan2(last_y, last_x)) AS hd FROM rep),
rea AS (SELECT *, {REASON.format(standing='NOT keep')} AS reason,
  CASE WHEN points < 2 THEN NULL
       WHEN abs(last_y) > 35e-1 * 6e-1 AND abs(hd) < 15 THEN CASE WHEN last_y > 0 THEN 4 ELSE 5 END
       WHEN hd > 20 THEN 1 WHEN hd < -20 THEN 2 WHEN abs(hd) < 10 THEN 0 ELSE 3 END AS ec FROM cmd),
agg AS (SELECT episode_ord, count(*) AS frames,
  count(*) FILTER (WHERE reason = 'future_missing') AS n_future_missing,
  count(*) FILTER (WHERE reason = 'stationary') AS n_stationary,
  count(*) FILTER (WHERE reason = 'behind') AS n_behind, count(*) FILTER (WHERE reason = 'jump') AS n_jump,
  count(*) FILTER (WHERE reason = 'written') AS n_written,
  count(*) FILTER (WHERE points = 12 AND stationary AND keep) AS kept_stationary,
  sum(CASE WHEN reason = 'written' THEN speed_mps END) AS speed_sum,
  {", ".join(f"count(*) FILTER (WHERE reason = 'written' AND command = {c}) AS command_{c}" for c in range(6))},
  count(*) FILTER (WHERE reason = 'written' AND ec IS NOT NULL AND ec <> command) AS command_disagree,
  count(*) FILTER (WHERE speed_limit_kmh <= 0) AS speed_limit_fallback FROM rea GROUP BY 1)
SELECT 'run0' AS run_id, * EXCLUDE (speed_sum),
  {Q.r6("kept_stationary / greatest(n_stationary + kept_stationary, 1)", "stationary_ratio")},
  {Q.r6("coalesce(speed_sum, 0) / greatest(n_written, 1)", "mean_speed", 5)} FROM agg""",
)
def _(spark, sf):
    """Flagship: per episode, how many frames were written and why the rest were rejected."""
    report = QU.episode_report(reasoned(spark, sf))
    plain = [c for c in report.columns if c not in ("stationary_ratio", "mean_speed")]
    return report.select(*plain, r6("stationary_ratio"), r6("mean_speed", digits=5))


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recorded frames with their reason.

    Frames without a full horizon are the last ones of an episode, so thinning
    all frames leaves the position of the others unchanged.
    """
    frames_ = judged(spark, sf_dir, numbered(spark, sf_dir))
    complete = frames_.withColumn("stationary", F.col("stationary") & QU.has_full_horizon())
    kept = GA.thin_stationary(complete, key=EPISODE_KEY, rows=ticks_in(spark, sf_dir))
    return FU.command_from_futures(QU.rejection_reason(kept))


@query(
    "command_from_futures",
    f"""WITH {JUDGED},
cmd AS (SELECT *, degrees(atan2(last_y, last_x)) AS hd FROM judged WHERE points = 12),
ec AS (SELECT *, CASE
       WHEN abs(last_y) > 35e-1 * 6e-1 AND abs(hd) < 15 THEN CASE WHEN last_y > 0 THEN 4 ELSE 5 END
       WHEN hd > 20 THEN 1 WHEN hd < -20 THEN 2 WHEN abs(hd) < 10 THEN 0 ELSE 3 END AS exec_command FROM cmd)
SELECT episode_ord, frame_id, exec_command, exec_command <> command AS command_disagrees FROM ec""",
)
def _(spark, sf):
    full = QU.require_full_horizon(labelled(spark, sf))
    return FU.command_from_futures(full).select(*KEY, "exec_command", "command_disagrees")


@query(
    "future_variation",
    f"""WITH {LABELLED},
dv AS (SELECT episode_ord, frame_id, abs(x - lag(x) OVER w) AS dx, abs(y - lag(y) OVER w) AS dy, abs(v - lag(v) OVER w) AS dv
       FROM way WINDOW w AS (PARTITION BY episode_ord, frame_id ORDER BY i)),
per AS (SELECT episode_ord, frame_id, avg(dx) AS ax, avg(dy) AS ay, avg(dv) AS av FROM dv GROUP BY 1, 2 HAVING count(*) > 1)
SELECT count(*) AS n_samples, {Q.r6('avg(ax)', 'mean_variation_x')}, {Q.r6('avg(ay)', 'mean_variation_y')},
  {Q.r6('avg(av)', 'mean_variation_v')}, count(*) FILTER (WHERE ax < 1e-4) AS flat_x, count(*) FILTER (WHERE ay < 1e-5) AS flat_y FROM per""",
)
def _(spark, sf):
    rep = FU.future_variation_report(labelled(spark, sf))
    return rep.select(
        "n_samples", *[r6(f"mean_variation_{c}") for c in "xyv"], "flat_x", "flat_y"
    )


@query(
    "cut_at_goal",
    f"""WITH {Q.FRAMES}, g AS (SELECT *, min(CASE WHEN goal_dist_m <= 120 THEN frame_id END) OVER (PARTITION BY episode_ord) AS f FROM frames)
SELECT episode_ord, frame_id, goal_dist_m FROM g WHERE f IS NULL OR frame_id < f""",
)
def _(spark, sf):
    return GA.cut_at_goal(frames(spark, sf), reach=120.0).select(*KEY, "goal_dist_m")


@query(
    "mark_terminal",
    f"""WITH {Q.FRAMES}, s AS (SELECT *, max(frame_id) OVER (PARTITION BY episode_ord) AS l FROM frames WHERE speed_mps > 5)
SELECT episode_ord, frame_id, frame_id = l AS done, CASE WHEN frame_id = l THEN 0e0 ELSE 1e0 END AS discount FROM s""",
)
def _(spark, sf):
    return GA.mark_terminal(frames(spark, sf).where("speed_mps > 5")).select(*KEY, "done", "discount")


@query(
    "check_ranges",
    f"""WITH {Q.FRAMES} SELECT episode_ord, count(*) AS rows, count(*) FILTER (WHERE speed_mps > 20) AS too_fast,
  count(*) FILTER (WHERE greatest(abs(accel_long), abs(accel_lat)) > 4) AS too_hard FROM frames GROUP BY 1""",
)
def _(spark, sf):
    rules = {"max_speed_mps": 20.0, "max_abs_accel_mps2": 4.0, "min_route_cov": 0.6}
    return QU.check_ranges(frames(spark, sf), rules, ["episode_ord"])
