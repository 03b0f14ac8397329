"""Queries for tick-to-tick quantities, rewards and RL labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.views import frames, lights, r6, ticks_in
from wayframe.operators import gates as GA
from wayframe.operators import joins as J
from wayframe.operators import motion as M
from wayframe.operators import rewards as R
from wayframe.operators.gates import cut_at_terminal, mark_gate

KEY = ["episode_ord", "frame_id"]
START = 1000.0

EVENTS = Q.FRAMES + """,
prev AS (SELECT *, lag(accel_long) OVER w AS pa, lag(accel_lat) OVER w AS pl, coalesce(lag(steer_norm) OVER w, 0) AS ps,
           coalesce(lag(goal_dist_m) OVER w, 1e3) AS pg, coalesce(lag(collisions_cum) OVER w, 0) AS pc,
           coalesce(lag(lane_events_cum) OVER w, 0) AS pe
         FROM frames WINDOW w AS (PARTITION BY episode_ord ORDER BY frame_id)),
evs AS (SELECT *, coalesce(sqrt(pow((accel_long - pa) / 1e-1, 2) + pow((accel_lat - pl) / 1e-1, 2)), 0e0) AS jerk,
          abs(steer_norm - ps) AS steer_change, greatest(0e0, pg - goal_dist_m) AS route_progress_delta,
          collisions_cum > pc AS collision_flag, lane_events_cum > pe AS lane_flag,
          coalesce(lane_type <> 1, true) AS offroad_flag, goal_dist_m <= 5 AS route_completed FROM prev)"""

REWARDS = EVENTS + """,
rw AS (SELECT *, route_progress_delta * 1e-1 AS reward_progress, CASE WHEN collision_flag THEN -5e0 ELSE 0e0 END AS reward_collision,
         CASE WHEN offroad_flag THEN -2e0 ELSE 0e0 END AS reward_offroad, CASE WHEN lane_flag THEN -1e0 ELSE 0e0 END AS reward_violation,
         (jerk + steer_change) * -1e-2 AS reward_comfort, CASE WHEN route_completed THEN 5e0 ELSE 0e0 END AS reward_completion FROM evs),
rr AS (SELECT *, reward_progress + reward_collision + reward_offroad + reward_violation + reward_comfort + reward_completion AS reward_raw FROM rw),
rc AS (SELECT *, least(greatest(reward_raw, -1e1), 1e1) AS reward_clipped FROM rr)"""


def start():
    return F.lit(START)


@query("comfort", f"WITH {EVENTS} SELECT episode_ord, frame_id, {Q.r6('jerk', 'jerk')}, {Q.r6('steer_change', 'steer_change')} FROM evs")
def _(spark, sf):
    return M.comfort(frames(spark, sf), 0.1).select(*KEY, r6("jerk"), r6("steer_change"))


@query("progress_delta", f"WITH {EVENTS} SELECT episode_ord, frame_id, route_progress_delta FROM evs")
def _(spark, sf):
    return M.progress_delta(frames(spark, sf), start()).select(*KEY, "route_progress_delta")


@query(
    "goal_progress",
    f"WITH {Q.FRAMES} SELECT episode_ord, frame_id, greatest(0e0, first_value(goal_dist_m) OVER (PARTITION BY episode_ord ORDER BY frame_id) - goal_dist_m) AS route_progress_m FROM frames",
)
def _(spark, sf):
    return M.goal_progress(frames(spark, sf)).select(*KEY, "route_progress_m")


@query("counter_increased", f"WITH {EVENTS} SELECT episode_ord, frame_id, collision_flag FROM evs")
def _(spark, sf):
    return M.counter_increased(frames(spark, sf), "collisions_cum", "collision_flag").select(*KEY, "collision_flag")


@query("offroad_flag", f"WITH {EVENTS} SELECT episode_ord, frame_id, offroad_flag FROM evs")
def _(spark, sf):
    return frames(spark, sf).select(*KEY, R.offroad_flag().alias("offroad_flag"))


PARTS = [f"reward_{c}" for c in ("progress", "collision", "offroad", "violation", "comfort", "completion", "raw", "clipped")]


@query("rewards", f"WITH {REWARDS} SELECT episode_ord, frame_id, {', '.join(Q.r6(c, c) for c in PARTS)} FROM rc")
def _(spark, sf):
    steps = R.tick_events(frames(spark, sf), 0.1, start())
    return R.rewards(steps).select(*KEY, *[r6(c) for c in PARTS])


@query(
    "cut_at_terminal",
    f"""WITH {EVENTS}, ev1 AS (SELECT *, CASE WHEN collision_flag THEN 'collision' WHEN route_completed THEN 'goal' END AS ev FROM evs),
fi AS (SELECT *, min(CASE WHEN ev IS NOT NULL THEN frame_id END) OVER (PARTITION BY episode_ord) AS f,
         arg_min(ev, CASE WHEN ev IS NOT NULL THEN frame_id END) OVER (PARTITION BY episode_ord) AS why FROM ev1)
SELECT episode_ord, frame_id, coalesce(why, 'none') AS termination FROM fi WHERE f IS NULL OR frame_id <= f""",
)
def _(spark, sf):
    steps = R.tick_events(frames(spark, sf), 0.1, start())
    return cut_at_terminal(steps, offroad=False).select(*KEY, "termination")


NORMAL = """,
sel AS (SELECT *, CASE WHEN recording THEN reward_clipped END AS gx FROM {source}),
st AS (SELECT *, avg(gx) OVER w AS m, stddev_pop(gx) OVER w AS s FROM sel WINDOW w AS (ORDER BY run_tick ROWS UNBOUNDED PRECEDING)),
nz AS (SELECT *, CASE WHEN recording THEN m ELSE 0e0 END AS reward_mean, CASE WHEN recording THEN s ELSE 0e0 END AS reward_std,
         CASE WHEN NOT recording THEN reward_clipped WHEN s > 1e-6 THEN (reward_clipped - m) / s ELSE 0e0 END AS reward_normalized FROM st)"""


@query(
    "running_normalise",
    f"WITH {REWARDS},{Q.gate(source='rc')}" + NORMAL.format(source="gated")
    + f" SELECT run_tick, {Q.r6('reward_mean', 'reward_mean')}, {Q.r6('reward_std', 'reward_std')}, {Q.r6('reward_normalized', 'reward_normalized', 5)} FROM nz",
)
def _(spark, sf):
    scored = R.rewards(R.tick_events(mark_gate(frames(spark, sf), rows=ticks_in(spark, sf)), 0.1, start(), rows=ticks_in(spark, sf)))
    out = R.running_normalise(scored, width=1024)
    return out.select("run_tick", r6("reward_mean"), r6("reward_std"), r6("reward_normalized", digits=5))


@query(
    "rl_labels",
    f"""WITH {REWARDS},{Q.gate(source='rc')},
tf AS (SELECT *, min(CASE WHEN collision_flag OR route_completed THEN frame_id END) OVER (PARTITION BY episode_ord) AS f FROM gated),
cut AS (SELECT * FROM tf WHERE f IS NULL OR frame_id <= f)""" + NORMAL.format(source="cut") + f""",
kp AS (SELECT *, frame_id = max(frame_id) OVER (PARTITION BY episode_ord) AS done FROM nz WHERE recording)
SELECT episode_ord, frame_id, {Q.r6('reward_normalized', 'reward_normalized', 5)}, {Q.r6('reward_mean', 'reward_mean')},
  {Q.r6('reward_std', 'reward_std')}, steer_norm AS action_steer, throttle AS action_throttle, brake AS action_brake,
  route_progress_delta, done, CASE WHEN done THEN 0e0 ELSE 1e0 END AS discount FROM kp""",
)
def _(spark, sf):
    out = R.rl_labels(frames(spark, sf), 0.1, termination={"offroad": False}, start=start())
    return out.select(
        *KEY, r6("reward_normalized", digits=5), r6("reward_mean"), r6("reward_std"),
        "action_steer", "action_throttle", "action_brake", "route_progress_delta", "done", "discount",
    )


# --- ticks with the gaps that the control check leaves, and small segments, so that borders matter ---
NARROW = 64
GAPPED = Q.FRAMES + """,
thin AS (SELECT * FROM frames WHERE NOT (speed_mps > 5e-1 AND brake > 5e-1 AND throttle > 2e-1))"""
GAPPED_EVENTS = GAPPED + EVENTS.removeprefix(Q.FRAMES).replace("FROM frames WINDOW", "FROM thin WINDOW")
#: The test events hold a collision or an off-road lane every few ticks, so that no episode would outlast its gate and one horizon.  Here
#: every eighth collision is one, and the vehicle is off the road at every 331st tick of the run.
RARE_EVENTS = GAPPED_EVENTS.replace("collisions_cum > pc AS collision_flag", "collisions_cum // 8 > pc // 8 AS collision_flag").replace(
    "coalesce(lane_type <> 1, true) AS offroad_flag", "run_tick % 331 = 0 AS offroad_flag"
)


def gapped(spark, sf_dir):
    """Frames after the control check."""
    return GA.drop_action_mismatch(frames(spark, sf_dir))


def rare(df):
    """The same ticks with fewer collisions and other lane types, see RARE_EVENTS."""
    lane = F.when(F.col("run_tick") % 331 == 0, 2).otherwise(1)
    return df.withColumns({"collisions_cum": F.expr("collisions_cum div 8"), "lane_type": lane})


@query("comfort_gapped", f"WITH {GAPPED_EVENTS} SELECT episode_ord, frame_id, {Q.r6('jerk', 'jerk')}, {Q.r6('steer_change', 'steer_change')} FROM evs")
def _(spark, sf):
    return M.comfort(gapped(spark, sf), 0.1, width=NARROW).select(*KEY, r6("jerk"), r6("steer_change"))


@query("progress_delta_gapped", f"WITH {GAPPED_EVENTS} SELECT episode_ord, frame_id, route_progress_delta FROM evs")
def _(spark, sf):
    return M.progress_delta(gapped(spark, sf), start(), width=NARROW).select(*KEY, "route_progress_delta")


@query("counter_increased_gapped", f"WITH {GAPPED_EVENTS} SELECT episode_ord, frame_id, collision_flag FROM evs")
def _(spark, sf):
    return M.counter_increased(gapped(spark, sf), "collisions_cum", "collision_flag", width=NARROW).select(*KEY, "collision_flag")


@query("recording_gate_gapped", f"WITH {GAPPED},{Q.gate(source='thin')} SELECT episode_ord, frame_id FROM gated WHERE recording")
def _(spark, sf):
    return GA.recording_gate(gapped(spark, sf), width=NARROW, gaps=True).select(*KEY)


@query(
    "cut_at_terminal_gapped",
    f"""WITH {RARE_EVENTS}, ev1 AS (SELECT *, CASE WHEN collision_flag THEN 'collision' WHEN offroad_flag THEN 'offroad' WHEN route_completed THEN 'goal' END AS ev FROM evs),
fi AS (SELECT *, min(CASE WHEN ev IS NOT NULL THEN frame_id END) OVER (PARTITION BY episode_ord) AS f,
         arg_min(ev, CASE WHEN ev IS NOT NULL THEN frame_id END) OVER (PARTITION BY episode_ord) AS why FROM ev1)
SELECT episode_ord, frame_id, coalesce(why, 'none') AS termination, frame_id = max(frame_id) OVER (PARTITION BY episode_ord) AS done FROM fi WHERE f IS NULL OR frame_id <= f""",
)
def _(spark, sf):
    """Collision, leaving the road and the goal all end an episode."""
    steps = R.tick_events(rare(gapped(spark, sf)), 0.1, start(), width=NARROW)
    return GA.mark_terminal(cut_at_terminal(steps, width=NARROW), width=NARROW).select(*KEY, "termination", "done")


STOP = "EXISTS (SELECT 1 FROM lights l WHERE l.tick = run_tick AND stop_x BETWEEN 0 AND 8 AND abs(stop_y) <= 8 AND state IN (0, 1))"


@query(
    "rl_labels_complete",
    f"""WITH {Q.LIGHTS},{RARE_EVENTS}""".replace("lane_events_cum > pe AS lane_flag", f"(lane_events_cum > pe OR {STOP}) AS lane_flag")
    + REWARDS.removeprefix(EVENTS)
    + f""",{Q.gate(source='rc')},
tf AS (SELECT *, min(CASE WHEN collision_flag OR offroad_flag OR route_completed THEN frame_id END) OVER (PARTITION BY episode_ord) AS f FROM gated),
cut AS (SELECT * FROM tf WHERE f IS NULL OR frame_id <= f)"""
    + NORMAL.format(source="cut")
    + f""",
kp0 AS (SELECT * FROM nz WHERE recording),{Q.futures(12, 200_000, source='kp0', bases='true')},
fu AS (SELECT episode_ord, frame_id, sum(f_x) AS xs FROM fut GROUP BY ALL HAVING count(*) = 12),
kp AS (SELECT kp0.*, frame_id = max(frame_id) OVER (PARTITION BY episode_ord) AS done FROM kp0 SEMI JOIN fu USING (episode_ord, frame_id))
SELECT episode_ord, frame_id, {Q.r6('reward_normalized', 'reward_normalized', 5)}, reward_violation, reward_offroad, reward_collision,
  route_progress_delta, done, CASE WHEN done THEN 0e0 ELSE 1e0 END AS discount FROM kp""",
)
def _(spark, sf):
    """Lights and lane events, every termination, full horizons, and the terminal mark on what is left, over all ticks."""
    lit = J.traffic_violation(rare(gapped(spark, sf)).withColumn("tick", F.col("run_tick")), lights(spark, sf))
    out = R.rl_labels(lit, 0.1, start=start(), horizon=(12, 200_000), width=NARROW, gaps=True)
    return out.select(*KEY, r6("reward_normalized", digits=5), "reward_violation", "reward_offroad", "reward_collision", "route_progress_delta", "done", "discount")
