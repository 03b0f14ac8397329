"""Segmented scans and halos give what plain windows give, for any segment width."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe.plans.segments import Running, dense_index, neighbours, scan


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    # One group holds most rows; some values are null; ticks have gaps.
    data = [(("hot" if r.random() < 0.7 else f"g{r.randrange(4)}"), i * 3 + r.randrange(3), r.choice([None, r.random() * 10 - 5])) for i in range(400)]
    return spark.createDataFrame(data, "k string, t bigint, x double").cache()


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_scan(rows, width):
    w = W.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    x = F.col("x")
    want = rows.select(
        "k", "t",
        F.round(F.coalesce(F.sum(x).over(upto), F.lit(0.0)), 6).alias("s"),
        F.max(x).over(before).alias("m"),
        F.last(x, ignorenulls=True).over(upto).alias("l"),
        F.last(x, ignorenulls=True).over(before).alias("b"),
        F.min(x).over(W.partitionBy("k")).alias("a"),
    )
    got = scan(
        rows, ["k"], "t", width,
        s=Running("sum", x), m=Running("max", x, "before"), l=Running("last", x), b=Running("last", x, "before"), a=Running("min", x, "all"),
    ).select("k", "t", F.round("s", 6).alias("s"), "m", "l", "b", "a")
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


@pytest.mark.parametrize("width", [2, 5, 1000])
@pytest.mark.parametrize("offset", [1, 2, -1])
def test_neighbours(rows, width, offset):
    n = dense_index(rows, ["k"], "t", "n", 11)
    want = n.select("k", "t", F.lag("t", offset).over(W.partitionBy("k").orderBy("n")).alias("p"))
    got = neighbours(n, ["k"], "n", offset, width, p=F.col("t")).select("k", "t", "p")
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


@pytest.mark.parametrize("width", [1, 5, 64, 10_000])
def test_previous_row_of_a_counter_with_gaps(rows, width):
    first = W.partitionBy("k").orderBy("t")
    want = rows.select("k", "t", F.lag("x").over(first).alias("p"))
    got = neighbours(rows, ["k"], "t", 1, width, p=F.col("x")).select("k", "t", "p")
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


@pytest.mark.parametrize("width", [4, 7, 1000])
def test_gate_counts_rows_where_ticks_are_missing(spark, width):
    from wayframe.operators.gates import mark_gate

    ticks = [(1, t, 2.0 if t > 9 else 0.0) for t in range(60) if t % 4 != 1]
    df = spark.createDataFrame(ticks, "episode_ord int, frame_id bigint, speed_mps double").withColumn("run_id", F.lit("r"))
    got = mark_gate(df, ticks=5, width=width, gaps=True).where("recording").agg(F.min("frame_id")).first()[0]
    assert got == [t for _, t, v in ticks if v][4]


def test_gate_refuses_a_counter_that_jumps(spark):
    from wayframe.operators.gates import mark_gate

    ticks = [(1, t, 2.0) for t in range(60)] + [(2, t, 2.0) for t in range(60) if t != 30]
    df = spark.createDataFrame(ticks, "episode_ord int, frame_id bigint, speed_mps double").withColumn("run_id", F.lit("r"))
    assert mark_gate(df.where("episode_ord = 1"), ticks=5, width=16).where("recording").count() == 56
    with pytest.raises(Exception, match="frame_id has gaps"):
        mark_gate(df, ticks=5, width=16).where("recording").collect()


@pytest.mark.parametrize("gap", [16, 1])
def test_tick_events_across_missing_border_ticks(spark, gap):
    """Every ``gap``-th tick is missing, with segments of 16: the previous row is the last one there is."""
    from wayframe.operators.rewards import tick_events

    rows = [("r", 1, t, float(t % 5), 0.0, 0.1 * (t % 3), 100.0 - t, t // 7, t // 9, 1) for t in range(80) if gap == 1 or t % gap]
    df = spark.createDataFrame(rows, "run_id string, episode_ord int, frame_id bigint, accel_long double, accel_lat double, steer_norm double, goal_dist_m double, collisions_cum int, lane_events_cum int, lane_type int")
    got = tick_events(df, 0.1, F.lit(1000.0), width=16).orderBy("frame_id").collect()
    for a, b in zip(rows, rows[1:]):
        r = next(x for x in got if x["frame_id"] == b[2])
        assert abs(r["jerk"] - abs(b[3] - a[3]) / 0.1) < 1e-9 and abs(r["steer_change"] - abs(b[5] - a[5])) < 1e-9
        assert r["route_progress_delta"] == a[6] - b[6] and r["collision_flag"] == (b[7] > a[7]) and r["lane_flag"] == (b[8] > a[8])


def test_no_window_over_a_whole_episode(spark):
    """Frames are never windowed by episode alone: only bucket summaries are."""
    from wayframe.operators.gates import recording_gate

    frames = spark.range(10).select(
        F.lit("r").alias("run_id"), F.lit(1).alias("episode_ord"), F.col("id").alias("frame_id"), F.lit(2.0).alias("speed_mps")
    )
    plan = recording_gate(frames)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # The only window without the segment in it accumulates the summaries (columns _s_*).
    assert windows and all("_seg" in line or "(_s_" in line for line in windows)


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    from wayframe.operators.futures import future_samples
    from wayframe.plans import segments

    assert segments.dealt(spark.range(10), ["id"]).rdd.getNumPartitions() == 8
    monkeypatch.setattr(segments, "ROWS_PER_TASK", 10)
    assert segments.dealt(spark.range(1000), ["id"], 1000).rdd.getNumPartitions() == 100
    ran, plain = [], segments.dealt
    monkeypatch.setattr("wayframe.operators.futures.dealt", lambda df, by, rows=0: ran.append(rows) or plain(df, by, rows))
    ticks = spark.range(300).select(F.lit("r").alias("run_id"), F.lit(0).alias("episode_ord"), F.col("id").alias("frame_id"), (F.col("id") * 10).alias("t_us"), *[F.lit(0.0).alias(c) for c in ("x_m", "y_m", "speed_mps")])
    assert future_samples(ticks, 2, 10, tail=None).where("size(samples) = 2").count() == 298
    assert ran == [300, 300]


def test_tasks_of_shared_steps_go_by_rows(spark, monkeypatch):
    """Frames, the gate and the audit used to take as many tasks as the session shuffles with, whatever the table's size."""
    from __spark_entry__ import queries
    from wayframe.plans import segments

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(segments, "ROWS_PER_TASK", 20)
    monkeypatch.setattr("wayframe.operators.joins.ROWS_PER_TASK", 20)

    def tasks(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [int(x) for x in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan)]

    events, lines = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("events", "lineitem"))
    gate = tasks(queries()["recording_gate"](spark, sf))
    assert gate and set(gate) == {-(-events // 20)}
    assert tasks(queries()["audit_completeness"](spark, sf)) == [-(-lines // 20)]


def test_futures_are_turned_once(spark):
    """A filter on what derives from the futures used to repeat the lookups and turns."""
    from wayframe.operators import futures as FU

    samples = "array<struct<i:int,t_us:bigint,x_m:double,y_m:double,speed_mps:double>>"
    df = spark.createDataFrame([(0.0, 0.0, 90.0, [(1, 10, 1.0, 0.0, 2.0), (2, 20, 3.0, 0.0, 2.0)]), (0.0, 0.0, 0.0, None)], f"x_m double, y_m double, yaw_deg double, samples {samples}")
    out = FU.future_extrema(FU.future_waypoints(df)).where("size(futures) = 2 AND max_step < 5 AND max_speed < 9")
    assert not any("samples" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)
    assert [round(x["y"], 9) for x in out.first()["futures"]] == [-1.0, -3.0]
    assert FU.future_waypoints(df).count() == 2
