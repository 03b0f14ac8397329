"""Edge cases on hand-made rows, and comparisons with straightforward loops."""

import bisect
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayframe.functions import geometry as G
from wayframe.functions import normalise as N
from wayframe.operators import futures as FU
from wayframe.operators import gates as GA
from wayframe.operators import quality as QU
from wayframe.operators import raster as R
from wayframe.operators import reports as RP
from wayframe.operators import rewards as RW
from wayframe.operators import route as RO
from wayframe.operators import sampling as SA
from wayframe.operators import sharding as SH


def one(df):
    return df.collect()[0]


# --- expressions ---


def test_angles_on_the_border(spark):
    r = one(spark.range(1).select(
        G.wrap_pi(F.lit(math.pi)).alias("a"), G.wrap_pi(F.lit(-math.pi)).alias("b"), G.wrap_pi(F.lit(3 * math.pi)).alias("c"),
        G.wrap_deg(F.lit(180.0)).alias("d"), G.wrap_deg(F.lit(-180.0)).alias("e"), G.wrap_deg(F.lit(-190.0)).alias("f"),
    ))
    assert r["a"] == math.pi and r["b"] == -math.pi
    assert abs(abs(r["c"]) - math.pi) < 1e-9
    assert (r["d"], r["e"], r["f"]) == (-180.0, -180.0, 170.0)


def test_commands(spark):
    r = one(spark.range(1).select(
        G.encode_command(F.lit("RoadOption.Left")).alias("a"), G.encode_command(F.lit("Void")).alias("b"),
        G.command_label(F.lit(9)).alias("c"), G.command_text(F.lit(9)).alias("d"), G.command_text(F.lit(3)).alias("e"),
        G.command_from_path(F.lit(1.0), F.lit(1.0), F.lit(1)).alias("f"), G.command_from_path(F.lit(20.0), F.lit(3.0), F.lit(2)).alias("g"),
    ))
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 0, "Unknown(9)", "Unknown(9)")
    assert r["e"] == "Proceed straight through intersection"
    assert r["f"] is None and r["g"] == 4


def test_zero_route_is_padding(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [0.05, 0.04], [0.1, 0.1]],)], "route array<array<double>>")
    assert one(df.select(N.route_mask(N.normalize_route("route")).alias("m")))["m"] == [False, False, True]


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0, 2.0, 3.0, 4.0],)], "a array<double>")
    got = [tuple(r) for r in df.select(N.pad_to("a", 3, F.lit(0.0)), N.pad_mask("a", 3)).collect()]
    assert got == [([1.0, 2.0, 0.0], [1.0, 1.0, 0.0]), ([0.0] * 3, [0.0] * 3), ([1.0, 2.0, 3.0], [1.0] * 3)]


# --- gates and cuts ---


def episode(spark, speeds, **columns):
    rows = [("r", 0, i, float(s), *[c[i] for c in columns.values()]) for i, s in enumerate(speeds)]
    types = "".join(f", {n} {'boolean' if isinstance(c[0], bool) else 'double'}" for n, c in columns.items())
    return spark.createDataFrame(rows, "run_id string, episode_ord int, frame_id bigint, speed_mps double" + types)


@pytest.mark.parametrize("width", [16, 65_536])
def test_gate_needs_a_whole_run(spark, width):
    df = episode(spark, [2] * 14 + [0.5] + [1.0] * 16)
    assert [r["frame_id"] for r in GA.recording_gate(df, width=width).orderBy("frame_id").collect()] == [29, 30]
    assert GA.recording_gate(episode(spark, [2] * 14 + [0] + [2] * 14), width=width).count() == 0


def test_terminal_on_the_first_row(spark):
    df = episode(spark, [1, 1, 1], collision_flag=[True, False, True], offroad_flag=[True, False, False], route_completed=[False, False, True])
    got = GA.cut_at_terminal(df).collect()
    assert [(r["frame_id"], r["termination"]) for r in got] == [(0, "collision")]
    no_crash = GA.cut_at_terminal(df, collision=False, offroad=False).orderBy("frame_id").collect()
    assert [r["frame_id"] for r in no_crash] == [0, 1, 2] and no_crash[0]["termination"] == "goal"


@pytest.mark.parametrize("width", [6, 65_536])
def test_thinning_counts_standstill_positions(spark, width):
    still = [True] * 8 + [False] + [True] * 3
    rows = [("r", 0, i, s, False) for i, s in enumerate(still)]
    df = spark.createDataFrame(rows, "run_id string, episode_ord int, idx bigint, stationary boolean, near_light boolean")
    got = GA.thin_stationary(df, ratio=1.1, key=["idx"], width=width).orderBy("idx").collect()
    assert [r["keep"] for r in got] == [True] * 5 + [False] * 3 + [True] * 4


def test_empty_episode_takes_no_number(spark):
    df = spark.createDataFrame([("r", e) for e in (0, 0, 2, 3, 5, 7, 9)], "run_id string, episode_ord int")
    got = {r["episode_ord"]: (r["set_idx"], r["episode_id"]) for r in SH.assign_episode_sets(df).collect()}
    assert got == {0: (1, 0), 2: (1, 1), 3: (1, 2), 5: (1, 3), 7: (1, 4), 9: (2, 0)}


# --- futures ---


def naive_futures(times, n, step):
    out = []
    for base in times:
        if base + n * step > times[-1]:
            out.append(None)
            continue
        last, got = -1, []
        for k in range(1, n + 1):
            i = max(bisect.bisect_left(times, base + k * step), last + 1)
            if i >= len(times):
                break
            got.append(times[i])
            last = i
        out.append(got)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=2, max_size=60), st.integers(1, 5), st.integers(1, 15), st.integers(1, 4))
def test_futures_match_a_walk(spark, gaps, n, step, stretch):
    times = [sum(gaps[: i + 1]) for i in range(len(gaps))]
    df = spark.createDataFrame([("r", 0, i, t, 0.0, 0.0, 1.0) for i, t in enumerate(times)],
                               "run_id string, episode_ord int, frame_id bigint, t_us bigint, x_m double, y_m double, speed_mps double")
    out = FU.future_samples(df, n, step, tail=None, bucket_us=n * step * stretch).orderBy("frame_id").collect()
    assert [r["samples"] and [s["t_us"] for s in r["samples"]] if r["samples"] is not None else None for r in out] == naive_futures(times, n, step)


def test_hot_episode_is_split(spark):
    """A long episode among short ones: every bucket stays small, results are those of the walk."""
    r = random.Random(3)
    t, rows = 0, []
    for i in range(3000):
        t += r.choice([1, 1, 2, 30])
        rows.append(("r", 0, i, t, 0.0, 0.0, 1.0))
    rows += [("r", 1, i, i * 10, 0.0, 0.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "run_id string, episode_ord int, frame_id bigint, t_us bigint, x_m double, y_m double, speed_mps double")
    out = FU.future_samples(df, 6, 5, tail=None, bucket_us=60).where("episode_ord = 0").orderBy("frame_id").collect()
    want = naive_futures([x[3] for x in rows[:3000]], 6, 5)
    assert [None if o["samples"] is None else [s["t_us"] for s in o["samples"]] for o in out] == want


TICK = "run_id string, episode_ord int, frame_id bigint, t_us bigint, x_m double, y_m double, speed_mps double"


def test_very_many_ticks_at_one_time(spark):
    """A million ticks of one time in one bucket: none is collected, and all have the samples that follow."""
    at_once = spark.range(1_000_000).select(F.lit("r").alias("run_id"), F.lit(0).alias("episode_ord"), F.col("id").alias("frame_id"), F.lit(0).cast("bigint").alias("t_us"), *[F.lit(0.0).alias(c) for c in ("x_m", "y_m", "speed_mps")])
    later = spark.createDataFrame([("r", 0, 1_000_000 + i, 10 * i, float(i), 0.0, 0.0) for i in range(1, 6)], TICK)
    out = FU.future_samples(at_once.unionByName(later), 3, 10, tail=None)
    got = out.where("frame_id < 1000000").groupBy(F.transform("samples", lambda s: s["x_m"]).alias("x")).count().collect()
    assert [(r["x"], r["count"]) for r in got] == [([1.0, 2.0, 3.0], 1_000_000)]


def test_equal_times_are_taken_one_after_the_other(spark):
    times = [0, 0, 0, 5, 5, 5, 5, 9, 20, 20, 21, 40]
    df = spark.createDataFrame([("r", 0, i, t, float(i), 0.0, 0.0) for i, t in enumerate(times)], TICK)
    out = FU.future_samples(df, 4, 2, tail=None, bucket_us=8).orderBy("frame_id").collect()
    assert [o["samples"] and [s["t_us"] for s in o["samples"]] if o["samples"] is not None else None for o in out] == naive_futures(times, 4, 2)
    for o, base in zip(out, times):
        places = [int(s["x_m"]) for s in o["samples"] or []]
        assert places == sorted(set(places)) and all(times[p] == s["t_us"] for p, s in zip(places, o["samples"] or []))


def test_samples_are_never_collected(spark):
    df = spark.createDataFrame([("r", 0, i, i * 10, 0.0, 0.0, 0.0) for i in range(50)], TICK)
    plan = FU.future_samples(df, 3, 10, tail=None)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the samples that the rule of progress moves on, and one on either side of their join; the rest reads what was written
    assert plan.count("Exchange ") <= 5 and "Window" not in plan


# --- numbering by ranges ---


def test_numbers_of_a_hot_and_sparse_first_key(spark):
    from wayframe.plans.ranges import number_rows

    rows = [("hot", 10**12 + i * 10**6, i) for i in range(3000)] + [(f"f{i}", -i, i) for i in range(50)] + [(None, None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, k bigint, v int").repartition(7).withColumn("idx", F.lit("old"))
    got = number_rows(df, ["file", "k", "v"]).collect()
    order = sorted(got, key=lambda r: (r["file"] is not None, r["file"] or "", r["k"] is not None, r["k"] or 0, r["v"]))
    assert [r["idx"] for r in order] == list(range(len(rows)))
    per = number_rows(df, ["k", "v"], keys=["file"])
    assert sorted(r["idx"] for r in per.where("file = 'hot'").collect()) == list(range(3000))
    assert sorted(r["idx"] for r in per.where("file IS NULL").collect()) == list(range(5))
    assert {r["idx"] for r in per.where("file LIKE 'f%'").collect()} == {0}
    assert number_rows(df.where("false"), ["k"]).count() == 0


def test_shards_are_cut_in_order(spark):
    from wayframe.operators.sharding import index_and_shard

    df = spark.createDataFrame([("a" if i % 3 else "b", (i * 7919) % 1000) for i in range(1000)], "file string, k int")
    got = index_and_shard(df, ["k"], 64).orderBy("sample_idx").collect()
    assert [(r["file"], r["k"]) for r in got] == sorted((r["file"], r["k"]) for r in got)
    assert [r["sample_idx"] for r in got] == list(range(1000)) and all(r["shard_idx"] == r["sample_idx"] // 64 for r in got)


# --- checks ---


def test_not_finite(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")], float("inf")), (2, [0.0], 1.0)], "k int, a array<double>, b double")
    got = {tuple(r) for r in QU.check_finite(df, "k", ["a", "b"]).collect()}
    assert got == {(1, "a", 1), (1, "b", 0)}


def test_fields(spark):
    df = spark.createDataFrame([(1, None)], "frame_id int, route array<double>")
    got = {(r["field"], r["problem"], r["rows"]) for r in QU.check_fields(df, "bc").collect()}
    assert ("route", "null", 1) in got and ("bev", "absent", 0) in got and len(got) == 9
    assert len(QU.check_fields(df, "rl").collect()) == 27


# --- rewards ---


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_statistics(spark, width):
    xs = [1e6 + v for v in (1.0, 2.0, 4.0, 4.0, -3.0, 0.5, 9.0)]
    gate = [False, True, True, False, True, True, True]
    df = spark.createDataFrame([("r", i, x, g) for i, (x, g) in enumerate(zip(xs, gate))], "run_id string, run_tick bigint, x double, g boolean")
    got = RW.running_normalise(df, "x", gate="g", width=width).orderBy("run_tick").collect()
    n = mean = m2 = 0.0
    for row, x, g in zip(got, xs, gate):
        if not g:
            assert (row["reward_mean"], row["reward_std"], row["reward_normalized"]) == (0.0, 0.0, x)
            continue
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
        std = math.sqrt(m2 / n)
        assert abs(row["reward_mean"] - mean) < 1e-6 and abs(row["reward_std"] - std) < 1e-6
        assert abs(row["reward_normalized"] - ((x - mean) / std if std > 1e-6 else 0.0)) < 1e-5


# --- routes and rasters ---


def test_resampling_restarts_after_each_kept_point(spark):
    r = random.Random(9)
    rows, want = [], {}
    for route in range(20):
        pts = [(r.uniform(0, 3) * i, r.uniform(-1, 1)) for i in range(r.randrange(1, 25))]
        rows += [(route, i, x, y) for i, (x, y) in enumerate(pts)]
        kept, run = [pts[0]], 0.0
        for (ax, ay), (bx, by) in zip(pts, pts[1:]):
            run += math.hypot(bx - ax, by - ay)
            if run >= 2.0:
                kept.append((bx, by))
                run = 0.0
                if len(kept) >= 6:
                    break
        want[route] = kept
    df = spark.createDataFrame(rows, "route_id int, idx int, x double, y double")
    got = {}
    for row in RO.resample_polyline(df, k=6).orderBy("route_id", "idx").collect():
        got.setdefault(row["route_id"], []).append((row["x"], row["y"]))
    assert got == want


def fold_kept(pts, k, spacing):
    kept, run = [pts[0]], 0
    for (ax, ay), (bx, by) in zip(pts, pts[1:]):
        run += round(math.hypot(bx - ax, by - ay) * 1e9)
        if len(kept) < k and run >= round(spacing * 1e9):
            kept.append((bx, by))
            run = 0
    return kept


@pytest.mark.parametrize(("k", "width"), [(1, 7), (2, 7), (32, 4), (32, 65_536)])
def test_resampling_equals_the_fold_across_segments(spark, k, width):
    """Standing still, jumps over several stretches, routes of one point, gaps in the numbers."""
    r = random.Random(k * width)
    rows, want = [], {}
    for route in range(25):
        x, y, pts = 0.0, 0.0, []
        for i in range(r.choice([1, 2, 30, 200])):
            pts.append((x, y))
            step = r.choice([0.0, 0.0, 0.1, 0.5, 1.0, 2.0, 3.7, 40.0])
            a = r.uniform(0, 6.28)
            x, y = x + step * math.cos(a), y + step * math.sin(a)
        rows += [(route, i * 3 + route, *p) for i, p in enumerate(pts)]
        want[route] = fold_kept(pts, k, 2.0)
    r.shuffle(rows)
    got = {}
    for row in RO.resample_polyline(spark.createDataFrame(rows, "route_id int, idx int, x double, y double"), k=k, width=width).orderBy("route_id", "idx").collect():
        assert row["idx"] == len(got.setdefault(row["route_id"], []))
        got[row["route_id"]].append((row["x"], row["y"]))
    assert got == want


def test_resampling_broadcasts_no_points(spark, monkeypatch):
    """Written points are small files of many rows: the driver must hold none of them."""
    from wayframe.operators import futures as FU

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (RO, FU):
        monkeypatch.setattr(module, "settle", lambda df, *a, f=module.settle: f(seen(df), *a))
    df = spark.range(400).selectExpr("id div 20 AS route_id", "int(id % 20) AS idx", "id % 20 * 1.5D AS x", "0D AS y")
    out = seen(RO.resample_polyline(df, k=8))
    assert out.count() == 20 * 8
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def paint(points, thickness, grid):
    """Cell by cell, on a dense set."""
    h, w, out = grid.height, grid.width, set()

    def stamp(r, c, rad):
        out.update((i, j) for i in range(r - rad, r + rad + 1) for j in range(c - rad, c + rad + 1) if 0 <= i < h and 0 <= j < w)

    rc = [(round(h // 2 - x / grid.resolution), round(w // 2 + y / grid.resolution)) for x, y in points]
    if len(rc) < 2:
        for r, c in rc:
            stamp(r, c, thickness - 1)
    for (r0, c0), (r1, c1) in zip(rc, rc[1:]):
        steps = max(abs(r1 - r0), abs(c1 - c0), 1)
        for k in range(steps + 1):
            r, c = round(r0 + (r1 - r0) * (k / steps)), round(c0 + (c1 - c0) * (k / steps))
            if 0 <= r < h and 0 <= c < w:
                stamp(r, c, thickness - 1)
    return out


def test_polylines_match_a_painter(spark):
    grid = R.Grid(meters_x=20.0, meters_y=14.0, resolution=0.5)
    r = random.Random(1)
    lines = [[(r.uniform(-12, 12), r.uniform(-15, 15)) for _ in range(r.randrange(0, 6))] for _ in range(40)]
    lines += [[(100.0, 0.0)], [(0.0, 0.0)], [(7.4, 0.0)], [(50.0, 1.0), (60.0, 2.0)], [(-40.0, -40.0), (40.0, 40.0)]]
    df = spark.createDataFrame([(i, [tuple(p) for p in pts]) for i, pts in enumerate(lines)], "i int, p array<struct<x:double,y:double>>")
    for thickness in (1, 2, 5):
        for row in df.select("i", R.draw_polyline("p", thickness, grid).alias("c")).collect():
            cells = [(c // grid.width, c % grid.width) for c in row["c"]]
            assert len(cells) == len(set(cells))
            assert set(cells) == paint(lines[row["i"]], thickness, grid)


def test_point_far_outside_paints_nothing(spark):
    df = spark.createDataFrame([(1, 100.0, 0.0, 0)], "tick int, stop_x double, stop_y double, state int")
    assert R.rasterize(["tick"], lights=df).count() == 0


def test_layers_are_computed_once(spark):
    """A layer's input is written once and then only read; two shuffles place its rows, and cells of crowded frames take one more."""
    lights = spark.createDataFrame([(1, 100.0, 0.0, 0)], "tick int, stop_x double, stop_y double, state int").repartition(3)
    tokens = spark.createDataFrame([(1, 0.0, 0.0, 0, 30.0, -1.0)], "tick int, x_ego double, y_ego double, type_id int, vx double, vy double").repartition(3)
    plan = R.rasterize(["tick"], lights=lights, tokens=tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and plan.count("FileScan") == 8
    assert plan.count("Exchange ") <= 14


def test_tasks_of_a_raster_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS_PER_TASK", 1000)
    lights = spark.range(400).select((F.col("id") % 100).alias("tick"), F.lit(0.0).alias("stop_x"), F.lit(0.0).alias("stop_y"), F.lit(0).alias("state"))
    for crowded, tasks in ((2000, 20), (3, 20)):  # fifty cells a light; by frame, or every light on its own
        monkeypatch.setattr(R, "CROWDED", crowded)
        cells = R.rasterize(["tick"], lights=lights)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan or f"RoundRobinPartitioning({tasks}), REPARTITION_BY_NUM" in plan
        assert cells.count() == 2 * 25 * 100


def test_velocities_add_up_and_are_clipped(spark):
    rows = [(1, 0.0, 0.0, 0, 30.0, -1.0), (1, 0.0, 0.0, 1, 30.0, 2.0)]
    df = spark.createDataFrame(rows, "tick int, x_ego double, y_ego double, type_id int, vx double, vy double")
    got = {r["channel"]: r["value"] for r in R.rasterize(["tick"], tokens=df).where("channel >= 15").collect()}
    assert got == {15: 40.0, 16: 1.0}


def test_channel_stats_count_the_empty_cells(spark):
    grid = R.Grid(meters_x=2.0, meters_y=1.0, resolution=1.0)
    df = spark.createDataFrame([(1, 15, 0, 0, -4.0)], "tick int, channel int, row int, col int, value double")
    r = one(R.channel_stats(df, ["tick"], grid).where("channel = 15"))
    assert (r["min"], r["max"], r["mean"]) == (-4.0, 0.0, -2.0)
    assert R.channel_stats(df, ["tick"], grid).count() == 18


# --- sampling ---


def test_one_shard_has_no_validation_part(spark):
    df = spark.range(5).select(F.col("id").alias("sample_idx"), F.lit(0).alias("shard_idx"))
    assert SA.split_by_shard(df, "train").count() == 5
    for bad in (lambda: SA.split_by_shard(df, "val"), lambda: SA.split_by_shard(df.where("false"), "train"), lambda: SA.split_by_shard(df.where("false"), "all")):
        with pytest.raises(Exception, match="holds no samples"):
            bad().collect()


def test_shuffle_is_a_permutation_and_sorts_as_ranked(spark):
    df = spark.range(500).select(F.col("id").alias("sample_idx"), F.expr("id div 50").alias("shard_idx"))
    ranked = [r["sample_idx"] for r in SA.shuffle_rank(df, 4).orderBy("position").collect()]
    assert sorted(ranked) == list(range(500)) and ranked != list(range(500))
    assert ranked == [r["sample_idx"] for r in SA.shuffle(df, 4).collect()]
    assert ranked != [r["sample_idx"] for r in SA.shuffle_rank(df, 5).orderBy("position").collect()]


def test_draws_look_random(spark):
    from wayframe.functions import hashing as H

    r = one(spark.range(20_000).select(H.uniform("id", 1).alias("u"), H.uniform("id", 2).alias("v"), H.normal("id", 3).alias("n")).agg(
        F.avg("u").alias("mu"), F.corr("u", "v").alias("c"), F.avg("n").alias("mn"), F.stddev("n").alias("sn"), F.kurtosis("n").alias("k")))
    assert abs(r["mu"] - 0.5) < 0.01 and abs(r["c"]) < 0.03
    assert abs(r["mn"]) < 0.03 and abs(r["sn"] - 1) < 0.03 and abs(r["k"]) < 0.2


def test_draws_use_the_whole_key(spark):
    """Neither two episodes nor samples whose numbers agree in their low bits share their draws."""
    from wayframe.functions import hashing as H

    df = spark.createDataFrame([(e, f, 0.1, 0.5, 0.0) for e in (1, 2) for f in range(200)], "episode_ord int, frame_id int, steer_norm double, throttle double, brake double").withColumn("run_id", F.lit("r"))
    hit = {(r["episode_ord"], r["frame_id"]): r["noise_injected"] for r in SA.inject_noise(df, 3).collect()}
    assert [hit[1, f] for f in range(200)] != [hit[2, f] for f in range(200)]
    far = one(spark.range(1).select(*[H.hash_int([F.lit(k), F.lit(e)]).alias(f"d{k}_{e}") for k in (5, 5 + 2**26, 5 + 2**32) for e in (0, 1)]))
    assert len(set(far)) == 6


def test_null_parts_of_a_key_keep_their_place(spark):
    from wayframe.functions import hashing as H

    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert len({r["h"] for r in df.select(H.hash_int(["a", "b"], 3).alias("h")).collect()}) == 2


def test_conversion_check_sees_every_difference(spark):
    from wayframe.operators.sharding import verify_conversion

    kinds = "sample_idx int, n int, x double, route array<array<double>>"
    a = [(1, 1, 1.0, [[1.0, 2.0]]), (2, None, None, None), (3, 1, float("nan"), [[None, 2.0]]), (4, 1, 1.0, [[1.0], [2.0]]), (6, 2, 1.0, [])]
    b = [(1, 1, 1.0 + 1e-7, [[1.0, 2.0]]), (2, 5, 1.0, [[1.0]]), (3, 1, 1.0, [[1.0, 2.0]]), (4, 1, 1.0, [[1.0], [2.0, 3.0]]), (5, 1, 1.0, None)]
    got = verify_conversion(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), ["n", "x", "route"]).collect()
    assert sorted(map(tuple, got)) == [
        (2, "n", "extra"), (2, "route", "extra"), (2, "x", "extra"), (3, "route", "value"), (3, "x", "value"), (4, "route", "shape"), (5, "*", "extra"), (6, "*", "missing")]


def test_object_width_counts_null_objects(spark):
    from wayframe.operators.quality import check_object_width

    df = spark.createDataFrame([(1, [[1.0] * 11]), (2, [None]), (3, [[1.0] * 10])], "i int, objects array<array<double>>")
    assert sorted(r["i"] for r in check_object_width(df).collect()) == [2, 3]


def test_objects_and_raster_are_dropped_together(spark):
    df = spark.createDataFrame([(i, [[1.0] * 11], [1.0], [1]) for i in range(50)],
                               "sample_idx int, objects array<array<double>>, object_mask array<double>, bev_cells array<int>")
    got = SA.augment(df, 0, {"p_drop_objects": 0.5, "p_drop_bev": 0.5, "p_lateral_shift": 0.0}).collect()
    gone = [r["object_mask"] == [0.0] for r in got]
    assert 5 < sum(gone) < 45
    assert all((r["objects"] == [[0.0] * 11]) == g for r, g in zip(got, gone))
    assert 5 < sum(r["bev_cells"] == [] for r in got) < 45


# --- reports ---


def plain_stop(xs, patience, delta):
    best, at, stop = xs[0], 0, None
    for i, x in enumerate(xs[1:], 1):
        if x < best - delta:
            best, at = x, i
        elif i - at >= patience:
            stop = i
            break
    return stop, at, best


@pytest.mark.parametrize("width", [1, 3, 16, 65_536])
def test_early_stop_equals_the_walk(spark, width):
    """Falling scores only, falls smaller than the least gain, plateaus, short runs, gaps in the epochs."""
    r = random.Random(width)
    runs = {0: [100.0 - i for i in range(200)], 1: [1.0 - 1e-3 * i for i in range(300)], 2: [1.0], 3: [5.0] * 40, 4: [5.0 - 0.01 * (i % 7) for i in range(60)]}
    for k in range(5, 40):
        x, xs = 50.0, []
        for _ in range(r.choice([2, 10, 150])):
            x += r.choice([-3.0, -0.3, -0.05, 0.0, 0.4, 1.0]) * r.random()
            xs.append(x)
        runs[k] = xs
    rows = [(k, 5 + 3 * i, x) for k, xs in runs.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "run int, epoch int, score double")
    for patience, delta in ((1, 0.0), (4, 0.25), (12, 1.0)):
        got = {x["run"]: x for x in RP.early_stop(df, patience, delta, width=width).collect()}
        for k, xs in runs.items():
            stop, at, best = plain_stop(xs, patience, delta)
            assert (got[k]["stop_at"], got[k]["best_epoch"], got[k]["best_score"]) == (stop, 5 + 3 * at, best), (k, patience, delta)


def test_summary_of_a_segment_is_short_where_scores_fall_fast():
    import numpy as np

    n = 5000
    out = RP._entries(-np.arange(n, dtype=float), np.arange(n), np.arange(n), 10.0, 20, 0.5)
    assert len(out["_entry_x"]) == 1 and out["_last_at"] == [n - 1] and out["_stop"] == [-1]


def test_moments(spark):
    r = random.Random(4)
    arrays = [[1e8 + r.random() for _ in range(r.choice([0, 1, 3, 200]))] for _ in range(60)]
    flat = [x for a in arrays for x in a]
    df = spark.createDataFrame([(a, [[1.0, 2.0]] * 3, [[1.0], [2.0, None]], float(i)) for i, a in enumerate(arrays)], "a array<double>, b array<array<double>>, c array<array<double>>, d double")
    got = {x["field"]: x for x in RP.tensor_stats(df, ["a", "b", "c", "d"]).collect()}
    mean = math.fsum(flat) / len(flat)
    std = math.sqrt(math.fsum((x - mean) ** 2 for x in flat) / (len(flat) - 1))
    a = got["a"]
    assert (a["n"], a["min"], a["max"], a["shape"]) == (len(flat), min(flat), max(flat), None)
    assert abs(a["mean"] - mean) < 1e-6 and abs(a["std"] - std) < 1e-6
    assert (got["b"]["shape"], got["c"]["shape"], got["d"]["shape"]) == ([60, 3, 2], None, [60]) and got["c"]["n"] == 120
    holes = spark.createDataFrame([(None, None), ([1.0, 3.0], [[2.0], None])], "a array<double>, b array<array<double>>")
    assert [(x["field"], x["n"], x["mean"], x["shape"]) for x in RP.tensor_stats(holes, ["a", "b"]).orderBy("field").collect()] == [("a", 2, 2.0, None), ("b", 1, 2.0, None)]
    empty = one(RP.tensor_stats(spark.createDataFrame([([],)], "a array<double>"), ["a"]))
    assert (empty["n"], empty["mean"], empty["std"], empty["shape"]) == (0, None, None, [1, 0])


def test_stats_do_not_explode_numbers(spark):
    df = spark.createDataFrame([([1.0], 2.0)], "a array<double>, b double")
    assert "explode" not in RP.tensor_stats(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString().lower()


def test_distribution_scans_four_times(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 1.5).alias("x")).write.parquet(str(tmp_path / "x"))
    d = RP.distribution(spark.read.parquet(str(tmp_path / "x")), "x")
    assert d._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    assert one(d)["median"] == 499 * 1.5


def test_middle_of_nothing(spark):
    for df in (spark.createDataFrame([], "x double"), spark.createDataFrame([(None,)], "x double")):
        got = one(RP.middle_values(df, "x"))
        assert (got["n"], got["lower"], got["upper"]) == (0, None, None)
        assert one(RP.distribution(df, "x"))["mean"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5001])
def test_middle_values(spark, n):
    r = random.Random(n)
    xs = sorted(r.choice([1e9, r.random(), 3.0]) for _ in range(n))
    got = one(RP.middle_values(spark.createDataFrame([(x,) for x in xs], "x double"), "x"))
    assert (got["n"], got["lower"], got["upper"]) == (n, xs[(n - 1) // 2], xs[n // 2])


def test_loss_without_valid_future_is_an_error(spark):
    df = spark.createDataFrame([(0, [[0.0, 0.0]], [0.0], [[0.0, 0.0]], [0.0], [0.0])],
                               "batch int, pred_xy array<array<double>>, pred_v array<double>, future_xy array<array<double>>, future_v array<double>, future_mask array<double>")
    with pytest.raises(Exception, match="no valid entries"):
        RP.trajectory_loss(df).collect()


def test_diversity_can_fail_hard(spark):
    df = spark.range(200).select(F.lit(1.0).alias("v"), F.lit(0.0).alias("s"))
    report = RP.diversity_report(df, F.col("v"), F.col("s"))
    assert one(report)["issues"] == ["speed_std", "steer_std"]
    with pytest.raises(Exception, match="diversity"):
        RP.require_diversity(report).collect()
    few = one(RP.diversity_report(df.limit(20), F.col("v"), F.col("s")))
    assert few["few_samples"] and few["issues"] == ["speed_std", "steer_std"]


def test_reward_histogram_shows_every_filled_bin(spark):
    got = RP.reward_histogram(spark.range(20).select(F.col("id").cast("double").alias("reward_clipped"))).collect()
    assert sum(r["count"] for r in got) == 20 and max(r["bin"] for r in got) == 19
