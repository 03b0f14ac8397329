"""Queries that run a stream over the frames and return what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.rl import NORMAL, REWARDS
from wayframe.catalog.audits import rewarded
from wayframe.catalog.views import frames, r6, ticks_in
from wayframe.operators.gates import mark_gate
from wayframe.sources.shared import fresh_dir, settle
from wayframe.streaming.common import stream_session
from wayframe.streaming.gate import stream_gate
from wayframe.streaming.labelling import stream_future_labels
from wayframe.streaming.running import stream_running_normalise

PARTS = 3


def through_stream(spark: SparkSession, rows: DataFrame, apply: Callable[[DataFrame], DataFrame], order: str = "run_tick") -> DataFrame:
    """Feed the rows to a stream in ``PARTS`` steps of the tick order, with a restart between steps."""
    root = fresh_dir(spark, "stream")
    rows.write.parquet(f"{root}/all")
    stored = spark.read.schema(rows.schema).parquet(f"{root}/all")
    ends = stored.agg(F.max(order).alias("m")).first()["m"] + 1
    own = stream_session(spark, spark.sparkContext.defaultParallelism)
    for p in range(PARTS):
        step = stored.where((F.col(order) >= ends * p // PARTS) & (F.col(order) < ends * (p + 1) // PARTS))
        step.write.mode("append").parquet(f"{root}/in")
        out = apply(own.readStream.schema(rows.schema).parquet(f"{root}/in"))
        q = (
            out.writeStream.format("parquet")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{root}/out")
        )
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(
    "stream_gate",
    f"""WITH {Q.FRAMES},{Q.gate()}, r AS (SELECT *, max(CASE WHEN NOT speed_mps < 2e-1 THEN frame_id END) OVER (PARTITION BY episode_ord ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS moved FROM gated)
SELECT episode_ord, frame_id, recording, frame_id - coalesce(moved, -1) AS standing_run FROM r""",
)
def _(spark, sf):
    rows = frames(spark, sf).select("run_id", "episode_ord", "frame_id", "run_tick", "speed_mps")
    return through_stream(spark, rows, stream_gate).select("episode_ord", "frame_id", "recording", "standing_run")


@query(
    "stream_running_normalise",
    f"WITH {REWARDS},{Q.gate(source='rc')}" + NORMAL.format(source="gated")
    + f" SELECT run_tick, {Q.r6('reward_mean', 'reward_mean')}, {Q.r6('reward_std', 'reward_std')}, {Q.r6('reward_normalized', 'reward_normalized', 5)} FROM nz",
)
def _(spark, sf):
    rows = mark_gate(settle(rewarded(spark, sf), "ticks"), rows=ticks_in(spark, sf)).select("run_id", "run_tick", "reward_clipped", "recording")
    out = through_stream(spark, rows, stream_running_normalise)
    return out.select("run_tick", r6("reward_mean"), r6("reward_std"), r6("reward_normalized", digits=5))


@query(
    "stream_future_labels",
    f"""WITH {Q.FRAMES},{Q.futures(12, 200_000)}, full_f AS (SELECT episode_ord, frame_id FROM fut GROUP BY ALL HAVING count(*) = 12)
SELECT episode_ord, frame_id, i, f_us, f_x, f_v FROM fut JOIN full_f USING (episode_ord, frame_id)""",
)
def _(spark, sf):
    rows = frames(spark, sf).select("run_id", "episode_ord", "frame_id", "run_tick", "t_us", "x_m", "y_m", "speed_mps", "is_tail")
    rows = rows.withColumn("clock_us", F.col("run_tick") * 100_000)
    out = through_stream(spark, rows, lambda ticks: stream_future_labels(ticks, clock="clock_us"))
    return out.select(
        "episode_ord", "frame_id", "i", F.col("t_us").alias("f_us"), F.col("x_m").alias("f_x"), F.col("speed_mps").alias("f_v")
    )
