"""Queries that write data and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.dataset import SETS, SHARDED, in_sets, sharded
from wayframe.catalog.registry import query
from wayframe.catalog.views import frames, r6, table
from wayframe.sources import metadata as M
from wayframe.sources import tables as T
from wayframe.sources import tarshards as TS
from wayframe.sources.shared import fresh_dir
from wayframe.schemas import table_schema


def optional() -> list[str]:
    """The test tables give some of the frame columns only.  A schema needs a session, so this is no constant."""
    return table_schema("frames").names


def frame_table(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """The frames view under the declared column names."""
    return frames(spark, sf_dir).select(
        F.lit(run).alias("run_id"),
        F.lit(1).alias("shard_id"),
        F.col("run_tick").alias("frame_id"),
        (F.col("t_us") / 1e6).alias("sim_time"),
        "speed_mps",
        "command",
        "goal_dist_m",
    )


TABLE_SUMS = """count(*) AS rows, CAST(sum(frame_id) AS BIGINT) AS ids, CAST(sum(command) AS BIGINT) AS commands, CAST(sum(goal_dist_m) AS BIGINT) AS goal"""


def table_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("frame_id").alias("ids"),
        F.sum("command").alias("commands"),
        F.sum("goal_dist_m").cast("bigint").alias("goal"),
    )


@query(
    "append_and_read_table",
    f"""WITH {Q.FRAMES}, w AS (SELECT 'run_a' AS run_id, run_tick AS frame_id, command, goal_dist_m FROM frames
  UNION ALL SELECT 'run_b', run_tick, command, goal_dist_m FROM frames WHERE command = 1
  UNION ALL SELECT 'run_b', run_tick, command, goal_dist_m FROM frames WHERE command = 2) SELECT run_id, {TABLE_SUMS} FROM w GROUP BY 1""",
)
def _(spark, sf):
    """Two runs, one of them appended to in two steps and once with nothing, read as one dataset."""
    root = fresh_dir(spark, "tables")
    T.append_table(frame_table(spark, sf, "run_a"), f"{root}/run_a", "frames", optional=optional())
    b = frame_table(spark, sf, "run_b")
    T.append_table(b.where("command = 1"), f"{root}/run_b", "frames", codec="zstd", optional=optional())
    T.append_table(b.where("command = 2"), f"{root}/run_b", "frames", codec="lzo9", optional=optional())
    T.append_table(b.where("command = 99"), f"{root}/run_b", "frames", optional=optional())
    return table_sums(T.read_table(spark, f"{root}/run_*", "frames"))


@query("save_and_export_table", f"WITH {Q.FRAMES}, w AS (SELECT 'run_a' AS run_id, run_tick AS frame_id, command, goal_dist_m FROM frames) SELECT run_id, 2 * count(*) AS rows, CAST(2 * sum(frame_id) AS BIGINT) AS ids, CAST(2 * sum(command) AS BIGINT) AS commands, CAST(2 * sum(goal_dist_m) AS BIGINT) AS goal, 2 * count(*) AS table_rows FROM w GROUP BY 1")
def _(spark, sf):
    """Insert twice into a catalog table, count it, export it, read the export."""
    root, name = fresh_dir(spark, "catalog"), f"frames_{uuid.uuid4().hex}"
    for _ in range(2):
        T.save_table(frame_table(spark, sf, "run_a"), name, "frames", f"{root}/table", optional=optional())
    T.export_table(spark, name, f"{root}/frames")
    n = T.table_count(spark, name).scalar()
    return table_sums(T.read_table(spark, root, "frames")).withColumn("table_rows", n)


@query(
    "write_shards",
    "SELECT count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS orders, true AS small_files FROM lineitem",
)
def _(spark, sf):
    path = fresh_dir(spark, "shards")
    T.write_shards(table(spark, sf, "lineitem"), path, rows_per_shard=5000)
    back = spark.read.parquet(path).select("l_orderkey", F.col("_metadata.file_path").alias("f"))
    per = back.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))
    return per.agg(F.sum("n").alias("rows"), F.sum("s").alias("orders"), (F.max("n") <= 5000).alias("small_files"))


def tar_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark, sf_dir).select(
        "sample_idx",
        "shard_idx",
        F.col("l_orderkey").alias("frame_id"),
        F.array("l_quantity", "l_tax").alias("ego_vec"),
        F.array(F.array("l_discount", "l_tax"), F.array("l_quantity", "l_discount")).alias("route"),
        (F.col("l_returnflag") == "R").alias("done"),
    )


@query(
    "write_tar_shards",
    f"WITH {SHARDED} SELECT shard_idx, min(sample_idx) AS first_sample_idx, max(sample_idx) AS last_sample_idx, count(*) AS sample_count, format('shard-{{:06d}}.tar', shard_idx) AS file FROM sharded GROUP BY 1",
)
def _(spark, sf):
    return TS.write_tar_shards(tar_samples(spark, sf), fresh_dir(spark, "tar"), ["frame_id", "ego_vec", "route", "done"])


@query(
    "read_tar_shards",
    f"""WITH {SHARDED} SELECT format('shard-{{:06d}}.tar', shard_idx) AS file, count(*) AS n, CAST(sum(sample_idx) AS BIGINT) AS ids, CAST(sum(l_orderkey) AS BIGINT) AS frames,
  {Q.r6('sum(l_quantity)', 'quantity', 3)}, {Q.r6('sum(l_discount)', 'discount', 3)}, count(*) FILTER (WHERE l_returnflag = 'R') AS done FROM sharded GROUP BY shard_idx""",
)
def _(spark, sf):
    path = fresh_dir(spark, "tar")
    TS.write_tar_shards(tar_samples(spark, sf), path, ["frame_id", "ego_vec", "route", "done"])
    back = TS.read_tar_shards(
        spark, path, {"frame_id": "bigint", "ego_vec": "array<double>", "route": "array<array<double>>", "done": "boolean"}
    )
    return back.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("sample_idx").alias("ids"),
        F.sum("frame_id").alias("frames"),
        r6(F.sum(F.col("ego_vec")[0]), "quantity", 3),
        r6(F.sum(F.col("route")[0][0]), "discount", 3),
        F.count_if("done").alias("done"),
    )


@query(
    "shard_counts",
    f"WITH {SHARDED} SELECT format('shard-{{:06d}}.tar', shard_idx) AS file, count(*) AS sample_count FROM sharded GROUP BY shard_idx",
)
def _(spark, sf):
    path = fresh_dir(spark, "tar")
    TS.write_tar_shards(tar_samples(spark, sf), path, ["frame_id"])
    return TS.shard_counts(spark, path).select("file", "sample_count")


@query(
    "dataset_metadata",
    "SELECT 32 AS K, 12 AS N_future, 64 AS M, 18 AS C, 150 AS H, 200 AS W, '2.2' AS version, 1 AS norms_version, 'run0' AS run_id, 'frame_id,ego_vec' AS fields, CAST(1000 AS BIGINT) AS samples_per_shard, count(*) AS total_samples, 'shard-%06d.tar' AS shard_pattern FROM lineitem",
)
def _(spark, sf):
    root = fresh_dir(spark, "dataset")
    M.write_metadata(M.dataset_metadata(table(spark, sf, "lineitem"), ["frame_id", "ego_vec"], "run0", version="2.2"), root)
    return M.read_metadata(spark, root).withColumn("fields", F.array_join("fields", ","))


@query(
    "run_metadata",
    f"""WITH {Q.FRAMES} SELECT run_id, count(*) AS frames, count(DISTINCT episode_ord) AS episodes, 1e-1 AS fixed_dt, 2e-1 AS future_dt, 32 AS K, 12 AS N, 64 AS M, '0.4' AS resolution FROM frames GROUP BY 1
  UNION ALL SELECT 'run1', count(*), count(DISTINCT episode_ord), 5e-2, 2e-1, 32, 12, 64, '0.5' FROM frames""",
)
def _(spark, sf):
    """Two runs' documents, one of them written twice, read back."""
    root, rows = fresh_dir(spark, "runs"), frames(spark, sf)
    M.write_run_metadata(M.run_metadata(rows, {"resolution": "0.9"}, 0.2, 0.2, episode="episode_ord"), root)
    M.write_run_metadata(M.run_metadata(rows.withColumn("run_id", F.lit("run1")), {"resolution": "0.5"}, 0.05, 0.2, episode="episode_ord"), root)
    M.write_run_metadata(M.run_metadata(rows, {"resolution": "0.4"}, 0.1, 0.2, episode="episode_ord"), root)
    return M.read_run_metadata(spark, root).withColumn("resolution", F.col("settings")["resolution"]).drop("settings")


@query(
    "dataset_summary",
    f"WITH {SHARDED} SELECT 'run0' AS run_id, count(*) AS total_samples, count(DISTINCT shard_idx) AS shards, count(*) AS samples_in_shards, true AS complete FROM sharded",
)
def _(spark, sf):
    """The dataset document beside what the shards hold; the shards are written a second time, fewer than at first."""
    root, rows = fresh_dir(spark, "dataset"), tar_samples(spark, sf)
    TS.write_tar_shards(rows.withColumn("shard_idx", F.expr("sample_idx div 500")), f"{root}/shards", ["frame_id"])
    TS.write_tar_shards(rows, f"{root}/shards", ["frame_id", "done"])
    M.write_metadata(M.dataset_metadata(rows, ["frame_id", "done"], "run0"), root)
    return M.dataset_summary(spark, root, f"{root}/shards").select("run_id", "total_samples", "shards", "samples_in_shards", "complete")


def logged(spark: SparkSession, sf_dir: str) -> str:
    """Metric lines, one in fifty of them cut short."""
    path = fresh_dir(spark, "metrics")
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("epoch"), F.col("value").alias("valid/loss"), F.col("event_type").alias("stage")
    )
    M.append_metrics(ev.where("epoch % 50 <> 7"), path)
    broken = ev.where("epoch % 50 = 7").select(F.substring(F.to_json(F.struct("*")), 1, 9).alias("value"))
    broken.write.mode("append").text(path)
    return path


METRIC_LINE = "epoch bigint, `valid/loss` double, stage string"


@query(
    "read_metrics",
    "SELECT event_id AS epoch, value AS \"valid/loss\", event_type AS stage FROM events WHERE event_id % 50 <> 7",
)
def _(spark, sf):
    return M.read_metrics(spark, logged(spark, sf), METRIC_LINE)


@query("metric_line_counts", "SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 50 = 7) AS malformed FROM events")
def _(spark, sf):
    return M.metric_line_counts(spark, logged(spark, sf), METRIC_LINE)


@query(
    "read_episode_set",
    f"""WITH {SETS} SELECT run_id, set_idx, episode_id, count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS parts FROM sets WHERE run_id = 'RF' AND set_idx = 2 GROUP BY ALL""",
)
def _(spark, sf):
    """One set of one run, out of the set layout on disk."""
    root = fresh_dir(spark, "sets")
    T.write_episode_sets(in_sets(spark, sf), root)
    one = T.read_episode_sets(spark, root).where("run_id = 'RF' AND set_idx = 2")
    return one.groupBy("run_id", "set_idx", "episode_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_partkey").alias("parts"))


@query(
    "rewrite_episode_set",
    f"""WITH {SETS} SELECT run_id, set_idx, count(*) AS rows FROM sets WHERE NOT (run_id = 'RF' AND set_idx = 2 AND episode_id = 0) GROUP BY ALL""",
)
def _(spark, sf):
    """One set is written again without its first episode; the others stay."""
    root, rows = fresh_dir(spark, "sets"), in_sets(spark, sf)
    T.write_episode_sets(rows, root)
    T.write_episode_sets(rows.where("run_id = 'RF' AND set_idx = 2 AND episode_id <> 0"), root)
    return T.read_episode_sets(spark, root).groupBy("run_id", "set_idx").agg(F.count(F.lit(1)).alias("rows"))
