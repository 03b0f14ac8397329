"""Driving-log views of the test tables, as Spark DataFrames (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.plans.segments import Running, scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison, with minus zero as zero."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def ticks_in(spark: SparkSession, sf_dir: str) -> int:
    """How many ticks frames() has; only footers are read for it."""
    return table(spark, sf_dir, "events").count()


def frames(spark: SparkSession, sf_dir: str, irregular: bool = False) -> DataFrame:
    """One row per event: 15 episodes of ticks, numbered in event order."""
    ev = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 15).cast("int").alias("episode_ord"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "ts",
    )
    e = F.col("event_id")
    is_error = F.col("event_type") == "error"
    one = F.lit(1).cast("bigint")
    ix = scan(
        ev,
        ["episode_ord"],
        "event_id",
        rows=ticks_in(spark, sf_dir),
        n=Running("sum", one, "before"),
        cnt=Running("sum", one, "all"),
        collisions_cum=Running("sum", F.when(is_error & (e % 7 == 0), 1).otherwise(0).cast("bigint")),
        lane_events_cum=Running("sum", F.when(e % 11 == 0, 1).otherwise(0).cast("bigint")),
    )
    n, kind = F.col("n"), F.col("episode_ord") % 5
    ten = n * 10
    x_dm = (
        F.when(kind == 1, F.least(n, F.lit(29)) * 10)
        .when(kind == 2, ten + F.when(is_error & (e % 3 == 0), 700).otherwise(0))
        .when(kind == 3, -ten)
        .otherwise(ten)
    )
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    t_us = micros if irregular else n * 100_000
    command = F.when(F.col("event_type") == "click", 1)
    for name, code in (("view", 2), ("purchase", 3), ("error", 4)):
        command = command.when(F.col("event_type") == name, code)
    return ix.select(
        F.lit("run0").alias("run_id"),
        "episode_ord",
        n.alias("frame_id"),
        e.alias("run_tick"),
        t_us.alias("t_us"),
        (n >= F.col("cnt") - 20).alias("is_tail"),
        (x_dm / 10.0).alias("x_m"),
        (F.when(kind == 4, n * 3).otherwise(0) / 10.0).alias("y_m"),
        F.when(kind == 4, 17.0).otherwise(0.0).alias("yaw_deg"),
        F.when(n.isin(3, 7), 0.5)
        .when((kind == 1) & (n >= 30), 0.1)
        .otherwise(F.col("value") / 10.0 + 1.0)
        .alias("speed_mps"),
        F.when(e % 10 == 0, 0.8).otherwise(0.0).alias("brake"),
        ((e * 3 % 101) / 100.0).alias("throttle"),
        ((e * 7 % 201 - 100) / 100.0).alias("steer_norm"),
        ((F.col("k") - 50) / 10.0).alias("accel_long"),
        ((e % 21 - 10) / 10.0).alias("accel_lat"),
        ((e % 13 - 6) / 10.0).alias("yaw_rate"),
        command.otherwise(0).alias("command"),
        (e % 6).cast("int").alias("gear"),
        (e % 13 * 10.0).alias("speed_limit_kmh"),
        (e % 720).cast("double").alias("sun_azimuth"),
        F.when(e % 9 != 0, 1).when(e % 18 == 0, 2).cast("int").alias("lane_type"),
        (F.col("cnt") - n).cast("double").alias("goal_dist_m"),
        "collisions_cum",
        "lane_events_cum",
    )


def egos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vehicle pose per tick, from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("tick"),
        (F.col("o_custkey") % 100).cast("double").alias("ego_x"),
        (k % 80).cast("double").alias("ego_y"),
        (k % 360).cast("double").alias("ego_yaw"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World actors per tick, from lineitem; ``order_key`` is their arrival order."""
    li = table(spark, sf_dir, "lineitem")
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    kind = line % 4
    name = (
        F.when(kind == 0, "vehicle.tesla.model3")
        .when(kind == 1, "walker.pedestrian.0001")
        .when(kind == 2, "vehicle.diamondback.bike")
        .otherwise("traffic.sign")
    )
    return li.select(
        F.col("l_orderkey").alias("tick"),
        line.alias("line"),
        part.alias("part"),
        supp.alias("supp"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        name.alias("type_name"),
        (part % 121 - 10).cast("double").alias("x_w"),
        (supp % 81).cast("double").alias("y_w"),
        (part % 360).cast("double").alias("yaw_w"),
        (F.col("l_quantity") / 5.0 - 5.0).alias("vx_w"),
        (F.col("l_discount") * 50.0).alias("vy_w"),
        (supp % 5 / 4.0 + 1.0).alias("extent_x"),
        (supp % 3 / 4.0 + 0.5).alias("extent_y"),
    )


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic lights per tick, from each order's first line."""
    part = F.col("l_partkey")
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_linenumber = 1")
        .select(
            F.col("l_orderkey").alias("tick"),
            part.alias("tl_id"),
            (part % 3).cast("int").alias("state"),
            (F.col("l_quantity") - 10.0).alias("stop_x"),
            (part % 21 - 10).cast("double").alias("stop_y"),
        )
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of up to 20 points cut from the episodes."""
    f = frames(spark, sf_dir).select("episode_ord", F.col("frame_id").alias("n"))
    idx = F.col("n") % 20
    return f.select(
        (F.col("episode_ord") * 100_000 + F.expr("n div 20")).alias("route_id"),
        idx.cast("int").alias("idx"),
        (idx * 1.5 - 3.0).alias("x"),
        ((F.col("n") * F.col("n")) % 7 * 0.3).alias("y"),
    )


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ego vectors, object rows, logits and targets, from the embeddings."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"),
        F.slice(v, 1, 14).alias("ego_vec"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice(v, i * 11 + 1, F.lit(11))).alias("objects"),
        F.slice(v, 1, 10).alias("logits"),
        F.col("label").alias("target"),
        v.alias("values"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in files: lineitem rows, one file per flag and status."""
    return table(spark, sf_dir, "lineitem").withColumn("file", F.concat("l_returnflag", "l_linestatus"))


FILE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_shipdate",
]
