"""Run and dataset metadata documents, metric and trial logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayframe import constants as K

METADATA_DDL = (
    "K int, N_future int, M int, C int, H int, W int, version string, norms_version int, run_id string, "
    "fields array<string>, samples_per_shard bigint, total_samples bigint, shard_pattern string"
)


def dataset_metadata(
    samples: DataFrame,
    fields: Sequence[str],
    run_id: str,
    height: int = 150,
    width: int = 200,
    samples_per_shard: int = 1000,
    version: str = "2.0",
) -> DataFrame:
    """The dataset document as a one-row table; the total is counted from the samples."""
    fixed = {
        "K": K.ROUTE_POINTS, "N_future": K.FUTURE_STEPS, "M": K.MAX_OBJECTS, "C": K.RASTER_CHANNELS,
        "H": height, "W": width, "version": version, "norms_version": 1, "run_id": run_id,
    }
    doc = samples.agg(F.count(F.lit(1)).alias("total_samples")).select(
        *[F.lit(v).alias(k) for k, v in fixed.items()],
        F.array(*[F.lit(f) for f in fields]).alias("fields"),
        F.lit(samples_per_shard).cast("bigint").alias("samples_per_shard"),
        "total_samples",
        F.lit("shard-%06d.tar").alias("shard_pattern"),
    )
    return doc


def write_metadata(doc: DataFrame, root: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/metadata")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The dataset document; a dataset without one is an error."""
    return spark.read.schema(METADATA_DDL).json(f"{root.rstrip('/')}/metadata")


RUN_DDL = "run_id string, frames bigint, episodes bigint, fixed_dt double, future_dt double, K int, N int, M int, settings map<string,string>"


def run_metadata(frames: DataFrame, settings: Mapping[str, str], fixed_dt: float, future_dt: float, run: str = "run_id", episode: str | None = None) -> DataFrame:
    """One document per run: clocks, sizes, configuration, frame and episode counts (null without an ``episode`` column)."""
    options = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]) if settings else F.lit(None)
    per = frames.groupBy(F.col(run).alias("run_id"), *([episode] if episode else [])).agg(F.count(F.lit(1)).alias("_n"))
    n = F.count(F.lit(1)) if episode else F.lit(None)
    return per.groupBy("run_id").agg(
        F.sum("_n").alias("frames"),
        n.cast("bigint").alias("episodes"),
        F.lit(fixed_dt).alias("fixed_dt"),
        F.lit(future_dt).alias("future_dt"),
        F.lit(K.ROUTE_POINTS).alias("K"),
        F.lit(K.FUTURE_STEPS).alias("N"),
        F.lit(K.MAX_OBJECTS).alias("M"),
        options.cast("map<string,string>").alias("settings"),
    )


def write_run_metadata(doc: DataFrame, root: str) -> None:
    """Store run documents as JSON lines in ``root/runs``, a folder per run.  A run written again replaces its own document only."""
    doc = doc.withColumn("run", F.col("run_id"))
    doc.repartition("run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(f"{root.rstrip('/')}/runs")


def read_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """All run documents of a root; a root without any is an error."""
    return spark.read.schema(RUN_DDL).json(f"{root.rstrip('/')}/runs").select(*[f.name for f in T.StructType.fromDDL(RUN_DDL)])


def dataset_summary(spark: SparkSession, root: str, shards: str) -> DataFrame:
    """The dataset document with what its shard manifest says: shards, their samples, and whether that is the document's total."""
    from wayframe.sources.tarshards import read_manifest

    counted = read_manifest(spark, shards).agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("sample_count"), F.lit(0)).alias("samples_in_shards"))
    return read_metadata(spark, root).join(F.broadcast(counted)).withColumn("complete", F.col("total_samples") == F.col("samples_in_shards"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Append log lines, one JSON object each; null metrics are left out."""
    df.write.mode("append").json(path)


#: The column that holds a line that can't be read, and the name under which lines are counted while they are read.
CORRUPT, LINES = "_corrupt", "metric_lines"


def read_metric_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Log lines as rows, malformed ones too: their text is in column ``_corrupt``, null in all others."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    # Parsed here and not by the reader, which judges a line by the columns that a query happens to use.
    line = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).where(F.trim("value") != "").select(line.alias("line")).select("line.*")


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str, watch: Observation | None = None) -> DataFrame:
    """Log lines as rows; malformed lines are skipped and counted.

    The counts, ``read`` and ``skipped``, come with the job that reads the rows, in ``watch`` or under the name
    ``metric_lines`` for query listeners; no line is read twice for them.
    """
    lines = read_metric_lines(spark, path, schema)
    bad = F.col(CORRUPT).isNotNull()
    counts = [F.count_if(~bad).alias("read"), F.count_if(bad).alias("skipped")]
    return lines.observe(watch if watch is not None else LINES, *counts).where(~bad).drop(CORRUPT)


def metric_line_counts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row: how many log lines there are, and how many of them are malformed."""
    bad = F.col(CORRUPT).isNotNull()
    return read_metric_lines(spark, path, schema).agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("malformed"))
