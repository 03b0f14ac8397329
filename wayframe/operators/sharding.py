"""Global sample index, shards, episode sets and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayframe.plans.ranges import number_rows
from wayframe.plans.segments import WIDTH, dense_index


def index_and_shard(df: DataFrame, order: Sequence[str], per_shard: int = 1000, file: str = "file") -> DataFrame:
    """Add ``sample_idx`` (dense, in file and row order) and ``shard_idx``.

    Rows are numbered over ranges of the whole order, so one file or one first key may hold most of them.
    """
    out = number_rows(df, [file, *order], "sample_idx")
    return out.withColumn("shard_idx", F.expr(f"sample_idx div {int(per_shard)}"))


def shard_summary(df: DataFrame) -> DataFrame:
    """First and last sample and count of each shard."""
    return df.groupBy("shard_idx").agg(
        F.min("sample_idx").alias("first_sample_idx"),
        F.max("sample_idx").alias("last_sample_idx"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def assign_episode_sets(
    df: DataFrame, n: int = 5, run: str = "run_id", episode: str = "episode_ord", width: int = WIDTH
) -> DataFrame:
    """Add ``set_idx`` (from 1) and ``episode_id`` (ordinal in the set).

    Only episodes with rows count, so an empty one takes no number.
    """
    episodes = dense_index(df.select(run, episode).distinct(), [run], episode, "_ord", width)
    placed = episodes.select(
        run,
        episode,
        (F.expr(f"_ord div {int(n)}") + 1).alias("set_idx"),
        (F.col("_ord") % n).cast("int").alias("episode_id"),
    )
    return df.join(placed, [run, episode])


def episode_set_metadata(df: DataFrame, has_rl_fields: bool = False, run: str = "run_id") -> DataFrame:
    """Per set: cumulative episode boundaries from 0, number of episodes, format version."""
    per = df.groupBy(run, "set_idx", "episode_id").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(run, "set_idx").orderBy("episode_id").rowsBetween(W.unboundedPreceding, 0)
    ends = per.withColumn("_end", F.sum("_n").over(w))
    return ends.groupBy(run, "set_idx").agg(
        F.concat(F.array(F.lit(0).cast("bigint")), F.sort_array(F.collect_list("_end"))).alias("episode_boundaries"),
        F.count(F.lit(1)).alias("n_episodes"),
        F.lit("2.2" if has_rl_fields else "2.0").alias("version"),
    )


def reconcile_shards(counts: DataFrame, total: int, per_shard: int) -> DataFrame:
    """Fill missing shard counts from the dataset's metadata: (shard, used_count, source).

    ``counts`` has ``shard_idx`` and a nullable ``sample_count``.  A missing
    count becomes the shard's share of what the metadata total leaves after the
    shards before it; with nothing left it is a full shard.
    """
    ranked = number_rows(counts, ["shard_idx"], "_at")
    known = F.coalesce(F.col("sample_count"), F.lit(0)) > 0
    left = F.greatest(F.lit(0), F.lit(total) - F.col("_at") * per_shard)
    filled = F.when(left > 0, F.least(F.lit(per_shard), left)).otherwise(F.lit(per_shard))
    guess = filled if per_shard > 0 else F.lit(0)
    return ranked.select(
        "shard_idx",
        F.when(known, F.col("sample_count")).otherwise(guess).cast("bigint").alias("used_count"),
        F.when(known, "counted").otherwise("default" if per_shard > 0 else "missing").alias("source"),
    )


def reconcile_total(reconciled: DataFrame, total: int) -> DataFrame:
    """One row: counted total, metadata total, and whether they differ."""
    s = F.coalesce(F.sum("used_count"), F.lit(0))
    return reconciled.agg(
        s.alias("total_from_shards"),
        F.lit(total).cast("bigint").alias("total_from_metadata"),
        ((F.lit(total) > 0) & (s > 0) & (s != total)).alias("differs"),
        F.count_if(F.col("source") == "missing").alias("shards_without_count"),
    )


def _differs(src: Column, out: Column, kind: T.DataType, tolerance: float) -> Column:
    """Whether two values of one type differ: nulls and NaNs equal only each other, numbers up to a tolerance."""
    if isinstance(kind, T.ArrayType):
        pairs = F.zip_with(src, out, lambda a, b: _differs(a, b, kind.elementType, tolerance))
        return F.when(src.isNull() | out.isNull(), ~src.eqNullSafe(out)).otherwise(F.exists(pairs, lambda d: d))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        odd = src.isNull() | out.isNull() | F.isnan(src) | F.isnan(out)
        return F.when(odd | (src == out), ~src.eqNullSafe(out)).otherwise(~(F.abs(src - out) <= tolerance))
    return ~src.eqNullSafe(out)


def _reshaped(src: Column, out: Column, kind: T.DataType) -> Column:
    """Whether two arrays of one type differ in length at any depth; null ones are compared as values."""
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    here = F.size(src) != F.size(out)
    if isinstance(kind.elementType, T.ArrayType):
        here = here | F.exists(F.zip_with(src, out, lambda a, b: _reshaped(a, b, kind.elementType)), lambda d: d)
    return F.coalesce(src.isNotNull() & out.isNotNull() & here, F.lit(False))


def verify_conversion(
    source: DataFrame,
    output: DataFrame,
    fields: Sequence[str],
    key: str = "sample_idx",
    tolerance: float = 1e-5,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Differences between source and output samples: (key, field, problem).

    ``fields`` may hold numbers, flags, texts, or arrays of them at any depth, of the same type on both sides;
    floating-point numbers may differ by ``tolerance``, all else must be equal, and a null or NaN equals only its like.
    ``sampled`` restricts the check to some keys; by default all samples of both sides are compared.
    Problems are ``missing`` (a sample or a field that the output lacks), ``extra`` (one that the source lacks),
    ``shape`` and ``value``.
    """
    for f in fields:
        if source.schema[f].dataType.simpleString() != output.schema[f].dataType.simpleString():
            raise ValueError(f"{f}: {source.schema[f].dataType.simpleString()} in the source, {output.schema[f].dataType.simpleString()} in the output")
    only = (lambda df: df) if sampled is None else (lambda df: df.join(sampled.select(key), key, "left_semi"))
    s = only(source).select(key, F.struct(*fields).alias("_s"))
    o = only(output).select(key, F.struct(*fields).alias("_o"))
    j = s.join(o, key, "full_outer")
    lost, extra = F.col("_o").isNull(), F.col("_s").isNull()

    def check(f: str) -> Column:
        a, b, kind = F.col(f"_s.{f}"), F.col(f"_o.{f}"), source.schema[f].dataType
        problem = (
            F.when(a.isNotNull() & b.isNull(), F.lit("missing"))
            .when(a.isNull() & b.isNotNull(), F.lit("extra"))
            .when(_reshaped(a, b, kind), F.lit("shape"))
            .when(_differs(a, b, kind, tolerance), F.lit("value"))
        )
        return F.struct(F.lit(f).alias("field"), F.when(~lost & ~extra, problem).alias("problem"))

    whole = F.struct(F.lit("*").alias("field"), F.when(lost, F.lit("missing")).when(extra, F.lit("extra")).alias("problem"))
    rows = F.filter(F.array(whole, *[check(f) for f in fields]), lambda r: r["problem"].isNotNull())
    return j.select(key, F.inline(rows))
