"""Dense numbers in an order, by range partitions.

The rows are range-partitioned by all ordering columns together, sorted and written once to the shared folder.  A row's
number is its place in its file, which Spark knows, plus the rows of the files before.  So one hot first key,
or a sparse one, does not matter: ranges are cut by sampled rows, wherever they fall.  Only one count per file
is added up in one place, and no window sorts the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayframe.sources.shared import CODEC, fresh_dir


def number_rows(df: DataFrame, order: Sequence[str], name: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the 0-based number of each row in ``order``, per ``keys`` if there are any (they come first in the order).

    Rows that are equal in ``order`` are numbered in any way, but for good: the written rows keep their numbers
    however often they are read.  A column of that name is replaced.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c != name]
    path = fresh_dir(spark, "numbered")
    by = [*keys, *order]
    df.select(*columns).repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", CODEC).parquet(path)
    stored = spark.read.schema(df.select(*columns).schema).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = stored.select(*columns, part.alias("_part"), F.col("_metadata.row_index").alias("_at"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = rows.join(starts, F.col("_part") == F.col("_of"))
    number = F.col("_start") + F.col("_at")
    if keys:
        out = out.withColumn("_row", number)
        firsts = out.groupBy(*keys).agg(F.min("_row").alias("_first")).select(F.struct(*keys).alias("_key"), "_first")
        out = out.join(firsts, F.struct(*keys).eqNullSafe(F.col("_key")))
        number = F.col("_row") - F.col("_first")
    return out.select(*columns, number.alias(name))
