"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.sources.shared import CODEC, fresh_dir, settle

__all__ = ["SPACE", "components", "fresh_dir", "let", "packed", "running", "settle", "table", "unpacked", "words"]

#: A run of white space between words, as a Java regular expression; the characters are U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], prefix: str = "before_") -> DataFrame:
    """Add, for each column of ``sums``, its total over all rows that come earlier in ``order``.

    The rows are range-partitioned, sorted and written once to the shared folder, so that the ranges
    stay what they are if tasks run again.  The totals of the files (one row per file) give each
    file's start; inside a file a window adds up.  No task sees more than its own range.  ``order``
    should end with columns that make rows distinct, so that ranges can be cut anywhere.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "ranges")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", CODEC).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"))
    totals = rows.groupBy("_file").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_file").alias("_of"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy("_file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, F.col("_file") == F.col("_of"))
        .withColumns({prefix + c: F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
        .drop("_file", "_of", *[f"_s_{c}" for c in sums])
    )


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), the smallest node reachable.

    Alternates large and small stars (Kiveris and others, 2014): each node hangs its larger, then its
    smaller neighbours under the smallest neighbour, until all components are stars.  Every step is
    two map-side combined minima and joins, written to the shared folder; nothing is collected.
    """

    def under_least(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a").withColumn("m", F.least("m", "a"))

    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = settle(pairs.distinct(), "edges")
    before = marks(pairs)
    for _ in range(limit):
        if not before[0]:
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = under_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = under_least(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        pairs = settle(small.where("a <> b").distinct(), "edges")
        now = marks(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows as one struct ``row`` with some keys beside it, so that no input column can clash with a name used here."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of packed rows."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def runs(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` integer columns, as (table, borders): whole runs of equal keys only.

    Run k of a table is rows borders[k] to borders[k + 1].  What is held back between batches is one run at most.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        k = np.stack([t.column(i).to_numpy() for i in range(keys)])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        held = t if not len(cut) else t.slice(int(cut[-1]))
        if len(cut):
            yield t.slice(0, int(cut[-1])).combine_chunks(), [0, *cut.tolist()]
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [0, held.num_rows]


def chunk_pairs(df: DataFrame, group: Sequence[str], rows: str, chunk: Column, size: int) -> DataFrame:
    """Give each row the block pairs (i, j), i <= j, of its group that it takes part in.

    A group of ``rows`` rows has ceil(rows / size) blocks, ``chunk`` being a hash that deals its rows over them; all
    pairs of rows meet in some block pair, no task has more than about two blocks, and a group of one block is not copied.
    """
    n = F.ceil(F.col(rows) / size).cast("int")
    c = F.pmod(chunk, F.col("_blocks")).cast("int")
    d = df.withColumn("_blocks", n).withColumn("_c", c)
    return d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"i": F.least("_c", "_o"), "j": F.greatest("_c", "_o")}).drop("_o", "_blocks").withColumnRenamed("_c", "block")


def chunk_leaders(df: DataFrame, rows: str, chunk: Column, size: int) -> DataFrame:
    """Give each row the block (i = 0, j) of its group that it belongs to, and the rows of block 0 all blocks: at most about twice the rows."""
    n = F.ceil(F.col(rows) / size).cast("int")
    d = df.withColumn("_blocks", n).withColumn("block", F.pmod(chunk, F.col("_blocks")).cast("int"))
    j = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("block"))
    return d.withColumn("i", F.lit(0)).withColumn("j", F.explode(j)).drop("_blocks")
