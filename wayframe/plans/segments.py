"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(episode)`` sends a whole episode to one task, and
one episode (or one run) may hold a large part of the table.  Here a group is
cut into segments of the ordering column, ``order div width``:

* :func:`scan` -- running / total aggregates.  Each segment is summarised with
  a map-side aggregation, the few summary rows are scanned per group, and the
  carried value is joined back on ``(group, segment)``.
* :func:`halo` -- windows with a bounded look-back or look-ahead.  The rows
  next to a border are copied into the neighbouring segment, so the window can
  be partitioned by ``(group, segment)``.

The first ordering column is an integer counter such as a tick number.  When it
is unique in its group, a segment never holds more than ``width`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 65_536
#: Rows that a task sorts: some 0.2 to 0.5 GB.
ROWS_PER_TASK = 200_000
SEG = "_seg"
OWN = "_own"


@dataclass(frozen=True)
class Running:
    """One scanned value.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last`` (last non-null value).
    ``scope`` is ``upto`` (current row included), ``before`` (excluded) or
    ``all`` (the whole group; not for ``last``).
    """

    kind: str
    expr: Column
    scope: str = "upto"


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def segment_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}")


def dealt(df: DataFrame, by: Sequence[str], rows: int = 0) -> DataFrame:
    """Place rows by columns, over as many tasks as the session shuffles with, and more where ``rows`` is known and large.

    The number is stated: rows compress well, so adaptive execution, which goes by compressed bytes, would merge millions of them into
    one task that sorts them in memory.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // ROWS_PER_TASK)), *by)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    width: int = WIDTH,
    within: Sequence[str] = (),
    rows: int = 0,
    **values: Running,
) -> DataFrame:
    """Add running or total aggregates per group, ordered by ``order``.

    ``within`` names leading ordering columns of low cardinality (a file name,
    an episode number): rows are ordered by them first, and they are part of
    the segment.  A segment column left by :func:`halo` is used as it is.
    ``rows``, the number of rows or a bound of it where it is known, sets the number of tasks, see :func:`dealt`.
    """
    keys, within, order = list(keys), list(within), _names(order)
    base = df if SEG in df.columns else df.withColumn(SEG, segment_of(order[0], width))
    for name, v in values.items():
        base = base.withColumn(f"_v_{name}", v.expr)
    seg = [*within, SEG]

    def summarise(name: str, v: Running) -> Column:
        c = F.col(f"_v_{name}")
        if v.kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))
        return _AGG[v.kind](c)

    summary = base.groupBy(*keys, *seg).agg(*[summarise(n, v).alias(f"_s_{n}") for n, v in values.items()])
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy(*seg).rowsBetween(W.unboundedPreceding, -1)

    def carry(name: str, v: Running) -> Column:
        s = F.col(f"_s_{name}")
        if v.kind == "last":
            return F.last(s, ignorenulls=True).over(before)
        return _AGG[v.kind](s).over(whole if v.scope == "all" else before)

    carried = summary.select(*keys, *seg, *[carry(n, v).alias(f"_c_{n}") for n, v in values.items()])

    local_order = W.partitionBy(*keys, *seg).orderBy(*order)
    spans = {
        "upto": local_order.rowsBetween(W.unboundedPreceding, 0),
        "before": local_order.rowsBetween(W.unboundedPreceding, -1),
    }

    def result(name: str, v: Running) -> Column:
        c = F.col(f"_c_{name}")
        if v.scope == "all":
            return F.coalesce(c, F.lit(0)) if v.kind == "sum" else c
        value = F.col(f"_v_{name}")
        local = F.last(value, ignorenulls=True) if v.kind == "last" else _AGG[v.kind](value)
        return _combine(v.kind, c, local.over(spans[v.scope]))

    if any(v.scope != "all" for v in values.values()):
        base = dealt(base, [*keys, *seg], rows)
    joined = base.join(carried, [*keys, *seg])
    kept = [F.col(c) for c in df.columns if c not in values and c not in (SEG, OWN)]
    return joined.select(*kept, *[result(n, v).alias(n) for n, v in values.items()])


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    name: str = "idx",
    width: int = WIDTH,
    within: Sequence[str] = (),
    rows: int = 0,
) -> DataFrame:
    """0-based row number per group, in ``order``; exact for groups of any size."""
    one = F.lit(1).cast("bigint")
    return scan(df, keys, order, width, within, rows, **{name: Running("sum", one, "before")})


def halo(df: DataFrame, index: str, back: int = 0, ahead: int = 0, width: int = WIDTH) -> DataFrame:
    """Assign rows to segments, copying border rows to the neighbouring one.

    ``index`` must be consecutive inside a group (a tick counter, or the result
    of :func:`dense_index`).  Windows over ``(group, _seg)`` then see ``back``
    rows before and ``ahead`` rows after each own row; drop the copies with
    ``_own`` afterwards.
    """
    if max(back, ahead) > width:
        raise ValueError("look-back or look-ahead is wider than a segment")
    pos = F.pmod(F.col(index), F.lit(width))
    seg = segment_of(index, width)
    places = [F.struct(seg.alias("s"), F.lit(True).alias("o"))]
    if back:
        places.append(F.when(pos >= width - back, F.struct((seg + 1).alias("s"), F.lit(False).alias("o"))))
    if ahead:
        places.append(F.when(pos < ahead, F.struct((seg - 1).alias("s"), F.lit(False).alias("o"))))
    out = df.withColumn("_place", F.explode(F.array_compact(F.array(*places))))
    return out.withColumn(SEG, F.col("_place.s")).withColumn(OWN, F.col("_place.o")).drop("_place")


def own_rows(df: DataFrame, keep_segment: bool = False) -> DataFrame:
    """Drop the copies made by :func:`halo`."""
    return df.where(OWN).drop(OWN) if keep_segment else df.where(OWN).drop(SEG, OWN)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    offset: int = 1,
    width: int = WIDTH,
    keep_segment: bool = False,
    rows: int = 0,
    **values: Column,
) -> DataFrame:
    """Each expression's value ``offset`` rows earlier (later if negative); null outside the group.

    One row back is exact for any counter, gaps included: the last row of the
    earlier segments comes through their summaries.  For other offsets ``index``
    must be consecutive, see :func:`dense_index`.
    """
    if offset == 1 and not keep_segment:
        last = {n: Running("last", F.struct(c.alias("v")), "before") for n, c in values.items()}
        out = scan(df, keys, index, width, rows=rows, **last)
        return out.withColumns({n: F.col(f"{n}.v") for n in values})
    w = W.partitionBy(*keys, SEG).orderBy(index)
    spread = dealt(halo(df, index, back=max(offset, 0), ahead=max(-offset, 0), width=width), [*keys, SEG], rows)
    return own_rows(spread.select("*", *[F.lag(c, offset).over(w).alias(n) for n, c in values.items()]), keep_segment)
