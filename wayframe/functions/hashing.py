"""Reproducible randomness from row keys.

``rand()`` depends on how rows are partitioned, so a retried or re-planned task
would draw other numbers.  These draws depend only on a key and a seed: 48 bits
of the MD5 of both.  A key may have several parts (run, episode, frame; sample,
element); all of them count in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 48


def _parts(key) -> list[Column]:
    keys = key if isinstance(key, Sequence) and not isinstance(key, str) else [key]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def hash_int(key, seed: int = 0) -> Column:
    """Integer in [0, 2^48) from a column or a sequence of columns; a null part keeps its place, as an empty text."""
    text = F.concat_ws(":", F.lit(str(int(seed))), *[F.coalesce(p.cast("string"), F.lit("")) for p in _parts(key)])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def uniform(key, seed: int = 0) -> Column:
    """Number in [0, 1)."""
    return hash_int(key, seed) / F.lit(float(MODULUS))


def uniform_range(key, seed: int, lo: float, hi: float) -> Column:
    return uniform(key, seed) * (hi - lo) + lo


def uniform_int(key, seed: int, lo: int, hi: Column | int) -> Column:
    """Integer in [lo, hi], both ends included."""
    span = (hi if isinstance(hi, Column) else F.lit(hi)) - lo + 1
    return (F.floor(uniform(key, seed) * span) + lo).cast("int")


def normal(key, seed: int = 0) -> Column:
    """Standard normal draw (Box and Muller) from two independent uniform ones."""
    u = F.greatest(uniform(key, seed), F.lit(1e-9))
    v = uniform(key, seed + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
