"""Shared parts of the stateful stream operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose settings suit stateful streams; those of ``spark`` stay as they are.

    State lives in RocksDB.  It has a fixed number of partitions, chosen when a stream first starts: ``partitions``, or as many
    as the session shuffles with.
    """
    own = spark.newSession()
    for k, v in (("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
        own.conf.set(k, v)
    own.conf.set(PROVIDER, ROCKSDB)
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def require_rocksdb(spark: SparkSession) -> None:
    """State variables need the RocksDB state store; a session without it is an error, see :func:`stream_session`."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}, or read the stream in stream_session(spark)")


def late_rows(query) -> int:
    """Rows that a streaming query's last triggers dropped because they came later than its watermark allows.

    Spark keeps the progress of the last hundred triggers or so; add the counts up where a query runs for longer.
    """
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


class Waiting:
    """A key's rows that wait in state, in buckets of their order column: a map from (bucket, piece) to the piece's columns.

    The rows of a micro-batch are put away frame by frame as they come, and taken out bucket by bucket in order.  So what is in
    memory is one frame or one bucket, never all that a key got in a micro-batch.  What a frame has for a bucket is a piece of
    its own: nothing that was put away is read and written again, however many frames a bucket's rows are spread over.
    Call :meth:`open` first for each key.
    """

    def __init__(self, handle, name: str, columns: dict[str, str], order: str, width: int) -> None:
        self.columns, self.order, self.width = list(columns), order, width
        fields = ", ".join(f"{c} array<{t}>" for c, t in columns.items())
        self.map = handle.getMapState(name, "bucket bigint, piece bigint", fields)
        self.pieces: dict[int, list[int]] = {}

    def open(self) -> None:
        """Look up what the current key has."""
        self.pieces = {}
        for bucket, piece in sorted(tuple(k) for k in self.map.keys()):
            self.pieces.setdefault(bucket, []).append(piece)

    def add(self, pdf) -> None:
        for bucket, rows in pdf.groupby(pdf[self.order] // self.width):
            there = self.pieces.setdefault(int(bucket), [])
            there.append(there[-1] + 1 if there else 0)
            self.map.updateValue((int(bucket), there[-1]), tuple(rows[c].tolist() for c in self.columns))

    def buckets(self) -> list[int]:
        return sorted(self.pieces)

    def get(self, bucket: int):
        """The bucket's rows in order; equal ones in the order in which they came."""
        import pandas as pd

        pieces = [self.map.getValue((bucket, p)) for p in self.pieces[bucket]]
        rows = pd.DataFrame({c: list(itertools.chain.from_iterable(p[i] for p in pieces)) for i, c in enumerate(self.columns)})
        return rows.sort_values(self.order, kind="stable", ignore_index=True)

    def put(self, bucket: int, rows) -> None:
        self.remove(bucket)
        self.pieces[bucket] = [0]
        self.map.updateValue((bucket, 0), tuple(rows[c].tolist() for c in self.columns))

    def remove(self, bucket: int) -> None:
        for p in self.pieces.pop(bucket, []):
            self.map.removeKey((bucket, p))

    def drain(self, frames: Iterator) -> Iterator:
        """Put the frames away, then take out every bucket, in order."""
        self.open()
        for pdf in frames:
            self.add(pdf)
        for b in self.buckets():
            rows = self.get(b)
            self.remove(b)
            yield rows


def run_length(good, carry: int):
    """Length of the run of true values ending at each position; ``carry`` is the run before the first."""
    import numpy as np

    at = np.arange(len(good))
    broken = np.maximum.accumulate(np.where(good, -1, at))
    return np.where(broken >= 0, at - broken, at + 1 + carry)
