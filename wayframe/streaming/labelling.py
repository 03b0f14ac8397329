"""Delayed labelling: frames wait until their horizon has arrived."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayframe import constants as K
from wayframe.streaming.common import Waiting, require_rocksdb

COLUMNS = {"frame_id": "bigint", "t_us": "bigint", "x_m": "double", "y_m": "double", "speed_mps": "double", "is_base": "boolean"}
FIELDS = list(COLUMNS)
#: Horizons in a bucket: each costs some milliseconds, however few ticks it holds.
BUCKET_HORIZONS = 64


class _Labeller(StatefulProcessor):
    """Keeps the ticks that a waiting frame may still need, in buckets of BUCKET_HORIZONS horizons; when a micro-batch is done, those are at most one horizon, plus the waiting frames.

    Frames are labelled bucket by bucket; for one bucket's frames the next ones are loaded as far as their targets reach.
    """

    def __init__(self, keys: Sequence[str], n: int, step_us: int, idle_us: int) -> None:
        self.keys, self.n, self.step_us, self.idle_us = list(keys), n, step_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = Waiting(handle, "ticks", COLUMNS, "t_us", self.n * self.step_us * BUCKET_HORIZONS)
        self.expiry = handle.getValueState("expiry", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        latest = None
        self.ticks.open()
        for pdf in rows:
            self.ticks.add(pdf)
            newest = int(pdf["clock_us"].max())
            latest = newest if latest is None else max(latest, newest)
        yield from self.labelled(key)
        # Forget the episode once the watermark has left its last tick behind by the idle time.
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        at_ms = (latest + self.idle_us) // 1000 + 1
        self.expiry.update((at_ms,))
        self.handle.registerTimer(at_ms)

    def labelled(self, key) -> Iterator:
        """The frames that are ready, earliest bucket first; a bucket whose frames are all labelled goes."""
        buckets = self.ticks.buckets()
        for i, b in enumerate(buckets):
            own = self.ticks.get(b)
            waiting = yield from self.ready(key, own, buckets[i + 1 :])
            if waiting is not None:
                # Targets move on with the frames: those behind a waiting frame wait, too.
                self.ticks.put(b, own.iloc[waiting:])
                return
            self.ticks.remove(b)

    def ready(self, key, own, later: list[int]):
        """Label the bucket's frames as far as the ticks reach; the place of the first frame that has to wait, or None."""
        import numpy as np
        import pandas as pd

        bases = np.flatnonzero(own["is_base"].to_numpy(bool))
        if not len(bases):
            return None
        reach = int(own["t_us"].iloc[bases[-1]]) + self.n * self.step_us
        parts, beyond = [own], 0
        for c in later:
            parts.append(self.ticks.get(c))
            beyond += int((parts[-1]["t_us"] >= reach).sum())
            if beyond > self.n:
                break
        buf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else own
        t = buf["t_us"].to_numpy("int64")
        step = np.arange(1, self.n + 1)
        # First tick at or after each target, and at least one tick further per step.
        first = np.searchsorted(t, t[bases][:, None] + step * self.step_us, side="left")
        at = np.maximum.accumulate(first - step, axis=1) + step
        fit = at[:, -1] < len(t)
        done, picked = bases[fit], at[fit]
        if len(done):
            flat = picked.ravel()
            out = pd.DataFrame({"frame_id": np.repeat(buf["frame_id"].to_numpy()[done], self.n)})
            for name, value in zip(self.keys, key):
                out[name] = value
            out["i"] = np.tile(step.astype("int32"), len(done))
            for f in FIELDS[1:5]:
                out[f] = buf[f].to_numpy()[flat]
            out, most = out[[*self.keys, "frame_id", "i", *FIELDS[1:5]]], self.n * self.n * self.step_us
            for lo in range(0, len(out), most):
                yield out.iloc[lo : lo + most]
        return int(bases[~fit][0]) if len(done) < len(bases) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.ticks.open()
        for b in self.ticks.buckets():
            self.ticks.remove(b)
        self.expiry.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_future_labels(
    stream: DataFrame,
    n: int = K.FUTURE_STEPS,
    step_us: int = K.FUTURE_STEP_US,
    keys: Sequence[str] = ("run_id", "episode_ord"),
    tail: str | None = "is_tail",
    clock: str | None = None,
    idle_us: int = 600_000_000,
) -> DataFrame:
    """Future samples of the frames of a stream, one row per frame and step, once all ``n`` are known.

    Frames whose horizon never arrives are dropped.  Ticks of an episode arrive
    in order across micro-batches.  ``clock`` is the microsecond column that
    drives the watermark, common to all episodes (``t_us`` by default): ticks
    more than one horizon behind it are late, dropped and counted in the query's progress
    (common.late_rows), and an episode silent for ``idle_us`` is forgotten.
    """
    require_rocksdb(stream.sparkSession)
    base = F.lit(True) if tail is None else ~F.col(tail)
    keys = list(keys)
    # The first watermark is time 0, and a tick at it would count as late: clocks start one second later.
    now = F.col(clock or "t_us").cast("bigint") + 1_000_000
    ticks = stream.select(
        *keys,
        F.timestamp_micros(now).alias("event_time"),
        now.alias("clock_us"),
        F.col("frame_id").cast("bigint").alias("frame_id"),
        F.col("t_us").cast("bigint").alias("t_us"),
        *[F.col(c).cast("double").alias(c) for c in ("x_m", "y_m", "speed_mps")],
        base.alias("is_base"),
    ).withWatermark("event_time", f"{n * step_us} microseconds")
    types = dict(stream.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += ", frame_id bigint, i int, t_us bigint, x_m double, y_m double, speed_mps double"
    return ticks.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Labeller(keys, n, step_us, idle_us), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
