"""Recording gate and standstill counter of a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayframe import constants as K
from wayframe.streaming.common import Waiting, require_rocksdb, run_length


#: Ticks of a key that are looked at together.
AT_ONCE = 4096


class _Gate(StatefulProcessor):
    """State per episode: current run of good ticks, whether the gate is open, current standstill."""

    def __init__(self, keys: Sequence[str], ticks: int) -> None:
        self.keys, self.need = list(keys), ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "run bigint, open boolean, standing bigint")
        self.waiting = Waiting(handle, "ticks", {"frame_id": "bigint", "good": "boolean", "still": "boolean"}, "frame_id", AT_ONCE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np

        run0, open0, standing0 = self.state.get() if self.state.exists() else (0, False, 0)
        for pdf in self.waiting.drain(rows):
            run = run_length(pdf["good"].to_numpy(bool), run0)
            opened = np.maximum.accumulate(run >= self.need) | open0
            standing = run_length(pdf["still"].to_numpy(bool), standing0)
            run0, open0, standing0 = int(run[-1]), bool(opened[-1]), int(standing[-1])
            for name, value in zip(self.keys, key):
                pdf[name] = value
            pdf["recording"], pdf["standing_run"] = opened, standing
            yield pdf[[*self.keys, "frame_id", "recording", "standing_run"]]
        self.state.update((run0, open0, standing0))

    def close(self) -> None:
        pass


def stream_gate(
    stream: DataFrame,
    ticks: int = K.GATE_TICKS,
    min_speed: float = K.GATE_SPEED_MPS,
    still_speed: float = K.STATIONARY_SPEED_MPS,
    keys: Sequence[str] = ("run_id", "episode_ord"),
) -> DataFrame:
    """Per tick: is the gate open, and how many ticks has the vehicle been standing."""
    require_rocksdb(stream.sparkSession)
    keys = list(keys)
    rows = stream.select(
        *keys,
        F.col("frame_id").cast("bigint").alias("frame_id"),
        (F.col("speed_mps") >= min_speed).alias("good"),
        (F.col("speed_mps") < still_speed).alias("still"),
    )
    types = dict(stream.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", frame_id bigint, recording boolean, standing_run bigint"
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Gate(keys, ticks), outputStructType=schema, outputMode="Append", timeMode="None"
    )
