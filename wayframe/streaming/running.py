"""Running reward statistics of a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayframe.streaming.common import Waiting, require_rocksdb


#: Ticks of a key that are looked at together.
AT_ONCE = 4096


class _Normaliser(StatefulProcessor):
    """State per run: count, mean and sum of squared deviations."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stats = handle.getValueState("stats", "n bigint, mean double, m2 double")
        self.waiting = Waiting(handle, "ticks", {"run_tick": "bigint", "x": "double", "gated": "boolean"}, "run_tick", AT_ONCE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        state = self.stats.get() if self.stats.exists() else (0, 0.0, 0.0)
        for pdf in self.waiting.drain(rows):
            state = yield from self.normalised(key, pdf, *state)
        self.stats.update(state)

    def normalised(self, key, pdf, n0: int, mean0: float, m20: float):
        import numpy as np

        x, gated = pdf["x"].to_numpy(float), pdf["gated"].to_numpy(bool)
        d = np.where(gated, x - mean0, 0.0)
        n = n0 + np.cumsum(gated)
        s1, s2, some = np.cumsum(d), np.cumsum(d * d), np.maximum(n, 1)
        mean = mean0 + s1 / some
        m2 = np.maximum(m20 + s2 - s1 * s1 / some, 0.0)
        std = np.sqrt(m2 / some)
        z = np.where(std > 1e-6, (x - mean) / np.where(std > 1e-6, std, 1.0), 0.0)
        for name, value in zip(self.keys, key):
            pdf[name] = value
        pdf["reward_mean"] = np.where(gated, mean, 0.0)
        pdf["reward_std"] = np.where(gated, std, 0.0)
        pdf["reward_normalized"] = np.where(gated, z, x)
        yield pdf[[*self.keys, "run_tick", "reward_mean", "reward_std", "reward_normalized"]]
        return int(n[-1]), float(mean[-1]), float(m2[-1])

    def close(self) -> None:
        pass


def stream_running_normalise(
    stream: DataFrame,
    value: str = "reward_clipped",
    gate: str | None = "recording",
    keys: Sequence[str] = ("run_id",),
    order: str = "run_tick",
) -> DataFrame:
    """Running mean, deviation and normalised value of each tick of a run, as in rewards.running_normalise."""
    require_rocksdb(stream.sparkSession)
    keys = list(keys)
    gated = F.lit(True) if gate is None else F.col(gate)
    ticks = stream.select(
        *keys, F.col(order).cast("bigint").alias("run_tick"), F.col(value).cast("double").alias("x"), gated.alias("gated")
    )
    types = dict(stream.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += ", run_tick bigint, reward_mean double, reward_std double, reward_normalized double"
    return ticks.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Normaliser(keys), outputStructType=schema, outputMode="Append", timeMode="None"
    )
