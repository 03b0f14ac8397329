"""What a stream operator holds in memory, and what it drops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayframe.streaming import common
from wayframe.streaming.gate import AT_ONCE, _Gate, stream_gate
from wayframe.streaming.labelling import _Labeller, stream_future_labels


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Map(dict):
    largest = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        Map.largest = max(Map.largest, len(self[k][0]))
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, keys, values):
        return self.maps.setdefault(name, Map())

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_gate_takes_a_large_micro_batch_in_parts():
    n = 20 * AT_ONCE
    r = np.random.default_rng(1)
    good = r.random(n) < 0.9
    ticks = pd.DataFrame({"frame_id": np.arange(n), "good": good, "still": ~good}).sample(frac=1, random_state=2)
    gate = _Gate(["run"], 15)
    gate.init(Handle())
    Map.largest = 0
    frames = [ticks.iloc[i : i + 1000] for i in range(0, n, 1000)]
    out = list(gate.handleInputRows(("r",), iter(frames), None))
    assert max(map(len, out)) <= AT_ONCE and Map.largest <= AT_ONCE and not gate.waiting.map
    got = pd.concat(out)
    run, opened = 0, False
    for f, g, rec in zip(got["frame_id"], good, got["recording"]):
        run = run + 1 if g else 0
        opened = opened or run >= 15
        assert rec == opened
    assert got["frame_id"].tolist() == list(range(n))


@pytest.mark.parametrize("step", [3, 50])
def test_labeller_holds_a_few_buckets(step):
    n = 4
    r = np.random.default_rng(step)
    t = np.cumsum(r.integers(1, 8, 3000))
    ticks = pd.DataFrame({"frame_id": np.arange(3000), "t_us": t, "x_m": t * 1.0, "y_m": 0.0, "speed_mps": 0.0, "is_base": r.random(3000) < 0.8, "clock_us": t})
    label = _Labeller(["run"], n, step, 1000)
    label.init(Handle())
    out = []
    for lo in range(0, 3000, 700):  # micro-batches in order, frames of one out of order
        part = ticks.iloc[lo : lo + 700].sample(frac=1, random_state=lo)
        out += list(label.handleInputRows(("r",), iter([part.iloc[i : i + 90] for i in range(0, 700, 90) if len(part.iloc[i : i + 90])]), None))
        assert sum(len(v[0]) for v in label.ticks.map.values()) <= 2 * n * step + 20
    assert max(map(len, out)) <= n * n * step
    got = pd.concat(out).sort_values(["frame_id", "i"])
    want = []
    for f in np.flatnonzero(ticks["is_base"]):
        last, steps = f, []
        for k in range(1, n + 1):
            last = max(np.searchsorted(t, t[f] + k * step), last + 1)
            steps.append(last)
        if last < 3000:
            want += [(f, k + 1, t[s]) for k, s in enumerate(steps)]
    assert list(zip(got["frame_id"], got["i"], got["t_us"])) == want


def test_late_ticks_are_counted(spark, tmp_path):
    own = common.stream_session(spark, 2)
    assert own.conf.get(common.PROVIDER) == common.ROCKSDB and spark.conf.get(common.PROVIDER, None) != common.ROCKSDB
    kinds = "run_id string, episode_ord int, frame_id bigint, t_us bigint, x_m double, y_m double, speed_mps double"
    rows = [("r", 0, i, i * 100_000, 1.0 * i, 0.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, kinds)
    late, out = 0, str(tmp_path / "out")
    for part in (df.where("frame_id < 100"), df.where("frame_id >= 100"), df.where("frame_id IN (3, 5, 7)")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        labels = stream_future_labels(own.readStream.schema(kinds).parquet(str(tmp_path / "in")), 2, 200_000, tail=None)
        q = labels.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        late += common.late_rows(q)
    assert late == 3
    assert spark.read.parquet(out).agg(F.count_distinct("frame_id")).first()[0] == 196


def test_streams_ask_for_their_state_store(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, 1, 1.0)], "run_id string, episode_ord int, frame_id bigint, speed_mps double")
    rows.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="stream_session"):
        stream_gate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))


def test_waiting_rows_are_put_away_once():
    """Frames whose rows spread over the same buckets used to read and write a bucket again for each of them."""
    moved = []

    class Map(dict):
        def updateValue(self, key, value):
            moved.append(len(value[0]))
            self[key] = value

        def getValue(self, key):
            moved.append(len(self[key][0]))
            return self[key]

        def containsKey(self, key):
            return key in self

        def removeKey(self, key):
            del self[key]

    class Handle:
        def __init__(self):
            self.maps = {}

        def getMapState(self, name, key, value):
            return self.maps.setdefault(name, Map())

    handle = Handle()
    frames = [pd.DataFrame({"t": range(i, 4000, 40), "x": range(i, 4000, 40)}) for i in range(40)]
    first = common.Waiting(handle, "ticks", {"t": "bigint", "x": "bigint"}, "t", 100)
    first.open()
    for pdf in frames[:20]:
        first.add(pdf)
    # Another worker goes on with what is in state.
    second = common.Waiting(handle, "ticks", {"t": "bigint", "x": "bigint"}, "t", 100)
    got = pd.concat(second.drain(iter(frames[20:])), ignore_index=True)
    assert got["t"].tolist() == got["x"].tolist() == list(range(4000))
    assert sum(moved) == 2 * 4000 and not handle.maps["ticks"]
