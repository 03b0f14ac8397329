"""Files written and read back, damaged input included."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wayframe.schemas import TABLE_NAMES, table_schema
from wayframe.sources import metadata as M
from wayframe.sources import tables as T
from wayframe.sources import tarshards as TS


def test_schemas(spark):
    assert len(TABLE_NAMES) == 8
    assert [f.name for f in table_schema("futures")][:3] == ["run_id", "shard_id", "frame_id"]
    assert len(table_schema("frames")) == 34
    with pytest.raises(ValueError):
        table_schema("weather")


def test_append_casts_and_skips_empty_input(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, 5, 2, 1.5, 2.5, 3.5)], "run_id string, shard_id long, frame_id int, i int, x_ego double, y_ego double, v_mps double")
    T.append_table(df, str(tmp_path), "futures", "zstd")
    before = sorted(os.listdir(tmp_path / "futures"))
    T.append_table(df.where("false"), str(tmp_path), "futures")
    assert sorted(os.listdir(tmp_path / "futures")) == before
    back = T.read_table(spark, str(tmp_path), "futures")
    assert back.schema == table_schema("futures")
    assert [tuple(r) for r in back.collect()] == [("r", 1, 5, 2, 1.5, 2.5, 3.5)]


def test_conform_refuses_unknown_and_absent_columns(spark):
    df = spark.createDataFrame([("r", 1, 5, 2, 1.5, 2.5, 3.5)], "run_id string, shard_id long, frame_id int, i int, x_ego double, y_ego double, v_mps double")
    with pytest.raises(ValueError, match="unknown columns \\['v_mpss'\\], absent columns \\['v_mps'\\]"):
        T.conform(df.withColumnRenamed("v_mps", "v_mpss"), "futures")
    assert T.conform(df.drop("v_mps"), "futures", optional=["v_mps"]).first()["v_mps"] is None


def test_doubles_keep_their_precision(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("sample_idx"), F.lit(0).alias("shard_idx"), (F.col("id") + 0.1).alias("x"))
    TS.write_tar_shards(df, str(tmp_path), ["x"])
    assert sorted(r["x"] for r in TS.read_tar_shards(spark, str(tmp_path), {"x": "double"}).collect()) == [0.1, 1.1, 2.1]


def test_tar_shards_round_trip_and_drop_incomplete(spark, tmp_path):
    df = spark.range(25).select(
        F.col("id").alias("sample_idx"), F.expr("id div 10").alias("shard_idx"), F.col("id").alias("frame_id"),
        F.array(F.col("id") * 1.0, F.lit(2.0)).alias("ego_vec"), F.array(F.array(F.col("id") * 0.5)).alias("route"),
    )
    manifest = TS.write_tar_shards(df, str(tmp_path), ["frame_id", "ego_vec", "route"])
    assert sorted((r["shard_idx"], r["first_sample_idx"], r["last_sample_idx"], r["sample_count"]) for r in manifest.collect()) == [
        (0, 0, 9, 10), (1, 10, 19, 10), (2, 20, 24, 5)]
    fields = {"frame_id": "bigint", "ego_vec": "array<double>", "route": "array<array<double>>"}
    back = TS.read_tar_shards(spark, str(tmp_path), fields).orderBy("sample_idx").collect()
    assert [(r["frame_id"], r["ego_vec"], r["route"]) for r in back] == [(i, [i * 1.0, 2.0], [[i * 0.5]]) for i in range(25)]
    assert TS.read_tar_shards(spark, str(tmp_path), {**fields, "bev": "array<double>"}).count() == 0
    assert TS.read_tar_shards(spark, str(tmp_path), {**fields, "bev": "array<double>"}, required=["route"]).count() == 25
    (tmp_path / "shard-000009.tar").write_bytes(b"not an archive")
    counts = {r["file"]: r["sample_count"] for r in TS.shard_counts(spark, str(tmp_path)).collect()}
    assert counts == {"shard-000000.tar": 10, "shard-000001.tar": 10, "shard-000002.tar": 5, "shard-000009.tar": None}


def test_metadata_must_exist(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        M.read_metadata(spark, str(tmp_path / "nothing"))


def test_malformed_log_lines_are_skipped(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"epoch": 1, "lr": 0.5}\n{"epoch": 2, "l\n\n{"epoch": 3, "lr": 0.25}\n')
    got = M.read_metrics(spark, str(tmp_path), "epoch bigint, lr double").collect()
    assert sorted(r["epoch"] for r in got) == [1, 3]


LOG = "epoch bigint, lr double"


def test_malformed_log_lines_are_counted(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"epoch": 1, "lr": 0.5}\n{"epoch": 2, "l\n\n{"epoch": 3, "lr": 0.25}\nnot json\n')
    watch = Observation()
    assert M.read_metrics(spark, str(tmp_path), LOG, watch).count() == 2
    assert watch.get == {"read": 2, "skipped": 2}
    assert [tuple(r) for r in M.metric_line_counts(spark, str(tmp_path), LOG).collect()] == [(4, 2)]
    bad = [r[M.CORRUPT] for r in M.read_metric_lines(spark, str(tmp_path), LOG).where("epoch IS NULL").collect()]
    assert sorted(bad) == ["not json", '{"epoch": 2, "l']


def test_run_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 5)], "run_id string, episode_ord int")
    doc = lambda n: M.run_metadata(rows, {"n": str(n)}, 0.1, 0.2, episode="episode_ord")
    M.write_run_metadata(doc(1), str(tmp_path))
    M.write_run_metadata(doc(2).where("run_id = 'b'"), str(tmp_path))
    got = {r["run_id"]: r for r in M.read_run_metadata(spark, str(tmp_path)).collect()}
    assert [(k, got[k]["frames"], got[k]["episodes"], got[k]["settings"]) for k in "ab"] == [("a", 3, 2, {"n": "1"}), ("b", 1, 1, {"n": "2"})]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        M.read_run_metadata(spark, str(tmp_path / "nothing"))
    assert M.run_metadata(rows, {}, 0.1, 0.2).where("episodes IS NULL AND settings IS NULL").count() == 2


def test_a_rerun_leaves_no_stale_shard(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("sample_idx"), F.expr("id div 10").alias("shard_idx"), F.col("id").alias("frame_id"))
    TS.write_tar_shards(df, str(tmp_path), ["frame_id"])
    manifest = TS.write_tar_shards(df.where("id < 15"), str(tmp_path), ["frame_id"])
    assert sorted(os.listdir(tmp_path)) == ["_manifest", "shard-000000.tar", "shard-000001.tar"]
    assert sorted(r["sample_count"] for r in manifest.collect()) == [5, 10]
    assert TS.read_tar_shards(spark, str(tmp_path), {"frame_id": "bigint"}).count() == 15
    TS.write_tar_shards(df.where("false"), str(tmp_path), ["frame_id"])
    assert os.listdir(tmp_path) == ["_manifest"] and TS.read_manifest(spark, str(tmp_path)).count() == 0


def test_a_failed_write_changes_nothing(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("sample_idx"), F.expr("id div 10").alias("shard_idx"), F.col("id").cast("double").alias("x"))
    TS.write_tar_shards(df, str(tmp_path), ["x"])
    before = {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path) if f.endswith(".tar")}
    broken = df.withColumn("x", F.when(F.col("sample_idx") == 35, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x") + 1))
    with pytest.raises(Exception, match="broken"):
        TS.write_tar_shards(broken, str(tmp_path), ["x"])
    assert {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path) if f.endswith(".tar")} == before
    assert sorted(os.listdir(tmp_path)) == ["_manifest", *sorted(before)]


def test_archives_are_dealt_over_tasks(spark, tmp_path):
    """Two hundred small archives are read, and counted, by more than one task."""
    df = spark.range(400).select(F.col("id").alias("sample_idx"), F.expr("id div 2").alias("shard_idx"), F.col("id").alias("frame_id"))
    TS.write_tar_shards(df, str(tmp_path), ["frame_id"])
    for rows in (TS.read_tar_shards(spark, str(tmp_path), {"frame_id": "bigint"}), TS.shard_counts(spark, str(tmp_path))):
        tasks = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) == 8 and max(r["count"] for r in tasks) < 0.4 * sum(r["count"] for r in tasks)
    assert len(TS.read_tar_shards(spark, str(tmp_path), {"frame_id": "bigint"}, tasks=3).select(F.spark_partition_id().alias("p")).distinct().collect()) == 3


def test_sets_are_laid_out_and_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(f"{run:03}", s, e, i) for run in range(3) for s in (1, 2) for e in range(5) for i in range(4)], "run_id string, set_idx bigint, episode_id int, x int")
    T.write_episode_sets(rows, str(tmp_path), ["episode_id", "x"])
    back = T.read_episode_sets(spark, str(tmp_path))
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = back.where("run_id = '001' AND set_idx = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "run_id" in filters and "set_idx" in filters
    assert len(one.inputFiles()) == 6 and one.select(F.input_file_name()).distinct().count() == 1
    T.write_episode_sets(rows.where("run_id = '001' AND set_idx = 2 AND x = 0"), str(tmp_path), spread=3)
    after = T.read_episode_sets(spark, str(tmp_path))
    assert after.where("run_id = '001' AND set_idx = 2").count() == 5 and after.count() == 3 * 2 * 20 - 15


def test_folders_of_a_job_can_be_cleared(spark, tmp_path):
    from wayframe.sources import shared

    before = shared.made(spark)
    kept, gone = shared.settle(spark.range(5), "kept"), shared.settle(spark.range(7), "gone")
    new = [p for p in shared.made(spark) if p not in before]
    assert kept.count() == 5 and len(new) == 2 and all(os.path.isdir(p) for p in new)
    other = tmp_path / "other"
    other.mkdir()
    shared.clear(spark, [new[1], str(other)])
    assert os.path.isdir(new[0]) and not os.path.exists(new[1]) and other.is_dir() and new[1] not in shared.made(spark)
    assert kept.count() == 5
    shared.clear(spark, new)
    assert not os.path.exists(new[0])


def test_many_sets_share_folders_and_one_is_written_again_alone(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.expr("id div 6 + 1").alias("set_idx"), (F.col("id") % 3).cast("int").alias("episode_id"), F.col("id").alias("x"),
    )
    T.write_episode_sets(rows, str(tmp_path))
    folders = [d for d, _, names in os.walk(tmp_path) if any(n.endswith(".parquet") for n in names)]
    assert len(folders) == 4  # 5000 sets of two runs
    back = T.read_episode_sets(spark, str(tmp_path))
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = "run_id = 'r1' AND set_idx = 4100"
    T.write_episode_sets(rows.where(f"{one} AND episode_id <> 0").withColumn("x", -F.col("x")), str(tmp_path), spread=3)
    after = T.read_episode_sets(spark, str(tmp_path))
    want = [r for r in rows.where(f"NOT ({one})").collect()] + rows.where(f"{one} AND episode_id <> 0").withColumn("x", -F.col("x")).collect()
    assert sorted(map(tuple, after.select(rows.columns).collect())) == sorted(map(tuple, want))


def test_archives_are_small_and_plain_ones_are_read(spark, tmp_path):
    import tarfile

    df = spark.range(2000).select(F.col("id").alias("sample_idx"), F.expr("id div 1000").alias("shard_idx"), F.col("id").alias("frame_id"))
    fields = {"frame_id": "bigint"}
    size = {}
    for level in (1, 0):
        path = tmp_path / str(level)
        TS.write_tar_shards(df, str(path), ["frame_id"], level=level)
        size[level] = sum(p.stat().st_size for p in path.glob("*.tar"))
        assert sorted(r["frame_id"] for r in TS.read_tar_shards(spark, str(path), fields).collect()) == list(range(2000))
        assert {r["sample_count"] for r in TS.shard_counts(spark, str(path)).collect()} == {1000}
        with tarfile.open(path / "shard-000001.tar") as tar:
            assert len(tar.getnames()) == 1001
    assert size[1] * 10 < size[0]
    cut = tmp_path / "1" / "shard-000001.tar"
    cut.write_bytes(cut.read_bytes()[:5000])
    got = {r["file"]: r["reason"] for r in TS.shard_counts(spark, str(tmp_path / "1")).collect()}
    assert got["shard-000000.tar"] is None and got["shard-000001.tar"].startswith("malformed archive")


def test_members_are_framed_as_tarfile_does():
    import io
    import tarfile

    for name, payload in (("00000001.x.npy", b"a" * 137), ("12345678.route.npy", b""), ("00000000.y.npy", b"b" * 512)):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            TS._member(tar, name, payload)
        mine = TS._Framer(len(payload)).frame(name.encode(), payload)
        assert out.getvalue()[: len(mine)] == mine and len(mine) % 512 == 0


class _Here:
    """Runs a function over the archives of a folder in this process."""

    def __init__(self, paths):
        self.paths = [f"file:{p}" for p in paths]

    def mapInPandas(self, f, schema):
        import pandas as pd

        return [tuple(r) for out in f(iter([pd.DataFrame({"path": self.paths})])) for r in out.itertuples(index=False)]

    def mapInArrow(self, f, schema):
        import pyarrow as pa

        return [tuple(r.values()) for out in f(iter([pa.RecordBatch.from_pydict({"path": self.paths})])) for r in out.to_pylist()]


def test_alike_samples_are_not_read_and_written_one_by_one(spark, tmp_path, monkeypatch):
    """The work a member takes: headers parsed in reading, arrays made of lists in writing."""
    import json
    import tarfile

    import numpy as np
    import pyarrow as pa

    n, calls = 3000, {"read": 0, "written": 0}

    def counted(f, what):
        def g(*a, **k):
            calls[what] += 1
            return f(*a, **k)

        return g

    batch = pa.RecordBatch.from_pydict({
        "shard_idx": pa.array([0] * n), "sample_idx": pa.array(range(n)), "x": pa.array([i / 4 if i else None for i in range(n)]),
        "v": pa.array([[i * 1.0, None] for i in range(n)], pa.list_(pa.float64())), "done": pa.array([i % 3 == 0 for i in range(n)]),
    })
    dtypes = {"x": "float64", "v": "float64", "done": "bool"}
    writer = TS._TarWriter(str(tmp_path), {"index": "sample_idx", "shard": "shard_idx", "dtypes": json.dumps(dtypes), "level": "1"})
    monkeypatch.setattr(np, "asarray", counted(np.asarray, "written"))
    writer.commit([writer.write(iter([batch]))])
    assert calls["written"] < n // 10
    monkeypatch.setattr(tarfile.TarInfo, "frombuf", counted(tarfile.TarInfo.frombuf, "read"))
    with monkeypatch.context() as m:
        m.setattr(TS, "_archives", lambda *a: _Here([tmp_path / "shard-000000.tar"]))
        got = TS.read_tar_shards(spark, str(tmp_path), {"x": "double", "v": "array<double>", "done": "boolean"})
    assert calls["read"] < n // 10
    assert got == [("shard-000000.tar", i, i / 4 if i else None, [i * 1.0, None], i % 3 == 0) for i in range(n)]


def test_rows_alike_or_not_are_written_as_tarfile_does(tmp_path):
    """Numbers that get longer, shards that end inside a batch, ragged and absent lists: tarfile and numpy read what was put in."""
    import io
    import json
    import tarfile

    import numpy as np
    import pyarrow as pa

    def batch(numbers, vs):
        n = len(numbers)
        return pa.RecordBatch.from_pydict({
            "s": pa.array([i // 700 for i in numbers], pa.int32()), "i": pa.array(numbers, pa.int64()), "k": pa.array([i * 3 for i in numbers], pa.int64()),
            "b": pa.array([None if i % 5 == 0 else i % 2 == 0 for i in numbers], pa.bool_()), "v": pa.array(vs, pa.list_(pa.list_(pa.float64()))), "w" * 90: pa.array([1.5] * n),
        })

    even = list(range(99_999_300, 100_000_500))
    rows = [batch(even, [[[i / 2, None], [0.0, 1.0]] for i in even])]
    odd = list(range(100_000_500, 100_000_520))
    rows.append(batch(odd, [None if i % 3 == 0 else [[1.0] * (i % 4)] for i in odd]))
    for names in (["k", "b", "v"], ["k", "b", "v", "w" * 90]):
        dtypes = {f: {"k": "int64", "b": "bool"}.get(f, "float32") for f in names}
        path = tmp_path / str(len(names))
        writer = TS._TarWriter(str(path), {"index": "i", "shard": "s", "dtypes": json.dumps(dtypes), "level": "1"})
        writer.commit([writer.write(iter(rows))])
        seen = []
        for p in sorted(path.glob("*.tar")):
            with tarfile.open(p) as tar:
                for m in tar:
                    if m.name.endswith(".npy"):
                        a = np.load(io.BytesIO(tar.extractfile(m).read()))
                        seen.append((m.name, a.dtype.str, a.shape, a.tobytes()))
        want = []
        for r in (r for b in rows for r in b.to_pylist()):
            for f in names:
                a = np.asarray(r[f], dtype=dtypes[f])
                want.append((f"{r['i']:08d}.{f}.npy", a.dtype.str, a.shape, a.tobytes()))
        assert seen == want


def test_odd_archives_are_read_member_by_member(spark, tmp_path, monkeypatch):
    """Runs of alike samples between ragged ones, numbers twice, other files, missing and additional fields, long names, other dtypes, cut archives."""
    import io
    import tarfile

    import numpy as np

    members, want, x = [], {}, 0

    def put(i, **fields):
        for f, v in fields.items():
            out = io.BytesIO()
            np.save(out, v)
            members.append((f"{i:08d}.{f}.npy", out.getvalue()))
            want.setdefault(i, {})[f] = v

    for i in range(900):
        put(i, a=np.int64(i), v=np.array([i, np.nan if i % 7 == 0 else 1.0]))
    put(899, a=np.int64(-1))
    for i in range(900, 1000):
        put(i, a=np.int64(i), v=np.arange(i % 3) * 0.5)
    for i in range(1000, 1600):
        if i % 50 == 0:
            members.append((f"{i:08d}.txt", b"note"))
        if i % 90 == 0:
            put(i, a=np.int64(i))
        elif i % 91 == 0:
            put(i, a=np.int64(i), v=np.ones(2), more=np.ones(3))
        elif i % 93 == 0:
            put(i, a=np.int64(i), v=np.ones(2))
            put(i, a=np.int64(2 * i), v=np.ones(2) * 2)
        else:
            put(i, a=np.int64(i), v=np.array([0.5, i]))
    for i in range(1600, 1800):
        put(i, a=np.int64(i), v=np.array([0.5, i], dtype=[">f8", "f4"][i % 2]))
    for i in range(99_999_900, 100_000_100):
        put(i, v=np.array([0.5, i]), a=np.int64(i))
    for i in range(100_000_100, 100_000_103):
        put(i, a=np.int64(i), **{"z" * 100: np.zeros(1)}, v=np.ones(2))
    for i in range(100_000_103, 100_000_400):
        put(i, a=np.int64(i), v=np.ones(2))
    path = tmp_path / "shard-000000.tar"
    with tarfile.open(path, "w") as tar:
        for k, (name, payload) in enumerate(members):
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(payload), 5 if 200 < k < 300 else 0
            tar.addfile(info, io.BytesIO(payload))
    plain = lambda v: None if v is None else int(v) if v.shape == () else [None if e != e else float(e) for e in v]
    rows = [("shard-000000.tar", i, plain(f.get("a")), plain(f.get("v"))) for i, f in want.items()]
    monkeypatch.setattr(TS, "_archives", lambda *a: _Here([path]))
    fields = {"a": "bigint", "v": "array<double>"}
    assert TS.read_tar_shards(spark, str(tmp_path), fields) == [r for r in rows if r[3] is not None]
    assert TS.read_tar_shards(spark, str(tmp_path), fields, required=[]) == rows
    assert TS.read_tar_shards(spark, str(tmp_path), {**fields, "none": "double"}) == []
    assert TS.read_tar_shards(spark, str(tmp_path), {"a": "bigint"}) == [r[:3] for r in rows]
    whole = path.read_bytes()
    for cut in (whole[:100_000], b"", b"x" * 600):
        path.write_bytes(cut)
        with pytest.raises(tarfile.ReadError):
            TS.read_tar_shards(spark, str(tmp_path), fields)
    # A header that is none, or cut, ends an archive, as in tarfile.
    for at in (49 * 2048, 49 * 2048 + 300):
        path.write_bytes(whole[:at])
        assert TS.read_tar_shards(spark, str(tmp_path), fields) == rows[:49]
    path.write_bytes(whole[: 300 * 2048] + b"x" * 512 + whole[300 * 2048 + 512 :])
    assert TS.read_tar_shards(spark, str(tmp_path), fields) == rows[:300]


def test_nulls_come_back_from_archives(spark, tmp_path):
    """Alone and in lists, in runs of alike samples and between ragged ones."""
    i = F.col("id")
    df = spark.range(600).select(
        i.alias("sample_idx"), F.lit(0).alias("shard_idx"), F.when(i % 5 != 0, i / 2).alias("x"),
        F.when(i < 500, F.array(F.when(i % 7 != 0, i * 1.0), F.lit(2.0))).otherwise(F.transform(F.sequence(F.lit(1), i % 3 + 1), lambda e: F.when(e > 1, e * 1.0))).alias("v"),
    )
    TS.write_tar_shards(df, str(tmp_path), ["x", "v"])
    back = TS.read_tar_shards(spark, str(tmp_path), {"x": "double", "v": "array<double>"}).orderBy("sample_idx")
    assert [tuple(r) for r in back.select("sample_idx", "x", "v").collect()] == [tuple(r) for r in df.orderBy("sample_idx").select("sample_idx", "x", "v").collect()]
