"""Queries for indexing, sharding, splitting, shuffling, batching and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.catalog import ctes as Q
from wayframe.catalog.registry import query
from wayframe.catalog.views import FILE_ORDER, files, frames, r6, tensors
from wayframe.operators import sampling as SA
from wayframe.operators import sharding as SH

PER_SHARD = 1000
KEY = ["episode_ord", "frame_id"]


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SH.index_and_shard(files(spark, sf_dir), FILE_ORDER, PER_SHARD)


SHARDED = Q.FILES + f""",
sharded AS (SELECT *, sample_idx // {PER_SHARD} AS shard_idx FROM (SELECT *,
  row_number() OVER (ORDER BY file, {', '.join(FILE_ORDER)}) - 1 AS sample_idx FROM files))"""


@query("index_and_shard", f"WITH {SHARDED} SELECT sample_idx, shard_idx, file, l_orderkey, l_linenumber, l_partkey FROM sharded")
def _(spark, sf):
    return sharded(spark, sf).select("sample_idx", "shard_idx", "file", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "shard_summary",
    f"WITH {SHARDED} SELECT shard_idx, min(sample_idx) AS first_sample_idx, max(sample_idx) AS last_sample_idx, count(*) AS sample_count FROM sharded GROUP BY 1",
)
def _(spark, sf):
    return SH.shard_summary(sharded(spark, sf))


def in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are episodes of the runs given by flag and status; small lines are rejected frames."""
    li = files(spark, sf_dir).where("l_quantity > 25")
    return SH.assign_episode_sets(li.select(F.col("file").alias("run_id"), F.col("l_orderkey").alias("episode_ord"), "l_partkey"))


SETS = Q.FILES + """,
live AS (SELECT file AS run_id, l_orderkey AS episode_ord, l_partkey FROM files WHERE l_quantity > 25),
sets AS (SELECT *, (rk - 1) // 5 + 1 AS set_idx, CAST((rk - 1) % 5 AS INTEGER) AS episode_id FROM
  (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY episode_ord) AS rk FROM live))"""


@query("assign_episode_sets", f"WITH {SETS} SELECT run_id, episode_ord, l_partkey, set_idx, episode_id FROM sets")
def _(spark, sf):
    return in_sets(spark, sf).select("run_id", "episode_ord", "l_partkey", "set_idx", "episode_id")


@query(
    "episode_set_metadata",
    f"""WITH {SETS}, per AS (SELECT run_id, set_idx, episode_id, count(*) AS n FROM sets GROUP BY ALL),
e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY run_id, set_idx ORDER BY episode_id) AS BIGINT) AS e FROM per)
SELECT run_id, set_idx, '0,' || string_agg(CAST(e AS VARCHAR), ',' ORDER BY episode_id) AS boundaries, count(*) AS n_episodes, '2.2' AS version FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    m = SH.episode_set_metadata(in_sets(spark, sf), has_rl_fields=True)
    text = F.array_join(F.transform("episode_boundaries", lambda b: b.cast("string")), ",")
    return m.select("run_id", "set_idx", text.alias("boundaries"), "n_episodes", "version")


@query(
    "reconcile_shards",
    f"""WITH {SHARDED}, c AS (SELECT shard_idx, CASE WHEN shard_idx % 3 <> 1 THEN count(*) END AS sample_count FROM sharded GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY shard_idx) - 1 AS pos FROM c)
SELECT shard_idx, CASE WHEN sample_count > 0 THEN sample_count WHEN 5500 - pos * 1000 > 0 THEN least(1000, 5500 - pos * 1000) ELSE 1000 END AS used_count,
  CASE WHEN sample_count > 0 THEN 'counted' ELSE 'default' END AS source FROM r""",
)
def _(spark, sf):
    c = sharded(spark, sf).groupBy("shard_idx").agg(F.count(F.lit(1)).alias("n"))
    c = c.select("shard_idx", F.when(F.col("shard_idx") % 3 != 1, F.col("n")).alias("sample_count"))
    return SH.reconcile_shards(c, 5500, PER_SHARD)


@query(
    "reconcile_total",
    f"""WITH {SHARDED} SELECT count(*) AS total_from_shards, CAST(5500 AS BIGINT) AS total_from_metadata, count(*) <> 5500 AS differs, CAST(0 AS BIGINT) AS shards_without_count FROM sharded""",
)
def _(spark, sf):
    c = SH.shard_summary(sharded(spark, sf))
    return SH.reconcile_total(SH.reconcile_shards(c, 5500, PER_SHARD), 5500)


#: What is done to the copy: field, problem, and which samples (never those of the lines above for the same field).
DAMAGE = (
    ("l_partkey", "value", "sample_idx % 89 = 3"),
    ("l_quantity", "missing", "sample_idx % 61 = 2"),
    ("l_quantity", "value", "sample_idx % 83 = 7 AND sample_idx % 61 <> 2"),
    ("l_tax", "extra", "sample_idx % 59 = 4"),
    ("route", "shape", "sample_idx % 79 = 9"),
    ("route", "missing", "sample_idx % 73 = 1 AND sample_idx % 79 <> 9"),
    ("objects", "shape", "sample_idx % 71 = 8"),
    ("future_xy", "value", "sample_idx % 67 = 6"),
    ("future_xy", "value", "sample_idx % 53 = 1 AND sample_idx % 67 <> 6"),
    ("future_xy", "value", "sample_idx % 47 = 2 AND sample_idx % 53 <> 1 AND sample_idx % 67 <> 6"),
)


@query(
    "verify_conversion",
    f"""WITH {SHARDED} SELECT sample_idx, '*' AS field, 'missing' AS problem FROM sharded WHERE sample_idx % 97 = 5
  UNION ALL SELECT -1 - sample_idx, '*', 'extra' FROM sharded WHERE sample_idx % 101 = 7
  """
    + " ".join(f"UNION ALL SELECT sample_idx, '{f}', '{p}' FROM sharded WHERE sample_idx % 97 <> 5 AND {c}" for f, p, c in DAMAGE),
)
def _(spark, sf):
    """A copy with known damage: every damaged sample, and no other, is reported."""
    i = F.col("sample_idx")
    pair = lambda *xs: F.array(*[F.array(*x) for x in xs])
    full = sharded(spark, sf).select(
        "sample_idx", "l_partkey", "l_quantity", "l_tax",
        pair(("l_tax", "l_discount"), ("l_quantity", "l_tax")).alias("route"),
        pair(("l_quantity", "l_tax", "l_discount"), ("l_tax", "l_tax", "l_tax")).alias("objects"),
        pair(("l_discount", "l_quantity"), ("l_tax", "l_quantity")).alias("future_xy"),
    )
    src = full.withColumn("l_tax", F.when(i % 59 != 4, F.col("l_tax")))
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    second = lambda x: F.array(F.col("future_xy")[0], F.array(x, F.col("l_quantity")))
    out = full.where(i % 97 != 5).select(
        "sample_idx",
        F.when(i % 89 == 3, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("l_partkey"),
        F.when(i % 61 == 2, none).when(i % 83 == 7, F.col("l_quantity") + 0.001).otherwise(F.col("l_quantity") + 1e-7).alias("l_quantity"),
        "l_tax",
        F.when(i % 79 == 9, F.slice("route", 1, 1)).when(i % 73 != 1, F.col("route")).alias("route"),
        F.when(i % 71 == 8, F.array(F.slice(F.col("objects")[0], 1, 2), F.col("objects")[1])).otherwise(F.col("objects")).alias("objects"),
        F.when(i % 67 == 6, second(none)).when(i % 53 == 1, second(nan)).when(i % 47 == 2, second(F.col("l_tax") + 0.01)).otherwise(F.col("future_xy")).alias("future_xy"),
    )
    added = full.where(i % 101 == 7).withColumn("sample_idx", -1 - i)
    return SH.verify_conversion(src, out.unionByName(added), ["l_partkey", "l_quantity", "l_tax", "route", "objects", "future_xy"])


@query(
    "split_by_shard",
    f"""WITH {SHARDED}, s AS (SELECT DISTINCT shard_idx FROM sharded), r AS (SELECT shard_idx, row_number() OVER (ORDER BY shard_idx) - 1 AS pos, count(*) OVER () AS n FROM s),
p AS (SELECT shard_idx, CASE WHEN pos < greatest(CAST(floor(n * 8e-1) AS BIGINT), 1) THEN 'train' ELSE 'val' END AS part FROM r)
SELECT part, sample_idx FROM sharded JOIN p USING (shard_idx)""",
)
def _(spark, sf):
    d = sharded(spark, sf)
    both = [SA.split_by_shard(d, part).select(F.lit(part).alias("part"), "sample_idx") for part in ("train", "val")]
    return both[0].unionByName(both[1])


SHUFFLED = SHARDED + f""",
shuffled AS (SELECT sample_idx, shard_idx, row_number() OVER (ORDER BY {Q.mix('shard_idx', 7)}, shard_idx, {Q.mix('sample_idx', 8)}, sample_idx) - 1 AS position FROM sharded)"""


@query("shuffle", f"WITH {SHUFFLED} SELECT sample_idx, position FROM shuffled")
def _(spark, sf):
    return SA.shuffle_rank(sharded(spark, sf), 7).select("sample_idx", "position")


@query(
    "batches",
    f"""WITH {SHUFFLED}, b AS (SELECT position // 64 AS batch, string_agg(CAST(sample_idx AS VARCHAR), ',' ORDER BY position) AS samples, count(*) AS n FROM shuffled GROUP BY 1)
SELECT batch, samples FROM b WHERE n = 64""",
)
def _(spark, sf):
    b = SA.batches(SA.shuffle_rank(sharded(spark, sf), 7), 64)
    return b.select("batch", F.array_join(F.transform("sample_idx", lambda i: i.cast("string")), ",").alias("samples"))


@query("sample_indices", f"WITH {SHARDED} SELECT sample_idx FROM sharded ORDER BY {Q.mix('sample_idx', 42)}, sample_idx LIMIT 100")
def _(spark, sf):
    return SA.sample_indices(sharded(spark, sf), 100)


@query("head_n", f"WITH {SHARDED} SELECT sample_idx, l_orderkey FROM sharded ORDER BY sample_idx LIMIT 250")
def _(spark, sf):
    return SA.head_n(sharded(spark, sf), 250).select("sample_idx", "l_orderkey")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir).select(
        F.col("vec_id").alias("sample_idx"),
        "ego_vec",
        "objects",
        F.slice("values", 56, 4).alias("future_v"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("values", i * 2 + 20, F.lit(2))).alias("future_xy"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("values", i * 2 + 30, F.lit(2))).alias("route"),
    )


STRONG = {"p_drop_objects": 0.2, "p_ego_noise": 0.5, "p_speed_scale": 0.5, "p_trajectory_noise": 0.5, "p_lateral_shift": 0.5}
SEED = 3


def _hit(draw: int, p: str) -> str:
    return f"{Q.uniform('vec_id', SEED + draw)} < {p}"


FACTOR = f"({Q.uniform('vec_id', SEED + 4)} * 4e-1 + 8e-1)"
SHIFT = f"({Q.uniform('vec_id', SEED + 7)} * 1e-1 - 5e-2)"


@query(
    "augment_vectors",
    f"""WITH {Q.TENSORS},
e AS (SELECT vec_id, j, v[j] AS raw, CASE WHEN {_hit(2, '5e-1')} THEN least(greatest(v[j] + {Q.normal('vec_id, j - 1', SEED + 10)} * 2e-2, -1), 1) ELSE v[j] END AS x
      FROM tensors CROSS JOIN range(1, 15) r(j)),
f AS (SELECT vec_id, j, CASE WHEN {_hit(3, '5e-1')} THEN least(greatest(v[55 + j] * {FACTOR}, 0), 1) ELSE v[55 + j] END AS x FROM tensors CROSS JOIN range(1, 5) r(j))
SELECT vec_id AS sample_idx, 'ego_vec' AS field, CAST(j - 1 AS INTEGER) AS j, {Q.r6(f"CASE WHEN j = 1 AND {_hit(3, '5e-1')} THEN least(greatest(x * {FACTOR}, 0), 1) ELSE x END", 'value')} FROM e
UNION ALL SELECT vec_id, 'future_v', CAST(j - 1 AS INTEGER), {Q.r6('x', 'value')} FROM f""",
)
def _(spark, sf):
    a = SA.augment(normalised(spark, sf), SEED, STRONG)
    parts = [a.select("sample_idx", F.lit(c).alias("field"), F.posexplode(c).alias("j", "value")) for c in ("ego_vec", "future_v")]
    return parts[0].unionByName(parts[1]).select("sample_idx", "field", "j", r6("value"))


@query(
    "augment_points",
    f"""WITH {Q.TENSORS},
p AS (SELECT vec_id, i, j, v[20 + i * 2 + j] AS f, v[30 + i * 2 + j] AS r FROM tensors CROSS JOIN range(0, 4) a(i) CROSS JOIN range(0, 2) b(j)),
n AS (SELECT *, CASE WHEN {_hit(5, '5e-1')} THEN least(greatest(f + {Q.normal('vec_id, i, j', SEED + 20)} * 2e-2, -1), 1) ELSE f END AS g FROM p)
SELECT vec_id AS sample_idx, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  {Q.r6(f"CASE WHEN j = 1 AND {_hit(6, '5e-1')} THEN least(greatest(g + {SHIFT}, -1), 1) ELSE g END", 'future')},
  {Q.r6(f"CASE WHEN j = 1 AND {_hit(6, '5e-1')} THEN least(greatest(r + {SHIFT}, -1), 1) ELSE r END", 'route')} FROM n""",
)
def _(spark, sf):
    a = SA.augment(normalised(spark, sf), SEED, STRONG)
    z = a.select("sample_idx", F.posexplode(F.arrays_zip("future_xy", "route")).alias("i", "q"))
    z = z.select("sample_idx", "i", F.posexplode(F.arrays_zip("q.future_xy", "q.route")).alias("j", "s"))
    return z.select("sample_idx", "i", "j", r6(F.col("s.future_xy"), "future"), r6(F.col("s.route"), "route"))


@query(
    "augment_objects",
    f"""WITH {Q.TENSORS}, o AS (SELECT vec_id, i, j, CASE WHEN {_hit(1, '2e-1')} THEN 0e0 ELSE v[i * 11 + j + 1] END AS x FROM tensors CROSS JOIN range(0, 5) a(i) CROSS JOIN range(0, 11) b(j))
SELECT vec_id AS sample_idx, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  {Q.r6(f"CASE WHEN j = 2 AND {_hit(6, '5e-1')} THEN least(greatest(x - {SHIFT}, -1), 1) ELSE x END", 'value')} FROM o""",
)
def _(spark, sf):
    a = SA.augment(normalised(spark, sf), SEED, STRONG).select("sample_idx", F.posexplode("objects").alias("i", "o"))
    return a.select("sample_idx", "i", F.posexplode("o").alias("j", "value")).select("sample_idx", "i", "j", r6("value"))


ANGLE = f"CASE WHEN {Q.uniform('vec_id', 5)} < 7e-1 THEN radians(({Q.uniform('vec_id', 6)} * 2 - 1) * 20) ELSE 0e0 END"


@query(
    "rotate_samples",
    f"""WITH {Q.TENSORS}, a AS (SELECT vec_id, v, cos(an) AS c, sin(an) AS s FROM (SELECT *, {ANGLE} AS an FROM tensors)),
o AS (SELECT vec_id, i, v[i * 11 + 2] * c - v[i * 11 + 3] * s AS x, v[i * 11 + 2] * s + v[i * 11 + 3] * c AS y, v[i * 11 + 4] * c + v[i * 11 + 5] * s AS sn,
  v[i * 11 + 5] * c - v[i * 11 + 4] * s AS cs, v[i * 11 + 8] * c - v[i * 11 + 9] * s AS vx, v[i * 11 + 8] * s + v[i * 11 + 9] * c AS vy,
  CASE WHEN i < 4 THEN v[30 + i * 2] * c - v[31 + i * 2] * s END AS rx, CASE WHEN i < 4 THEN v[20 + i * 2] * s + v[21 + i * 2] * c END AS fy FROM a CROSS JOIN range(0, 5) b(i))
SELECT vec_id AS sample_idx, CAST(i AS INTEGER) AS i, {', '.join(Q.r6(c, c) for c in ('x', 'y', 'sn', 'cs', 'vx', 'vy', 'rx', 'fy'))} FROM o""",
)
def _(spark, sf):
    r = SA.rotate_samples(SA.rotation(normalised(spark, sf), 5, 0.7))
    z = r.select("sample_idx", F.posexplode(F.arrays_zip("objects", "route", "future_xy")).alias("i", "q"))
    o = F.col("q.objects")
    cols = {"x": o[1], "y": o[2], "sn": o[3], "cs": o[4], "vx": o[7], "vy": o[8], "rx": F.col("q.route")[0], "fy": F.col("q.future_xy")[1]}
    return z.select("sample_idx", "i", *[r6(c, n) for n, c in cols.items()])


def _noisy(col: str, draw: int, std: str, lo: int) -> str:
    x = f"least(greatest({col} + {Q.normal('run_id, episode_ord, frame_id', 11 + draw)} * {std}, {lo}), 1)"
    return Q.r6(f"CASE WHEN {Q.uniform('run_id, episode_ord, frame_id', 11)} < 2e-1 THEN {x} ELSE {col} END", col)


@query(
    "inject_noise",
    f"""WITH {Q.FRAMES} SELECT episode_ord, frame_id, {_noisy('steer_norm', 10, '1e-1', -1)}, {_noisy('throttle', 20, '5e-2', 0)},
  {_noisy('brake', 30, '5e-2', 0)}, {Q.uniform('run_id, episode_ord, frame_id', 11)} < 2e-1 AS noise_injected FROM frames""",
)
def _(spark, sf):
    out = SA.inject_noise(frames(spark, sf), 11)
    return out.select(*KEY, r6("steer_norm"), r6("throttle"), r6("brake"), "noise_injected")
