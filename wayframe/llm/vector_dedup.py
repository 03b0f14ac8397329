"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its NEAR nearest reference points (pivots), in order of cosine, both taken without the sample's mean.  Inverted lists, one
per combination of SHARED pivots, bring together the vectors that share that many of them.  In a list,
candidates are verified exactly; a pair that meets in several lists is counted in one of them only, the
list of its smallest shared pivots.  Lists give back one row per vector (links, and a representative
of what it is connected to in the list), so pairs are never written out.

Pivots come from a bounded sample of SAMPLE vectors, each furthest from those before; every vector is indexed.
Equal vectors are indexed once and weighted by their number.  Long lists are split into blocks, and
block pairs are dealt out as tasks of their own, so a dense region is compared completely.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayframe.llm.common import chunk_pairs, components, runs, settle

SAMPLE, PIVOTS, APART = 4096, 256, 0.8
NEAR, SHARED = 8, 3
THRESHOLD = 0.95
BLOCK = 512


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows (rid, vec_id, same, vec): vec is the unit vector's doubles, or null if it can't link; same marks equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            vec, same = [], []
            for v in b.column(1).to_pylist():
                unit = None
                if v and None not in v:
                    x = np.array(v, dtype=np.float64)
                    norm = math.hypot(*x) if np.isfinite(x).all() else 0.0
                    if 0 < norm < math.inf:
                        unit = x / norm
                        unit = (unit / np.linalg.norm(unit)).tobytes()
                vec.append(unit)
                same.append(unit and hashlib.blake2b(np.array(v, dtype=np.float64).tobytes(), digest_size=16).digest())
            rid = pa.array(np.arange(at, at + len(vec), dtype=np.int64))
            at += len(vec)
            yield pa.RecordBatch.from_arrays([rid, b.column(0).cast(pa.int64()), pa.array(same, pa.binary()), pa.array(vec, pa.binary())], names=["rid", "vec_id", "same", "vec"])

    return vectors.select("vec_id", column).mapInArrow(run, "rid bigint, vec_id bigint, same binary, vec binary")


def centred(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Unit vectors of what sets the rows apart from the centre; a row at the centre stays zero."""
    d = m - centre
    norm = np.linalg.norm(d, axis=1, keepdims=True)
    return d / np.where(norm > 0, norm, 1.0)


def pivots_of(sample: np.ndarray, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean, and up to ``count`` centred vectors of it, each the one furthest from those before.

    Vectors that share a mean are all near the same few points; what is left without the mean tells them apart.
    """
    centre = sample.mean(axis=0)
    m = centred(sample, centre)
    far, picked = np.full(len(m), np.inf), []
    for _ in range(min(count, len(m))):
        i = int(far.argmax())
        if far[i] <= 1 - APART:
            break
        picked.append(i)
        far = np.minimum(far, 1 - m @ m[i])
    return centre, m[picked]


def choose_pivots(reps: DataFrame, sample: int = SAMPLE, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """pivots_of() a sample whose size is bounded and whose choice is fixed by hashes."""
    rows = [np.frombuffer(r["vec"], np.float64) for r in reps.orderBy(F.xxhash64("same"), "same").limit(sample).select("vec").collect()]
    if not rows:
        return np.zeros(1), np.zeros((0, 1))
    dim = max(len(x) for x in rows)
    return pivots_of(np.stack([np.pad(x, (0, dim - len(x))) for x in rows]), count)


def nearest(m: np.ndarray, centre: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The sorted numbers of each row's nearest pivots."""
    order = np.argsort(-(centred(m, centre) @ pivots.T), axis=1, kind="stable")
    return np.sort(order[:, : min(near, len(pivots))], axis=1)


def keys_of(near: np.ndarray, shared: int) -> np.ndarray:
    """One number per combination of ``shared`` of the (sorted) pivots of each row."""
    out = []
    for c in itertools.combinations(range(near.shape[1]), shared):
        k = np.zeros(len(near), np.int64)
        for i in c:
            k = k * 65536 + near[:, i] + 1
        out.append(k)
    return np.stack(out, axis=1) if out else np.zeros((len(near), 0), np.int64)


def described(reps: DataFrame, centre: np.ndarray, pivots: np.ndarray, near: int, shared: int) -> DataFrame:
    """(rep, weight, near, vec) to (key, rep, near): near holds the sorted numbers of the nearest pivots as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.zeros((b.num_rows, pivots.shape[1]))
            for i, raw in enumerate(b.column(1).to_pylist()):
                v = np.frombuffer(raw, np.float64)[: pivots.shape[1]]
                m[i, : len(v)] = v
            first = nearest(m, centre, pivots, near)
            keys = keys_of(first, min(shared, first.shape[1]))
            rep = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            raw = np.repeat(np.array([x.tobytes() for x in first.astype("<u2")], dtype=object), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep), pa.array(raw.tolist(), pa.binary())], names=["key", "rep", "near"])

    return reps.select("rep", "vec").mapInArrow(run, "key bigint, rep bigint, near binary")


def labels_in(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row is connected to, by the links (row, column) of a block pair."""
    out = ids.copy()
    while True:
        low = np.minimum(out, np.where(linked, out[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == out).all():
            return out
        out = low


def verified(lists: DataFrame, threshold: float, shared: int) -> DataFrame:
    """(key, i, j, block, rep, weight, near, vec), sorted by key, i, j, to (rep, links, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in runs(batches, 3):
            key, bi, bj = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            block, rep, weight = (t.column(c).to_numpy() for c in ("block", "rep", "weight"))
            vec, near = t.column("vec").to_pylist(), t.column("near").to_pylist()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in itertools.pairwise(borders):
                if hi - lo < 2:
                    continue
                size = max(len(vec[r]) for r in range(lo, hi)) // 8
                own = np.array([len(vec[r]) // 8 for r in range(lo, hi)])
                m = np.zeros((hi - lo, size))
                for r in range(lo, hi):
                    m[r - lo, : own[r - lo]] = np.frombuffer(vec[r], np.float64)
                linked = m @ m.T >= threshold
                linked &= own[:, None] == own[None, :]
                np.fill_diagonal(linked, False)
                if bi[lo] != bj[lo]:  # pairs of one block are compared where that block meets itself
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                if not linked.any():
                    continue
                p = np.frombuffer(b"".join(near[lo:hi]), "<u2").reshape(hi - lo, -1)
                # The pair's smallest shared pivots make up this list's key if it shares no others up to the key's last.
                last = int(key[lo] % 65536) - 1
                hot = np.zeros((hi - lo, last + 1), np.float32)
                rows, cols = np.nonzero(p <= last)
                hot[rows, p[rows, cols]] = 1
                linked &= (hot @ hot.T).astype(np.int64) == min(shared, p.shape[1])
                ids, w = rep[lo:hi], weight[lo:hi]
                links = (linked * w[None, :]).sum(axis=1)
                some = links > 0
                if some.any():
                    out.append((ids[some], links[some], labels_in(linked, ids)[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["rep", "links", "label"])

    return lists.mapInArrow(run, "rep bigint, links bigint, label bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, near: int = NEAR, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """Per row (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing; so do vectors
    of different lengths.  Equal vectors link with each other.  Each row is a vector of its own, whether
    vec_ids are null or repeated; component_id is the smallest vec_id among the connected rows and
    null if none has one.  kept: vec_id = component_id.  An empty table gives an empty result.
    """
    rows = settle(prepared(vectors), "vectors")
    reps = rows.where("vec IS NOT NULL").groupBy("same").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight"))
    own = rows.select(F.col("rid").alias("_rid"), "vec")
    reps = settle(reps.join(own, F.col("rep") == F.col("_rid")).select("rep", "weight", "same", "vec"), "distinct_vectors")
    posted = settle(described(reps, *choose_pivots(reps), near, shared), "postings")
    long = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "_key")
    lists = posted.join(long, F.col("key") == F.col("_key")).drop("_key")
    lists = chunk_pairs(lists, ["key"], "n", F.xxhash64("rep", "key"), block)
    vec = reps.select(F.col("rep").alias("_rep"), "weight", "vec")
    lists = lists.join(vec, F.col("rep") == F.col("_rep")).select("key", "i", "j", "block", "rep", "weight", "near", "vec")
    found = settle(verified(lists.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), threshold, shared), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_linked")
    groups = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    by = reps.select("same", "rep", "weight").join(links, F.col("rep") == F.col("_linked"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    by = by.select(F.col("same").alias("_same"), "weight", "links", F.coalesce("component", "rep").alias("part"))
    out = rows.select("rid", "vec_id", "same").join(by, F.col("same") == F.col("_same"), "left")
    out = settle(out.select("rid", "vec_id", F.coalesce(F.expr("coalesce(links, 0) + weight - 1"), F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("part", "rid").alias("part")), "vector_links")
    least = out.groupBy("part").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("part", "_part")
    out = out.join(least, F.col("part") == F.col("_part"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
u AS MATERIALIZED (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.x = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""
