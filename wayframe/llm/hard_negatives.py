"""Hard-negative mining by anchor spanning-tree bounds.

Anchors are cut into groups of at most GROUP, near ones together, and each group is spanned by a minimum spanning tree.
Candidates lie in blocks of at most CHUNK vectors.  Where a group meets a block, the root anchor's scores are computed
outright; a child's score differs from its parent's by at most the edge's length times the candidate's norm, so the
parent's score (or its bounds, where it was not computed) bounds the child's.  Only candidates whose bounds overlap the
child's window are scored again.  The window closes while blocks go by: its
lower end is the last of the best that an anchor has found already, or that the bounds of the block assure.

Two rounds: the positives of each anchor (the best rows of its label), then the best rows of other labels in
the window that each positive's score opens.  A task keeps a few rows per anchor of the groups at hand, and hands
on those; pairs are never written out.  Groups go out in batches of BATCH_BYTES, or one by one where a group is larger, so what is
broadcast is bounded whatever the number of anchors; candidates are read from a written table and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm.common import running, runs, settle

EVERY, RELABEL, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between LOW and HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
GROUP, CHUNK, TILE = 512, 2048, 8
#: Anchors' vectors that are broadcast at once.
BATCH_BYTES = 1 << 24
SAMPLE, PIVOTS = 1024, 64
#: Scaled norms stay below this, so that scores fit into a long with room for the window's arithmetic.
MOST = 2.0**29
NONE = np.iinfo(np.int64).min


def chunked(vectors: DataFrame, size: int = CHUNK) -> DataFrame:
    """Blocks (dim, n, rid, vec_id, known, label, vec) of up to ``size`` taking part, as packed arrays; known marks ids that aren't null."""

    def pack(dim: int, parts: list[tuple]) -> tuple:
        rid, ids, known, label, x = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((rid, ids, ~known))
        return (dim, len(rid), *[c[order].tobytes() for c in (rid, ids, known, label, x.astype(np.int32))])

    def out(blocks: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], k) for i, k in enumerate(kinds)], names=["dim", "n", "rid", "vec_id", "known", "label", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        held: dict[int, list[tuple]] = {}
        count: dict[int, int] = {}
        for b in batches:
            vecs = b.column(2)
            rid = np.arange(at, at + b.num_rows, dtype=np.int64)
            at += b.num_rows
            ids, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            label, takes = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            start = vecs.offsets.to_numpy()
            width = np.where(vecs.is_valid().to_numpy(zero_copy_only=False) & takes, np.diff(start), 0)
            value = vecs.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            for dim in np.unique(width[width > 0]).tolist():
                at_dim = np.flatnonzero(width == dim)
                for lo in range(0, len(at_dim), size):
                    rows = at_dim[lo : lo + size]
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(value[start[rows][:, None] + np.arange(dim)] * SCALE)
                        fine = np.isfinite(x).all(axis=1)
                        fine[fine] = np.linalg.norm(x[fine], axis=1) < MOST
                    rows, x = rows[fine], x[fine]
                    while len(rows):
                        k = size - count.get(dim, 0)
                        held.setdefault(dim, []).append((rid[rows[:k]], ids[rows[:k]], known[rows[:k]], label[rows[:k]], x[:k]))
                        count[dim] = count.get(dim, 0) + len(rows[:k])
                        rows, x = rows[k:], x[k:]
                        if count[dim] == size:
                            yield out([pack(dim, held.pop(dim))])
                            del count[dim]
            if len(held) > 1 and sum(count.values()) > 2 * size:  # many lengths: let go of what is held
                yield out([pack(d, r) for d, r in held.items()])
                held, count = {}, {}
        for d, r in held.items():
            yield out([pack(d, r)])

    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label").cast("bigint") + 1) % LABELS).otherwise(F.col("label").cast("bigint"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), label.alias("label"), "embedding")
    return rows.mapInArrow(run, "dim int, n int, rid binary, vec_id binary, known binary, label binary, vec binary")


def unpack(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """The arrays rid, vec_id, known, label and vec of a block in row ``i``, without a copy."""
    dim = b.column("dim")[i].as_py()
    raw = [b.column(c)[i].as_buffer() for c in ("rid", "vec_id", "known", "label", "vec")]
    one = [np.frombuffer(x, k) for x, k in zip(raw, (np.int64, np.int64, np.bool_, np.int64))]
    return (*one, np.frombuffer(raw[4], np.int32).reshape(-1, dim))


def anchors_of(chunks: DataFrame) -> DataFrame:
    """Rows (dim, rid, vec_id, label, vec) whose vec_id is divisible by EVERY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                rid, vec_id, known, label, vec = unpack(b, row)
                dim = vec.shape[1]
                at = np.flatnonzero(known & (vec_id % EVERY == 0))
                if len(at):
                    raw = pa.array([vec[i].tobytes() for i in at], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), *[pa.array(x[at]) for x in (rid, vec_id, label)], raw], names=["dim", "rid", "vec_id", "label", "vec"])

    return chunks.mapInArrow(run, "dim int, rid bigint, vec_id bigint, label bigint, vec binary")


def grouped(anchors: DataFrame, size: int = GROUP) -> DataFrame:
    """Add ``grp``: anchors of one length in groups of up to ``size``, by label and nearest pivot; pivots come from a bounded sample."""
    sample = [np.frombuffer(r["vec"], np.int32).astype(np.float64) for r in anchors.orderBy(F.xxhash64("vec", "rid"), "rid").limit(SAMPLE).select("vec").collect()]
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(x) for x in sample}:
        m = np.stack([x for x in sample if len(x) == dim])
        far, picked = np.full(len(m), np.inf), []
        for _ in range(min(PIVOTS, len(m))):  # farthest first
            picked.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(m - m[picked[-1]], axis=1))
        pivots[dim] = m[picked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for dim, raw in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                p = pivots.get(dim)
                near.append(0 if p is None else int(np.linalg.norm(p - np.frombuffer(raw, np.int32), axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=[*b.schema.names, "near"])

    described = anchors.mapInArrow(run, "dim int, rid bigint, vec_id bigint, label bigint, vec binary, near int")
    numbered = running(described.withColumn("one", F.lit(1).cast("bigint")), ["dim", "label", "near", "rid"], ["one"])
    # One number per group: a group ends with its length of vector, too.
    cuts = numbered.groupBy("dim").agg(F.min("before_one").alias("first"), F.max("before_one").alias("last"))
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(F.col("dim").alias("_dim"), "first", F.coalesce(F.sum(F.expr(f"(last - first) div {size} + 1")).over(before), F.lit(0)).alias("base"))
    j = numbered.join(cuts, F.col("dim") == F.col("_dim"))
    return j.select("dim", "rid", "vec_id", "label", "vec", (F.col("base") + F.expr(f"(before_one - first) div {size}")).alias("grp"))


def spanning_tree(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): a minimum spanning tree, breadth first from the vector nearest to the mean; parent is a place in order, -1 at the root."""
    v = vec.astype(np.float64)
    n = len(v)
    root = int(np.linalg.norm(v - v.mean(axis=0), axis=1).argmin())
    near, via, inside = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    at, kids = root, [[] for _ in range(n)]
    for _ in range(n - 1):
        inside[at] = True
        d = np.linalg.norm(v - v[at], axis=1)
        closer = ~inside & (d < near)
        near[closer], via[closer] = d[closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        kids[via[at]].append(at)
    order, place, parent = [root], {root: 0}, [-1]
    for x in order:
        for k in kids[x]:
            place[k] = len(order)
            order.append(k)
            parent.append(place[x])
    order = np.array(order)
    parent = np.array(parent)
    length = np.linalg.norm(v[order] - v[order[np.maximum(parent, 0)]], axis=1)
    return order, parent, length


def packed_groups(anchors: DataFrame) -> DataFrame:
    """(dim, grp, rid, vec_id, label, vec, windows) to one row per group in tree order; windows is an array of positive scores or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in runs(batches, 1):
            rows = t.to_pylist()
            out = []
            for lo, hi in zip(borders, borders[1:]):
                part = rows[lo:hi]
                order, parent, length = spanning_tree(np.stack([np.frombuffer(r["vec"], np.int32) for r in part]))
                part = [part[i] for i in order]
                scores = np.full((len(part), POSITIVES), NONE)
                for i, r in enumerate(part):
                    scores[i, : len(r["scores"])] = r["scores"]
                arrays = [np.array([r[c] for r in part], np.int64) for c in ("rid", "label")]
                out.append((part[0]["grp"], part[0]["dim"], *[x.tobytes() for x in (*arrays, parent.astype(np.int64), length, scores)], b"".join(r["vec"] for r in part)))
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=GROUP_COLUMNS)

    ordered = anchors.select("grp", "dim", "rid", "label", "vec", "scores").repartition("grp").sortWithinPartitions("grp", "rid")
    return ordered.mapInArrow(run, "grp bigint, g_dim int, g_rid binary, g_label binary, g_parent binary, g_length binary, g_scores binary, g_vec binary")


GROUP_COLUMNS = ["grp", "g_dim", "g_rid", "g_label", "g_parent", "g_length", "g_scores", "g_vec"]


class Best:
    """The best ``k`` rows found so far for each line of a group: scores fall, ties by vec_id (null last)."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.score, self.id, self.rid = (np.full((lines, k), v) for v in (NONE, 0, 0))
        self.known = np.zeros((lines, k), bool)

    def take(self, lines: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, rid: np.ndarray) -> None:
        """``score`` is NONE where a candidate doesn't count; candidates stand by vec_id, null last, so the first of equals wins."""
        if not score.shape[1]:
            return
        score = score.copy()
        rows = np.arange(len(lines))
        found = [[self.score[lines]], [~self.known[lines]], [self.id[lines]], [self.rid[lines]]]
        for _ in range(self.k):
            at = score.argmax(axis=1)
            top = score[rows, at]
            if (top == NONE).all():
                break
            for f, x in zip(found, (top, ~known[at], ids[at], rid[at])):
                f.append(x[:, None])
            score[rows, at] = NONE
        s, unknown, i, r = (np.concatenate(f, axis=1) for f in found)
        # NONE has no opposite in its type, hence the complement
        order = np.lexsort((r, i, unknown, ~s), axis=1)[:, : self.k]
        for name, x in (("score", s), ("known", ~unknown), ("id", i), ("rid", r)):
            getattr(self, name)[lines] = np.take_along_axis(x, order, axis=1)


def sure(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest lower bound of each line: so many candidates score at least that."""
    return np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)


class Group:
    """One group of anchors in tree order, and what it has found."""

    def __init__(self, dim: int, rid: bytes, label: bytes, parent: bytes, length: bytes, scores: bytes, vec: bytes, negatives: bool):
        self.rid, self.label, self.parent = (np.frombuffer(x, np.int64) for x in (rid, label, parent))
        self.length = np.frombuffer(length, np.float64)
        self.positive = np.frombuffer(scores, np.int64).reshape(-1, POSITIVES)
        self.vec = np.frombuffer(vec, np.int32).reshape(-1, dim)
        self.norm = np.linalg.norm(self.vec.astype(np.float64), axis=1)
        self.negatives = negatives
        n = len(self.rid)
        level = np.zeros(n, np.int64)
        for i in range(1, n):
            level[i] = level[self.parent[i]] + 1
        self.tiles = []
        for lv in range(level[-1] + 1):
            at = np.flatnonzero(level == lv)
            self.tiles += [at[i : i + TILE] for i in range(0, len(at), TILE)]
        if negatives:
            none = self.positive == NONE
            p = np.where(none, 0, self.positive)
            step = 100 // 5  # LOW and HIGH are whole multiples of 5 hundredths
            self.low, self.high = -((-p * (LOW // 5)) // step), (p * (HIGH // 5)) // step
            self.open = ~none & (self.low <= self.high)
            self.best = [Best(n, NEGATIVES) for _ in range(POSITIVES)]
        else:
            self.best = [Best(n, POSITIVES)]

    def wanted(self, lines: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a candidate with scores between the bounds can still be among the best, per line and candidate."""
        if not self.negatives:
            floor = np.maximum(self.best[0].score[lines, -1], sure(np.where(counts, low, -np.inf), POSITIVES))
            return counts & (high >= floor[:, None])
        out = np.zeros(low.shape, bool)
        for j, best in enumerate(self.best):
            on = self.open[lines, j]
            if on.any():
                least, most = self.low[lines, j][:, None], self.high[lines, j][:, None]
                inside = counts & (low >= least) & (high <= most)
                floor = np.maximum(least[:, 0], np.maximum(best.score[lines, -1], sure(np.where(inside, low, -np.inf), NEGATIVES)))
                out |= on[:, None] & (high >= floor[:, None]) & (low <= most)
        return out & counts

    def meet(self, rid: np.ndarray, ids: np.ndarray, known: np.ndarray, label: np.ndarray, vec: np.ndarray) -> None:
        """Take what counts from a block of candidates, which stand by vec_id."""
        if not self.negatives:  # rows of labels that no anchor here has can't be positives
            some = np.isin(label, self.label)
            rid, ids, known, label, vec = (x[some] for x in (rid, ids, known, label, vec))
        if not len(rid):
            return
        floats = vec.astype(np.float64)
        norm = np.linalg.norm(floats, axis=1)
        exact = self.norm.max(initial=0) * norm.max(initial=0) < 2.0**53
        mine = self.vec.astype(np.float64)
        low = np.empty((len(self.rid), len(rid)))
        high = np.empty_like(low)
        for lines in self.tiles:
            same = self.label[lines, None] == label[None, :]
            counts = ~same if self.negatives else same & (self.rid[lines, None] != rid[None, :])
            most = self.norm[lines, None] * norm[None, :] * (1 + 1e-12) + 1
            if self.parent[lines[0]] < 0:
                low[lines], high[lines] = -most, most
                cols = np.arange(len(rid))
            else:
                up = self.parent[lines]
                # a little more than the bound, for rounded lengths, norms and scores
                off = self.length[lines, None] * norm[None, :] * (1 + 1e-9) + 1 + 1e-12 * most
                low[lines] = np.maximum(low[up] - off, -most)
                high[lines] = np.minimum(high[up] + off, most)
                cols = np.flatnonzero(self.wanted(lines, counts, low[lines], high[lines]).any(axis=0))
                if not len(cols):
                    continue
            score = np.rint(mine[lines] @ floats[cols].T).astype(np.int64) if exact else self.vec[lines].astype(np.int64) @ vec[cols].astype(np.int64).T
            low[np.ix_(lines, cols)] = high[np.ix_(lines, cols)] = score
            self.found(lines, np.where(counts[:, cols], score, NONE), ids[cols], known[cols], rid[cols])

    def found(self, lines: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, rid: np.ndarray) -> None:
        if not self.negatives:
            self.best[0].take(lines, score, ids, known, rid)
            return
        for j, best in enumerate(self.best):
            inside = (score >= self.low[lines, j][:, None]) & (score <= self.high[lines, j][:, None]) & self.open[lines, j][:, None]
            some = inside.any(axis=1)
            if some.any():
                best.take(lines[some], np.where(inside[some], score[some], NONE), ids, known, rid)

    def rows(self) -> list[np.ndarray]:
        """Columns anchor, which, score, id, known, rid."""
        parts = []
        for j, b in enumerate(self.best):
            line, at = np.nonzero(b.score != NONE)
            parts.append((self.rid[line], np.full(len(line), j), b.score[line, at], b.id[line, at], b.known[line, at], b.rid[line, at]))
        return [np.concatenate(x) for x in zip(*parts)]


def searched(chunks: DataFrame, groups: DataFrame, negatives: bool) -> DataFrame | None:
    """Rows (anchor, which, score, id, rid): for each anchor the best of each task, by the tree's bounds; None without groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Group] = {}
        for b in batches:
            for row, grp in enumerate(b.column("grp").to_pylist()):
                if grp not in held:
                    held[grp] = Group(b.column("dim")[row].as_py(), *[b.column(c)[row].as_py() for c in GROUP_COLUMNS[2:]], negatives)
                held[grp].meet(*unpack(b, row))
        for g in held.values():
            anchor, which, score, ids, known, rid = g.rows()
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(which.astype(np.int32)), pa.array(score), pa.array(ids, mask=~known), pa.array(rid)], names=["anchor", "which", "score", "id", "rid"])

    last, dim = groups.agg(F.max("grp"), F.max("g_dim")).first()
    if last is None:
        return None
    out, batch = None, max(1, BATCH_BYTES // (4 * GROUP * dim))
    for first in range(0, last + 1, batch):
        some = F.broadcast(groups.where(F.col("grp").between(first, first + batch - 1)))
        met = chunks.join(some, F.col("dim") == F.col("g_dim")).mapInArrow(run, "anchor bigint, which int, score bigint, id bigint, rid bigint")
        met = settle(met, "negatives" if negatives else "positives")
        out = met if out is None else out.union(met)
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The tasks' finds merged: ``place`` from 1 to ``k`` per anchor and ``which``."""
    order = Window.partitionBy("anchor", "which").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """Per anchor and positive the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows (vec_id, embedding, label) take no part if the label or the vector is null or empty, if a component is null
    or not finite, or if the scaled norm reaches 2**29 (their scores would leave the range of a long).  Vectors of different
    lengths have no score with each other.  A null vec_id is no anchor and comes last among equal scores.
    Each row is a row of its own: with repeated vec_ids, an anchor's copy may be its positive, and each copy of an anchor
    gives rows.  Windows of negative scores are empty; a score of 0 opens the window [0, 0].
    An empty table, or one without anchors, gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    chunks = settle(chunked(vectors, chunk), "vector_blocks")
    anchors = settle(grouped(settle(anchors_of(chunks), "anchors"), group), "anchor_groups")
    groups = settle(packed_groups(anchors.withColumn("scores", F.expr("CAST(array() AS ARRAY<BIGINT>)"))), "trees")
    found = searched(chunks, groups, False)
    if found is None:
        return empty
    positives = settle(best_of(found, POSITIVES).select("anchor", "place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "anchor_positives")
    scores = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    scores = scores.select("anchor", F.col("s.positive_score").alias("scores"))
    groups = settle(packed_groups(anchors.join(scores, F.col("rid") == F.col("anchor"))), "trees")
    found = searched(chunks, groups, True)
    if found is None:
        return empty
    negatives = best_of(found, NEGATIVES).select(F.col("anchor").alias("_a"), F.col("which").alias("_w"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("rid").alias("_r"), F.col("vec_id").alias("anchor_id"))
    j = negatives.join(positives, (F.col("_a") == F.col("anchor")) & (F.col("_w") + 1 == F.col("place"))).join(named, F.col("anchor") == F.col("_r"))
    return j.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
p AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS positive_id, list_dot_product(a.e, b.e)::BIGINT AS positive_score, a.label, a.e, b.rid AS pid
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY positive_score DESC, b.vec_id, b.rid) <= {POSITIVES}),
n AS (SELECT p.rid, p.pid, anchor_id, positive_id, positive_score, b.vec_id AS negative_id, list_dot_product(p.e, b.e)::BIGINT AS negative_score, b.rid AS nid
  FROM p JOIN v b ON b.label <> p.label AND len(b.e) = len(p.e))
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY rid, pid ORDER BY negative_score DESC, negative_id, nid))::INT AS rank, negative_id, positive_score, negative_score
FROM n WHERE {LOW} * positive_score <= 100 * negative_score AND 100 * negative_score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY rid, pid ORDER BY negative_score DESC, negative_id, nid) <= {NEGATIVES}"""
