"""A byte-level convolutional network that scores the quality of whole texts.

A text's bytes are cut into chunks of CHUNK that overlap by WIDTH - 1, so that every window of WIDTH bytes lies in exactly one
chunk, from the first byte to the last.  Bytes become learned vectors of DEPTH numbers; FILTERS learned filters run over each
chunk, and each keeps its largest value there.  The largest and the mean of these over all chunks are combined into one
probability.  A text is taken a few chunks at a time, so memory does not depend on its length.

The weights are learned by Adam in one task from a bounded sample: at most SAMPLE labelled documents of at most SAMPLE_BYTES
each, half of either label if there are enough, and STEPS batches.  The share of labels in all training rows goes
into the bias, so the score is the probability under the table's own share.  Rows with crc32(doc_id) % FOLDS = 0 are
held out: their labels are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe.llm.common import settle

FOLDS, THRESHOLD = 5, 0.3
CHUNK, WIDTH, DEPTH, FILTERS = 256, 8, 8, 32
WINDOWS = CHUNK - WIDTH + 1
PAD = 256  # the byte beyond a text's end
SAMPLE, SAMPLE_BYTES = 4096, 32768
STEPS, BATCH, RATE, DECAY = 400, 48, 4e-3, 1e-4
#: Chunks that are worked on at once.
AT_ONCE = 128

Weights = dict[str, np.ndarray]


def chunks_of(raw: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that start every WINDOWS bytes; the last is padded.  An empty text has one row."""
    n = max(1, -(-(len(raw) - WIDTH + 1) // WINDOWS))
    flat = np.full((n - 1) * WINDOWS + CHUNK, PAD, np.uint16)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (WINDOWS * 2, 2))


def fresh(seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    w = {
        "embed": r.normal(0, 0.5, (257, DEPTH)),
        "filter": r.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)),
        "shift": np.zeros(FILTERS),
        "out": r.normal(0, 0.1, 2 * FILTERS),
        "bias": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def windows(chunks: np.ndarray, w: Weights) -> np.ndarray:
    """(chunks, WINDOWS, WIDTH * DEPTH): each window's bytes as learned vectors, one after the other."""
    e = w["embed"][chunks].reshape(len(chunks), CHUNK * DEPTH)
    step = e.strides[1]
    return np.lib.stride_tricks.as_strided(e, (len(chunks), WINDOWS, WIDTH * DEPTH), (e.strides[0], DEPTH * step, step))


def filtered(chunks: np.ndarray, w: Weights) -> np.ndarray:
    """(chunks, WINDOWS, FILTERS) before the shift."""
    x = windows(chunks, w).reshape(-1, WIDTH * DEPTH)
    return (x @ w["filter"]).reshape(len(chunks), WINDOWS, FILTERS)


def pooled(chunks: np.ndarray, w: Weights) -> np.ndarray:
    return np.maximum(filtered(chunks, w).max(axis=1) + w["shift"], 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def score_all(texts: list[bytes], w: Weights) -> np.ndarray:
    """One probability per text; chunks of neighbouring texts are worked on together."""
    if not texts:
        return np.zeros(0)
    top = np.zeros((len(texts), FILTERS), np.float32)
    total = np.zeros((len(texts), FILTERS))
    count = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    n = 0

    def flush() -> None:
        nonlocal held, owner, n
        if not n:
            return
        p, who = pooled(np.concatenate(held), w), np.concatenate(owner)
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        at = who[first]
        top[at] = np.maximum(top[at], np.maximum.reduceat(p, first, axis=0))
        total[at] += np.add.reduceat(p.astype(np.float64), first, axis=0)
        count[at] += np.diff(np.r_[first, len(who)])
        held, owner, n = [], [], 0

    for i, raw in enumerate(texts):
        c = chunks_of(raw)
        for lo in range(0, len(c), AT_ONCE):
            part = c[lo : lo + AT_ONCE]
            if n + len(part) > AT_ONCE:
                flush()
            held.append(part)
            owner.append(np.full(len(part), i))
            n += len(part)
    flush()
    both = np.concatenate([top, total / count[:, None]], axis=1)
    return sigmoid(both @ w["out"].astype(np.float64) + float(w["bias"][0]))


def gradients(texts: list[np.ndarray], label: np.ndarray, w: Weights) -> Weights:
    """Of the mean log loss over the texts, given as their chunks."""
    chunks = np.concatenate(texts)
    n = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(n)[:-1]]
    raw = filtered(chunks, w)
    at = raw.argmax(axis=1)
    p = np.maximum(np.take_along_axis(raw, at[:, None], axis=1)[:, 0] + w["shift"], 0)
    top, mean = np.maximum.reduceat(p, first, axis=0), np.add.reduceat(p, first, axis=0) / n[:, None]
    d = ((sigmoid(np.concatenate([top, mean], axis=1) @ w["out"] + w["bias"]) - label) / len(texts)).astype(np.float32)
    g = {"out": d @ np.concatenate([top, mean], axis=1), "bias": d.sum(keepdims=True)}
    who = np.repeat(np.arange(len(texts)), n)
    # the largest chunk of each text and filter, the first of equals
    is_top = p == top[who]
    order = np.cumsum(is_top, axis=0)
    before = (order[first] - is_top[first])[who]
    is_top &= order - before == 1
    dp = d[who, None] * (w["out"][None, FILTERS:] / n[who, None] + is_top * w["out"][None, :FILTERS])
    dp = np.where(p > 0, dp, 0).astype(np.float32)
    g["shift"] = dp.sum(axis=0)
    best = windows(chunks, w)[np.arange(len(chunks))[:, None], at]  # chunk, filter, window
    g["filter"] = np.einsum("cf,cfw->wf", dp, best, optimize=True)
    dwin = (dp[:, :, None] * w["filter"].T[None]).reshape(-1, WIDTH, DEPTH)
    seen = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)].reshape(-1)
    flat = dwin.reshape(-1, DEPTH)
    g["embed"] = np.stack([np.bincount(seen, flat[:, k], 257) for k in range(DEPTH)], axis=1).astype(np.float32)
    return g


def learned(texts: list[bytes], label: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> Weights:
    """Weights from the sample; ``share`` is the share of label 1 among all rows.  With one label only, or none, the score is constant."""
    w = fresh(seed)
    share = min(max(share, 0.01), 0.99)
    if len(texts) == 0 or label.min() == label.max():
        w["out"][:] = 0
        w["bias"][:] = np.log(share / (1 - share))
        return w
    chunks = [chunks_of(t) for t in texts]
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    groups = [np.flatnonzero(label == k) for k in (0, 1)]
    for step in range(1, steps + 1):
        # both labels alike in every batch
        pick = np.concatenate([r.choice(x, BATCH // 2) for x in groups])
        g = gradients([chunks[i] for i in pick], label[pick].astype(np.float32), w)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in w.items():
            d = g[k] + DECAY * x if k != "bias" else g[k]
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    w["bias"] += np.float32(np.log(share / (1 - share)))
    return w


def packed_weights(w: Weights) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def unpacked_weights(raw: bytes) -> Weights:
    out, at = {}, 0
    for k, x in sorted(fresh().items()):
        out[k] = np.frombuffer(raw, "<f4", x.size, at).reshape(x.shape)
        at += 4 * x.size
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Weights:
    """Learn from the labelled documents that aren't held out.

    Rows of ``labels`` with a null doc_id or a quality other than 0 and 1 are skipped; of a doc_id labelled several times the smaller label counts.
    Which documents are sampled depends on their ids' hashes only.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    known = settle(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "training_labels")
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    parts = []
    for k, rows in sorted(n.items()):
        # about twice as many as are wanted, so that long ones can go, then a bounded sort
        some = known.where(F.col("quality") == k).withColumn("draw", draw).where(F.col("draw") < min(1.0, 2 * (sample // 2) / rows))
        parts.append(some.orderBy("draw", "doc_id").limit(sample))
    if not parts:
        return learned([], np.zeros(0), 0.5)
    picked = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    picked = picked.select(F.col("doc_id").alias("_id"), "quality", "draw")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw")).where(F.octet_length("raw") <= SAMPLE_BYTES)
    rows = settle(texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "raw", "quality", "draw"), "training_sample")
    share = n.get(1, 0) / sum(n.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {0: [], 1: []}
        seen = set()
        for b in batches:
            for doc_id, raw, quality, at in zip(*(c.to_pylist() for c in b.columns)):
                if doc_id not in seen and len(kept[quality]) < sample // 2:
                    seen.add(doc_id)
                    kept[quality].append((at, raw))
        both = [(raw, k) for k in (0, 1) for _, raw in kept[k]]
        w = learned([x for x, _ in both], np.array([k for _, k in both]), share, steps)
        yield pa.RecordBatch.from_arrays([pa.array([packed_weights(w)], pa.binary())], names=["weights"])

    # both labels by draw; copies of a doc_id by text
    one = rows.repartition(1).sortWithinPartitions("draw", "doc_id", "raw")
    got = one.mapInArrow(run, "weights binary").first()
    return unpacked_weights(bytes(got["weights"])) if got else learned([], np.zeros(0), share)


def score(docs: DataFrame, w: Weights) -> DataFrame:
    """Per row of documents: doc_id, held_out, score, predicted, from the whole text."""
    raw = packed_weights(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = unpacked_weights(raw)
        for b in batches:
            p = score_all([x or b"" for x in b.column(2).to_pylist()], weights)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` and score every row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored like others (all padding); texts of any length are scored as a whole.  Rows are scored one by
    one, so repeated rows and null doc_ids (never held out) give rows alike.  Without labels, or with one kind only, all
    scores are that share of labels, kept within 0.01 and 0.99 (0.5 without any).  An empty table gives an empty result;
    other columns are ignored.
    """
    return score(docs, train(docs, labels))
