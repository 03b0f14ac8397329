"""Packing documents into windows by non-negative least squares.

A document of n ids is cut into full windows and a remainder.  Remainders are classed by length; every
combination of up to DEPTH classes that fills a window is a pattern.  The repeat counts of the patterns are
the non-negative least-squares solution against the histogram of classes, rounded down.  Documents take
the places of the patterns in order of their rank in the class; remainders beyond the patterns are packed
greedily one after the other and cut at window borders.

The driver sees the histogram only (at most one row per class).  Ranks and running lengths are totals over
ranges, see common.running.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm import tokens
from wayframe.llm.common import running, settle

TOKENIZER, END, WINDOW, STEP, DEPTH = "byte_bpe_50k.json", 1, 2048, 8, 3


def patterns(classes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending class combinations of at most ``depth`` members that sum to ``classes``."""

    def grow(left: int, least: int, room: int) -> Iterator[tuple[int, ...]]:
        if room == 1:
            if left >= least:
                yield (left,)
            return
        for c in range(least, left // room + 1):
            for rest in grow(left - c, c, room - 1):
                yield (c, *rest)

    return [p for k in range(1, depth + 1) for p in grow(classes, 1, k)]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set (Lawson and Hanson, 1974)."""
    x = np.zeros(a.shape[1])
    inside: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a[:, inside] @ x[inside])
        slope[inside] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        inside.append(j)
        while inside:
            m = a[:, inside]
            g = m.T @ m
            g[np.diag_indices_from(g)] += 1e-9  # columns may depend on each other
            s = np.linalg.solve(g, m.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[inside] = s
                break
            now = x[inside]
            low = s <= 0
            now = now + (now[low] / np.maximum(now[low] - s[low], 1e-300)).min() * (s - now)
            x[:] = 0
            x[inside] = now
            inside = [k for k, v in zip(inside, now) if v > 1e-9 * tolerance]
    return x


def solve(histogram: dict[int, int], window: int = WINDOW, step: int = STEP) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) with repeats > 0 such that no class is used more often than it occurs."""
    classes = window // step
    combos = patterns(classes)
    combos = [p for p in combos if all(histogram.get(c) for c in p)]
    if not combos:
        return []
    a = np.zeros((classes + 1, len(combos)))
    for j, p in enumerate(combos):
        for c in p:
            a[c, j] += 1
    b = np.zeros(classes + 1)
    for c, n in histogram.items():
        b[c] = n
    left = dict(histogram)
    out = []
    for p, x in zip(combos, nnls(a, b)):
        n = min([int(x + 1e-6), *(left[c] // p.count(c) for c in p)])
        if n:
            out.append((p, n))
            for c in p:
                left[c] -= n
    return out


def placed(sizes: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Where each row (rid, n) goes: (rid, full0, seq1, off1, len1, seq2, len2).

    Full windows get the sequences full0, full0 + 1, ...; the remainder goes to seq1 at off1 and, where a
    window border cuts it, to the start of seq2.
    """
    d = sizes.select("rid", F.expr(f"n div {window}").alias("full"), F.expr(f"n % {window}").alias("rem"))
    d = d.withColumn("cls", F.expr(f"(rem + {step - 1}) div {step}")).withColumn("one", F.lit(1).cast("bigint"))
    d = settle(running(d, ["cls", "rid"], ["one", "full"]), "ranks")
    hist = {r["cls"]: (r["n"], r["full"]) for r in d.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()}
    full_total = sum(x[1] for x in hist.values())
    start, at = {}, 0
    for c in sorted(hist):
        start[c], at = at, at + hist[c][0]
    # Intervals of global ranks, each with the first of its sequences and the place in them; -1 is left over, -2 has no remainder.
    used = dict.fromkeys(hist, 0)
    spans: list[tuple[int, int, int]] = []
    seq = full_total
    for p, n in solve({c: x[0] for c, x in hist.items() if c}, window, step):
        for slot, c in enumerate(p):
            spans.append((start[c] + used[c], seq, slot))
            used[c] += n
        seq += n
    spans += [(start[c] + used[c], -1, -1 if c else -2) for c in hist if used[c] < hist[c][0]]
    spans.sort()
    begins, seqs, slots = (np.array(x, dtype=np.int64) for x in (zip(*spans) if spans else ([], [], [])))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column("before_one").to_numpy()
            i = np.searchsorted(begins, g, side="right") - 1
            s = np.where(seqs[i] >= 0, seqs[i] + g - begins[i], -1)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("before_full"), b.column("rem"), pa.array(s), pa.array(slots[i])], names=["rid", "full0", "rem", "seq", "slot"])

    d = d.withColumn("before_one", F.col("before_one").cast("bigint")).withColumn("before_full", F.col("before_full").cast("bigint"))
    d = settle(d.select("rid", "before_one", "before_full", "rem").mapInArrow(assign, "rid bigint, full0 bigint, rem bigint, seq bigint, slot bigint"), "places")
    none = F.lit(None).cast("bigint")
    whole = d.where("slot = -2").select("rid", "full0", none.alias("seq1"), none.alias("off1"), F.lit(0).cast("bigint").alias("len1"), none.alias("seq2"), F.lit(0).cast("bigint").alias("len2"))
    before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = d.where("seq >= 0").select("rid", "full0", F.col("seq").alias("seq1"), F.coalesce(F.sum("rem").over(before), F.lit(0)).alias("off1"), F.col("rem").alias("len1"), none.alias("seq2"), F.lit(0).cast("bigint").alias("len2"))
    rest = running(d.where("slot = -1"), ["rem", "rid"], ["rem"]).withColumn("at", F.col("before_rem").cast("bigint"))
    rest = rest.select(
        "rid", "full0", (F.lit(seq) + F.expr(f"at div {window}")).alias("seq1"), F.expr(f"at % {window}").alias("off1"), F.expr(f"least(rem, {window} - at % {window})").alias("len1"), "rem", "at"
    ).withColumn("len2", F.col("rem") - F.col("len1"))
    rest = rest.withColumn("seq2", F.when(F.col("len2") > 0, F.col("seq1") + 1)).select("rid", "full0", "seq1", "off1", "len1", "seq2", "len2")
    return whole.unionByName(fitted).unionByName(rest)


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty document, which is its end id.  Null and repeated doc_ids are kept as they are;
    each row is a document of its own.  A text of any length is cut into windows.  An empty table gives no piece.  Other columns are ignored.
    """
    file = tokenizer or tokens.path_of(TOKENIZER)
    staged = settle(tokens.encoded(docs, file, end), "tokens")
    plan = placed(staged.select("rid", "n"), window, step)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "full0", "seq1", "off1", "len1", "seq2", "len2")]
            out: list[tuple] = []
            for doc, raw, n, full0, seq1, off1, len1, seq2, len2 in zip(*cols):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")  # the driver loads no tokenizer
                pieces = [(k * window, window, full0 + k, 0) for k in range(n // window)]
                at = n - len1 - len2
                if len1:
                    pieces.append((at, len1, seq1, off1))
                if len2:
                    pieces.append((at + len1, len2, seq2, 0))
                out += [(doc, s, m, zlib.crc32(ids[s : s + m].tobytes()), n, q, o) for s, m, q, o in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=NAMES)

    return staged.join(plan.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid")).drop("_rid", "rid").mapInArrow(cut, ", ".join(f"{c} bigint" for c in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
