"""Similarity self-join of documents on word shingles, by signature trees.

Documents become sets of shingle hashes; equal sets are joined once.  Two sets can only reach the threshold if
their prefixes (the first few hashes in one global order) share a hash, so prefixes deal the sets into
groups.  In a group, sets carry their size and a bitmap of parities: each hash flips a bit.  What two sets share
flips both alike, so the bits in which their bitmaps differ never outnumber the hashes that only one of them has, and
nearly equal them.  A tree over the group holds AND- and OR-combined bitmaps and size ranges; traversed against itself,
it drops node pairs that must differ in too many hashes.  Pairs of sets that are left are verified on the full sets.

Scale.  The global order puts hashes from crowded cells of a bounded count sketch last, so passages that very
many documents share stay out of prefixes.  Bitmaps that travel with a group have a bit or two per hash, enough to tell
unlike sets apart.  The first round splits groups into blocks, gives each block the rows of one of them, and offers
each set its nearest and its smallest likely partner only; once those links are known, groups within one component are
done, and a second round offers all likely pairs between different components in the others, in pairs of blocks.  So a
large group of near copies costs about its size and not its square, and no link between components is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe.llm.common import chunk_leaders, chunk_pairs, components, packed, runs, settle, unpacked

WORDS, PERCENT = 3, 90
#: Bits per hash and bounds of a bitmap's width; sets per block; children per tree node.
SPREAD, NARROWEST, WIDEST, BLOCK, FANOUT = 4, 256, 65536, 512, 8
#: Bits per hash and least width of the bitmaps that travel with the groups: a set's bitmap goes to all its prefix hashes.
CARRIED = (1, 64)
#: A group of up to this many rows is one node of a tree; such groups are gone through many at a time.
SMALL = 32
#: Rows that a Python worker handles at a time.
ROWS = 512
PLACES = 4096
#: The count sketch has about a cell per this many hashes, within bounds; a crowded cell is 8 deviations and 8 above the mean.
PER_CELL, CELL_BITS = 16, (12, 22)
#: Bits of the filter that keeps sets without a likely partner out of verification.
FILTER_BITS = 22

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= _WORDS_KEPT:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the shingles of a UTF-8 text with A-Z lowered; fewer words are one shingle."""
    w = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at U+0020 and U+0009 to U+000D only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + h[i : len(w) - k + 1 + i]
    return np.unique(_finish(out + np.uint64(k)) >> np.uint64(16))


def to_bytes(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def width_of(n: int, spread: int = SPREAD, least: int = NARROWEST) -> int:
    return min(WIDEST, max(least, 1 << (spread * n - 1).bit_length()))


def bitmap(h: np.ndarray, parity: bool = False, spread: int = SPREAD, least: int = NARROWEST) -> bytes:
    """Bit i: whether some of the hashes, with ``parity`` an odd number of them, end in i."""
    width = width_of(len(h), spread, least)
    times = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((times & 1 if parity else times > 0).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, width: int, parity: bool = False) -> np.ndarray:
    """The bitmap with ``width`` bits, as 64-bit words."""
    b = np.frombuffer(raw, "<u8")
    return (np.bitwise_xor if parity else np.bitwise_or).reduce(b.reshape(-1, width // 64), axis=0)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS rows: a worker's memory stays small whatever the batch size."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def sets_of(docs: DataFrame, words: int, keep: dict[str, Column]) -> DataFrame:
    """Rows (<keep>, n, sid, bits, hashes).  sid, 64 bits of the set's digest, names equal sets; null for an empty set."""
    names = list(keep)
    carried = docs.select(*[c.alias(k) for k, c in keep.items()], F.col("text").cast("binary").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in sliced(batches):
            n, sid, bits, raw = [], [], [], []
            for t in b.column(len(names)).to_pylist():
                h = shingles(t, words)
                n.append(len(h))
                raw.append(to_bytes(h))
                bits.append(bitmap(h, True, *CARRIED) if len(h) else b"")
                sid.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw[-1])))) if len(h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), pa.array(raw, pa.binary())], names=[*names, "n", "sid", "bits", "hashes"])

    return carried.mapInArrow(run, f"{schema}, n bigint, sid bigint, bits binary, hashes binary")


def crowded(sets: DataFrame) -> np.ndarray:
    """Which cells of the count sketch, of bounded size, are crowded: bool per cell, counted over all sets."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = min(max((total // PER_CELL).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    mean = total / (1 << bits)
    limit = mean + 8 * mean**0.5 + 8
    piece = 1 << CELL_BITS[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint32)
        for b in sliced(batches):
            h = from_bytes(b"".join(b.column(0).to_pylist())) >> np.uint64(48 - bits)
            np.add.at(n, h.astype(np.int64), np.uint32(1))
        parts = np.minimum(n, 255).astype(np.uint8).reshape(-1, piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in runs(batches, 1):
            raw = t.column("n").to_pylist()
            marks = [np.packbits(sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in raw[lo:hi]) > limit).tobytes() for lo, hi in itertools.pairwise(borders)]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("part").to_numpy()[borders[:-1]]), pa.array(marks, pa.binary())], names=["part", "marks"])

    parts = sets.select("hashes").mapInArrow(count, "part bigint, n binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part bigint, marks binary")
    got = sorted((r["part"], bytes(r["marks"])) for r in parts.collect())
    if not got:
        return np.zeros(1 << bits, bool)
    return np.unpackbits(np.frombuffer(b"".join(m for _, m in got), np.uint8)).astype(bool)


def prefixes(sets: DataFrame, heavy: np.ndarray, percent: int) -> DataFrame:
    """(h, sid, nr) for the prefix of every set; a set that a task has seen is not repeated by it.

    nr packs the set's size and the hash's place in the prefix: size * PLACES + place.
    """
    shift = np.uint64(48 - (len(heavy).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches):
            hs, sids, ns = [], [], []
            for sid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                h = from_bytes(raw)
                m = len(h) - -(-len(h) * percent // 100) + 1
                late = heavy[(h >> shift).astype(np.int64)]
                h = np.concatenate([h[~late], h[late]])[:m]
                hs.append(h.view(np.int64))
                sids.append(np.full(len(h), sid))
                ns.append(len(raw) // 6 * PLACES + np.minimum(np.arange(len(h)), PLACES - 1))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, sids, ns)], names=["h", "sid", "nr"])

    return sets.select("sid", "hashes").mapInArrow(run, "h bigint, sid bigint, nr bigint")


def shared_by_two(posted: DataFrame) -> DataFrame:
    """Of (h, sid, nr), the distinct rows whose h occurs with two sids or more.  A task streams its rows and holds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0 = sid0 = n0 = first = first_n = None
        seen = 0  # distinct sids of the run so far
        for b in batches:
            if not b.num_rows:
                continue
            h, sid, n = (b.column(i).to_numpy() for i in range(3))
            if h0 is None:
                hp, sp = np.concatenate([[h[0] ^ 1], h[:-1]]), np.concatenate([[sid[0]], sid[:-1]])
            else:
                hp, sp = np.concatenate([[h0], h[:-1]]), np.concatenate([[sid0], sid[:-1]])
            start = h != hp
            new = start | (sid != sp)
            count = np.cumsum(new)
            run_no = np.cumsum(start)  # 0: the run carried over
            at = np.flatnonzero(start)
            base = np.concatenate([[-seen], count[at] - 1])[run_no]
            order = count - base  # 1 for the first distinct sid of a run
            heads = np.concatenate([[0 if first is None else first], sid[at]])[run_no]
            heads_n = np.concatenate([[0 if first_n is None else first_n], n[at]])[run_no]
            later = np.flatnonzero(new & (order >= 2))
            second = np.flatnonzero(new & (order == 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[second], h[later]])), pa.array(np.concatenate([heads[second], sid[later]])), pa.array(np.concatenate([heads_n[second], n[later]]))], names=["h", "sid", "nr"])
            h0, sid0, n0, seen, first, first_n = h[-1], sid[-1], n[-1], int(order[-1]), heads[-1], heads_n[-1]

    return posted.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(run, "h bigint, sid bigint, nr bigint")


def likely(bits: np.ndarray, n: np.ndarray, percent: int, differ: np.ndarray | None = None) -> np.ndarray:
    """Row pairs (2, k) of a group that may reach the threshold, by dual traversal of a signature tree.

    bits: 64-bit words per row, bitmaps of all rows with parity or of all without; differ: rows with equal numbers are not paired.
    """
    order = np.argsort(n, kind="stable")
    bits, n = bits[order], n[order]
    tag = np.arange(len(n)) if differ is None else differ[order]
    # Levels from rows up: bits that all and that any rows have, size range, and the tag if there is but one.
    levels = [(bits, bits, n, n, tag, tag)]
    while len(levels[-1][2]) > FANOUT:
        every, some, lo, hi, t0, t1 = levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        levels.append((np.bitwise_and.reduceat(every, at, axis=0), np.bitwise_or.reduceat(some, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(t0, at), np.maximum.reduceat(t1, at)))

    def possible(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some rows below the nodes a and b may reach the threshold and are not all of one tag."""
        every, any_, lo, hi, t0, t1 = levels[depth]
        keep = 100 * np.minimum(hi[a], hi[b]) >= percent * np.maximum(lo[a], lo[b])
        if differ is not None:
            keep &= ~((t0[a] == t1[a]) & (t0[b] == t1[b]) & (t0[a] == t0[b]))
        some = np.flatnonzero(keep)
        step = max(1, 500_000 // bits.shape[1])
        for s in range(0, len(some), step):
            at = some[s : s + step]
            x, y = a[at], b[at]
            apart = every[x] ^ every[y] if not depth else (every[x] & ~any_[y]) | (every[y] & ~any_[x])
            least = np.bitwise_count(apart).sum(axis=1).astype(np.int64)  # hashes that only one of two sets has
            keep[at] = (100 + percent) * least <= (100 - percent) * (hi[x] + hi[y])
        return keep

    a, b = np.triu_indices(len(levels[-1][2]))
    if len(levels) == 1:
        a, b = a[a != b], b[a != b]
    keep = possible(len(levels) - 1, a, b)
    a, b = a[keep], b[keep]
    first, second = np.repeat(np.arange(FANOUT), FANOUT), np.tile(np.arange(FANOUT), FANOUT)
    for depth in range(len(levels) - 2, -1, -1):
        below = len(levels[depth][2])
        found = [(a[:0], b[:0])]
        for s in range(0, len(a), 1024):  # children of some node pairs at a time
            ca = (a[s : s + 1024, None] * FANOUT + first).ravel()
            cb = (b[s : s + 1024, None] * FANOUT + second).ravel()
            ok = (ca < below) & (cb < below) & ((ca < cb) if not depth else (ca <= cb))
            ca, cb = ca[ok], cb[ok]
            keep = possible(depth, ca, cb)
            found.append((ca[keep], cb[keep]))
        a, b = (np.concatenate(x) for x in zip(*found))
    return np.stack([order[a], order[b]])


def differing(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows a and b differ, some pairs at a time."""
    out = np.empty(len(a), np.int64)
    step = max(1, 500_000 // bits.shape[1])
    for s in range(0, len(a), step):
        out[s : s + step] = np.bitwise_count(bits[a[s : s + step]] ^ bits[b[s : s + step]]).sum(axis=1)
    return out


def likely_in_small(raw: list[bytes], n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (2, k) of many groups, each so small that its tree is one node, that may reach the threshold, and the bits in which they differ.

    Group g is the rows starts[g] to starts[g] + sizes[g]; wanted(a, b) leaves pairs out by other columns.
    """
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    later = np.repeat(starts + sizes, sizes) - rows - 1
    a = np.repeat(rows, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    width = np.zeros(len(raw), np.int64)
    for size in np.unique(sizes):
        at = starts[sizes == size, None] + np.arange(size)
        width[at] = lengths[at].min(axis=1, keepdims=True)
    keep = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    keep[keep] = wanted(a[keep], b[keep])
    a, b = a[keep], b[keep]
    for w in np.unique(width[a]):
        x, y = a[width[a] == w], b[width[a] == w]
        used = np.unique(np.concatenate([x, y]))
        bits = np.empty((len(used), w // 8), np.uint64)
        for size in np.unique(lengths[used]):
            same = np.flatnonzero(lengths[used] == size)
            words = np.frombuffer(b"".join([raw[k] for k in used[same].tolist()]), "<u8")
            bits[same] = np.bitwise_xor.reduce(words.reshape(len(same), -1, w // 8), axis=1)
        apart = differing(bits, np.searchsorted(used, x), np.searchsorted(used, y))
        near = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
        yield np.stack([x[near], y[near]]), apart[near]


def partners(groups: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Likely pairs (a, b) of groups (h, cls, i, j, block, own, sid, n, bits, label), sorted by the first four.

    Without ``all_pairs`` each set is paired with two likely partners of a block only, the nearest by its bitmap and the
    smallest; with it, with every likely partner of another label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in runs(batches, 4):
            bi, bj, block, own, sid, n, label = (t.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "own", "sid", "n", "label"))
            raw = t.column("bits").to_pylist()
            starts, sizes = np.array(borders[:-1]), np.diff(borders)
            group = np.repeat(np.arange(len(sizes)), sizes)

            def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                keep = own[a] | own[b]
                return keep & (label[a] != label[b]) & ((bi[a] == bj[a]) | (block[a] != block[b])) if all_pairs else keep

            def chosen(pairs: np.ndarray, apart: np.ndarray) -> np.ndarray:
                x, y = sid[pairs[0]], sid[pairs[1]]
                a, b = np.maximum(x, y), np.minimum(x, y)
                if all_pairs:
                    return np.stack([a, b])
                g = group[pairs[0]]
                by = np.lexsort((b, a, g))
                by = by[np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (g[by][1:] != g[by][:-1])])]
                x, y, g, apart = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([g, g]), np.concatenate([apart, apart])
                near = np.lexsort((y, apart, x, g))
                near = near[np.concatenate([[True], (x[near][1:] != x[near][:-1]) | (g[near][1:] != g[near][:-1])])]
                found = np.stack([np.concatenate([a[by], np.maximum(x, y)[near]]), np.concatenate([b[by], np.minimum(x, y)[near]])])
                return np.unique(found, axis=1)

            out: list[np.ndarray] = []
            small = (sizes > 1) & (sizes <= SMALL)
            for pairs, apart in likely_in_small(raw, n, starts[small], sizes[small], percent, wanted) if small.any() else ():
                if pairs.size:
                    out.append(chosen(pairs, apart))
            for lo, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                hi = lo + size
                width = 8 * min(map(len, raw[lo:hi]))
                bits = np.stack([folded(x, width, parity=True) for x in raw[lo:hi]])
                pairs = likely(bits, n[lo:hi], percent, label[lo:hi] if all_pairs else None)
                pairs = pairs[:, wanted(pairs[0] + lo, pairs[1] + lo)]
                if pairs.size:
                    out.append(chosen(pairs + lo, differing(bits, *pairs)))
            if out:
                a, b = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.  Sets that surely occur in no pair are left out by a filter of bounded size."""
    word = F.expr(f"pmod(xxhash64(id), {1 << FILTER_BITS})")
    marks = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).withColumn("bit", word)
    for r in ids.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), CAST(bit % 64 AS INT)))").alias("m")).collect():
        marks[r["w"]] = r["m"]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches):
            bit = b.column(2).to_numpy()
            hit = (marks[bit // 64] >> (bit % 64)) & 1
            sid = b.column(0).to_pylist()
            keep = [i for i in np.flatnonzero(hit).tolist() if not (sid[i] in seen or seen.add(sid[i]))]
            yield b.take(pa.array(keep, pa.int64())).select(["sid", "hashes"])

    bits = sets.where("sid IS NOT NULL").select("sid", "hashes", F.expr(f"pmod(xxhash64(sid), {1 << FILTER_BITS}) AS bit"))
    some = bits.mapInArrow(known, "sid bigint, hashes binary").groupBy("sid").agg(F.first("hashes").alias("hashes"))
    some = settle(some, "verify_sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                both = len(np.intersect1d(from_bytes(x), from_bytes(y), assume_unique=True))
                ok.append(100 * both >= percent * (len(x) // 6 + len(y) // 6 - both))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    j = pairs.join(some.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(some.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def joined(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Components (node, component) over sids of written sets; sids without a link are not listed."""
    shared = shared_by_two(prefixes(sets, crowded(sets), percent))
    shared = settle(shared.select("h", "sid", F.expr(f"nr div {PLACES}").alias("n"), F.expr(f"nr % {PLACES}").alias("place")), "shared_prefixes")
    bits = sets.where("sid IS NOT NULL").select("sid", "bits").groupBy("sid").agg(F.first("bits").alias("bits"))
    bits = settle(bits.join(shared.select(F.col("sid").alias("_sid")).distinct(), F.col("sid") == F.col("_sid"), "left_semi"), "bitmaps")

    def grouped(rows: DataFrame, labelled: bool) -> DataFrame:
        """The rows of shared prefixes as groups by hash and size class, in block pairs.

        Sizes of a pair lie in one class or in neighbouring ones (a class is a little wider than the threshold's
        ratio), so a set is ``own`` in its class and a guest in the next; two guests are not compared.  A pair meets at
        its first shared hash at least, and with ``place`` hashes before it a set of n can reach the threshold only
        with partners of up to (n - place) * (1 + 1 / t) - n; if those are all below the next class, it is no guest there.
        """
        step = f"(1.001 * ln(100 / {percent}D))"
        s = F.expr(f"CAST(floor(ln(n) / {step}) AS BIGINT)")
        largest = F.expr(f"ln(greatest(1D, (n - place) * {100 + percent} / {percent}D - n + 1)) / {step}")
        guest = F.when(largest > s + 1 - 1e-9, F.struct((s + 1).alias("cls"), F.lit(False).alias("own")))
        places = F.array_compact(F.array(F.struct(s.alias("cls"), F.lit(True).alias("own")), guest))
        g = rows.select("*", F.explode(places).alias("p")).select("h", "p.cls", "p.own", "sid", "n", "label")
        size = [F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("owned"), F.min("label").alias("l0"), F.max("label").alias("l1")]
        count = g.groupBy("h", "cls").agg(*size).where("rows > 1 AND owned > 0" + (" AND l0 <> l1" if labelled else ""))
        count = count.select(F.col("h").alias("_h"), F.col("cls").alias("_c"), "rows")
        g = g.join(count, (F.col("h") == F.col("_h")) & (F.col("cls") == F.col("_c"))).drop("_h", "_c")
        g = chunk_pairs(g, ["h", "cls"], "rows", F.xxhash64("sid"), block) if labelled else chunk_leaders(g, "rows", F.xxhash64("sid"), block)
        b = bits.withColumnRenamed("sid", "_sid")
        g = g.join(b, F.col("sid") == F.col("_sid")).select("h", "cls", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "block", "own", "sid", "n", "bits", "label")
        return g.repartition("h", "cls", "i", "j").sortWithinPartitions("h", "cls", "i", "j")

    first = settle(partners(grouped(shared.withColumn("label", F.col("sid")), False), percent, False), "pairs")
    links = settle(verified(first, sets, percent), "links")
    labels = components(links).withColumnRenamed("node", "_node")
    known = shared.join(labels, F.col("sid") == F.col("_node"), "left").select("h", "sid", "n", "place", F.coalesce("component", "sid").alias("label"))
    # Written before the join: a pair is found at each hash it shares, and the optimiser would join each of these.
    rest = settle(partners(grouped(settle(known, "labelled"), True), percent, True), "pairs")
    rest = settle(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    more = settle(verified(rest, sets, percent), "links")
    return components(links.union(more))


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, and ``part``, the group's own number.

    Lower-cases A-Z; words as ``[^\\x20\\x09-\\x0D]+``.  Fewer words than a shingle: the whole text is one.  A
    null text or one without words has an empty set, links with nothing and has no part.  Equal texts
    link.  Shingles of a text are counted by 48 bits of their hashes: a text of ten million words may count a few less.  component_id is the smallest doc_id of the group, null if none has one; null and repeated doc_ids are rows like
    others.  An empty table gives an empty result; other columns are ignored.  Sets are named by 64
    bits of their digest: two different ones meet in one name with probability n * n / 2**65.
    """
    sets = settle(sets_of(docs, words, {"doc_id": F.col("doc_id").cast("bigint")}), "shingles")
    return grouped_rows(sets, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "part")


def grouped_rows(sets: DataFrame, percent: int) -> DataFrame:
    """The written rows of sets_of, without bitmaps and hashes, with part and component_id."""
    groups = joined(sets, percent).withColumnRenamed("node", "_node")
    rows = sets.drop("bits", "hashes")
    some = rows.where("sid IS NOT NULL").join(groups, F.col("sid") == F.col("_node"), "left").withColumn("part", F.coalesce("component", "sid")).drop("_node", "component")
    least = some.groupBy("part").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("part", "_part")
    some = some.join(least, F.col("part") == F.col("_part")).drop("_part")
    return some.unionByName(rows.where("sid IS NULL").withColumns({"part": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")}))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents with one of each group: the smallest doc_id, then the smallest text hash.  Rows without words stay.

    Null doc_ids come after others; of repeated rows one stays.  Texts may be of any length, columns of any name; an empty table gives none.
    """
    key = F.xxhash64("doc_id", "text")
    sets = settle(sets_of(docs, words, {"doc_id": F.col("doc_id").cast("bigint"), "k": key}), "shingles")
    rows = grouped_rows(sets, percent)
    some = rows.where("part IS NOT NULL")
    best = some.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k")).alias("b"))
    stay = best.select(F.col("b.doc_id").alias("_doc"), F.col("b.k").alias("_k"))
    times = some.groupBy(F.col("doc_id").alias("_doc2"), F.col("k").alias("_k2")).agg(F.count(F.lit(1)).alias("times"))
    stay = stay.join(times, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_k") == F.col("_k2"))).select("_doc", "_k", "times")
    empty = rows.where("part IS NULL").select(F.col("doc_id").alias("_doc"), F.col("k").alias("_k"), F.lit(1).cast("bigint").alias("times")).distinct()
    # Rows repeated in full have one key: only these pass a deduplication, all others stay where they are.
    d = packed(docs, doc_id=F.col("doc_id"), k=key)
    j = d.join(settle(stay.unionByName(empty), "kept"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("k") == F.col("_k")))
    return unpacked(j.where("times = 1").select("row").unionByName(j.where("times > 1").dropDuplicates(["_doc", "_k"]).select("row")), docs.columns)


def sql(words: int = WORDS, percent: int = PERCENT) -> str:
    """DuckDB SQL of similar_groups() where doc_ids are unique."""
    return rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN w ELSE w[i : i + {words} - 1] END AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {words} + 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * hits >= {percent} * (a.n + b.n - hits)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""
