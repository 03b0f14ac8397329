"""Hard negatives, the prefix trie and the byte network: against brute force, on odd rows, and by held-out accuracy."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wayframe.llm import byte_network, hard_negatives, prefix_trie

LARGER = "/root/testdata/sf0.1"


def plain_negatives(rows):
    """By the rule, over whole Python integers."""
    v = []
    for i, (vec_id, x, label) in enumerate(rows):
        if label is None or not x or None in x or not np.isfinite(x).all():
            continue
        label = label if vec_id is None or vec_id % 7 else (label + 1) % 10
        v.append((i, vec_id, label, [int(np.floor(256 * c)) for c in x]))
    out = []
    for a in v:
        if a[1] is None or a[1] % 50:
            continue
        found = [(sum(p * q for p, q in zip(a[3], b[3])), b) for b in v if len(b[3]) == len(a[3])]
        found.sort(key=lambda f: (-f[0], f[1][1] is None, f[1][1] or 0, f[1][0]))
        for p, b in [f for f in found if f[1][2] == a[2] and f[1][0] != a[0]][:5]:
            fit = [f for f in found if f[1][2] != a[2] and 50 * p <= 100 * f[0] <= 95 * p][:3]
            out += [(a[1], b[1], k, n[1], p, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out, key=str)


def negatives(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    return sorted([tuple(r) for r in hard_negatives.hard_negatives(df, **sizes).collect()], key=str)


def clustered(n=900, dim=16, spread=0.15, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(i, (centres[r.integers(12)] + spread * r.normal(size=dim)).tolist(), int(r.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.15, 1.5])
def test_negatives_equal_brute_force(spark, spread):
    rows = clustered(spread=spread)
    assert negatives(spark, rows, group=5, chunk=64) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = clustered(300, 6)
    rows += [(0, rows[0][1], rows[0][2]), (50, rows[50][1], None), (None, rows[0][1], 1), (None, rows[1][1], 3), (900, None, 1), (950, [], 1), (1000, [1.0] * 5 + [float("nan")], 2), (1050, [0.0] * 6, 2)]
    rows += [(i, [None] + [1.0] * 5, 0) for i in (1100, 1101)] + [(i, r.normal(size=3).tolist(), i % 3) for i in range(1150, 1250, 5)]
    rows += [(i, rows[10][1], i % 4) for i in range(2000, 2040)]  # ties
    assert negatives(spark, rows, group=4, chunk=32) == plain_negatives(rows)


def test_negatives_with_scores_beyond_doubles(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-(2**18), 2**18, 8)], i % 3) for i in range(150)]
    big = max(abs(r[4]) for r in plain_negatives(rows))
    assert big > 2**53 and negatives(spark, rows) == plain_negatives(rows)


def test_bounds_leave_most_scores_out():
    """On dense groups of anchors, few candidates are scored again."""
    rows = clustered(4000, 32, 0.02)
    vec = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int32)
    label = np.array([r[2] for r in rows])
    at = np.arange(0, 4000, 50)
    order, parent, length = hard_negatives.spanning_tree(vec[at])
    at = at[order]
    g = hard_negatives.Group(32, at.astype(np.int64).tobytes(), label[at].tobytes(), parent.tobytes(), length.tobytes(), np.full((len(at), 5), hard_negatives.NONE).tobytes(), vec[at].tobytes(), False)
    seen = []
    found = g.found
    g.found = lambda lines, score, *rest: (seen.append(score.size), found(lines, score, *rest))
    g.meet(np.arange(4000), np.arange(4000), np.ones(4000, bool), label, vec)
    assert sum(seen) < 0.5 * len(at) * 4000
    dense = (vec[at].astype(np.int64) @ vec.astype(np.int64).T).astype(float)
    dense[(label[at][:, None] != label[None, :]) | (at[:, None] == np.arange(4000))] = -np.inf
    assert (g.best[0].score == -np.sort(-dense, axis=1)[:, :5]).all()


def test_no_anchors_no_rows(spark):
    assert negatives(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.5], 0)]) == []
    clash = spark.createDataFrame([(50, [1.0], 1, 5, "x", 2.0), (3, [1.0], 1, 5, "x", 2.0), (4, [0.8], 2, 5, "x", 2.0)], "vec_id bigint, embedding array<float>, label int, rid int, grp string, score double")
    assert [tuple(r) for r in hard_negatives.hard_negatives(clash).collect()] == [(50, 3, 1, 4, 65536, 52224)]
    assert hard_negatives.hard_negatives(clash.where("false")).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    said = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(said):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(said.get(base, [])[:h] + said[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest() if p in ends else hashlib.sha256(b"").hexdigest()
    return sorted([(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items()], key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv int, name string, a int").repartition(4)
    return sorted([tuple(r) for r in prefix_trie.prefix_trie(df).collect()], key=str)


def test_trie_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for c in range(-12, 70):
        for t in range(int(r.integers(1, 14))):
            rows.append((c, t, "user" if t % 2 else None, f"t{r.integers(2)}é" if t < 10 else None))
    # whole copies, repeated rows, ties, null turns and ids, and a lone turn that the head takes away
    rows += [(100 + 5 * k, t, "user", "same") for k in range(40) for t in range(6)] + [(7, 0, "user", "t0é")] * 3
    rows += [(301, None, "u", "n"), (301, None, "v", "n"), (301, 1, None, ""), (None, 0, "user", "x"), (None, None, None, None)] + [(c, 0, "user", "lone") for c in range(401, 420, 5)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_conversation_of_many_chunks(spark):
    assert prefix_trie.CHUNK == 256
    rows = [(c, t, "user", f"w{t % 3}" if t < cut else f"own {c}") for c, cut in ((5, 1300), (6, 900), (8, 513), (9, 256), (11, 255), (12, 1024)) for t in range(cut + c)]
    # equal digests of turns make equal blocks in different places
    assert trie(spark, rows) == plain_trie(rows)


def test_empty_trie(spark):
    assert trie(spark, [(1, 0, "user", "x")]) == plain_trie([(1, 0, "user", "x")])
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0 and "ends_sha256" in prefix_trie.prefix_trie(none).columns


def test_chunks_cover_every_window_once():
    for n in (0, 1, 7, 8, 255, 256, 257, 505, 506, 5000):
        raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        c = byte_network.chunks_of(raw)
        got = [bytes(row[i : i + byte_network.WIDTH].astype(np.uint8)) for row in c for i in range(byte_network.WINDOWS) if (row[i : i + byte_network.WIDTH] < 256).all()]
        assert got == [raw[i : i + byte_network.WIDTH] for i in range(max(0, n - byte_network.WIDTH + 1))]
        assert sorted(b for b in set(raw)) == sorted({int(x) for x in c.ravel()} - {byte_network.PAD})


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in byte_network.fresh().items()}
    texts = [byte_network.chunks_of(r.integers(0, 256, n).astype(np.uint8).tobytes()) for n in (3, 100, 700)]
    label = np.array([0, 1, 0])

    def loss():
        total = 0
        for t, y in zip(texts, label):
            p = byte_network.pooled(t, w)
            z = np.concatenate([p.max(axis=0), p.mean(axis=0)]) @ w["out"] + w["bias"][0]
            total -= np.log(byte_network.sigmoid(z if y else -z))
        return total / len(texts)

    g = byte_network.gradients(texts, label, w)
    for k, x in w.items():
        flat = x.reshape(-1)
        for i in r.choice(len(flat), min(12, len(flat)), replace=False):
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[k].reshape(-1)[i]) < 1e-4, k


def test_score_does_not_depend_on_batches():
    w = byte_network.fresh(3)
    texts = [b"", b"a", b"some text " * 5000, b"\xff" * 256, b"b" * 1000]
    together = byte_network.score_all(texts, w)
    assert np.allclose(together, [byte_network.score_all([t], w)[0] for t in texts], atol=1e-6)
    p = byte_network.pooled(byte_network.chunks_of(texts[2]), w)
    z = np.concatenate([p.max(axis=0), p.mean(axis=0)]) @ w["out"] + w["bias"][0]
    assert abs(together[2] - byte_network.sigmoid(z)) < 1e-5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = byte_network.scored(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r for r in held if r["quality"] == k] for k in (1, 0))
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert sum(r["predicted"] for r in good) / len(good) > 0.99
    wins = sum((g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad)
    assert wins / len(good) / len(bad) > 0.98


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(60)], "doc_id bigint, text string")
    labels = [(i, i % 2) for i in range(60)]
    turned = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels]
    a, b = (byte_network.train(docs, spark.createDataFrame(x, "doc_id bigint, quality int"), steps=5) for x in (labels, turned))
    assert all((a[k] == b[k]).all() for k in a)


def test_odd_rows_are_scored(spark):
    docs = spark.createDataFrame([(1, None, "c", 1.0), (2, "", "c", 1.0), (None, "x", "c", 1.0), (3, "y" * 300_000, "c", 1.0), (3, "y" * 300_000, "c", 1.0)], "doc_id bigint, text string, raw string, quality double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    for labels, want in ((none, 0.5), (spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 7)], none.schema), 0.99)):
        assert [round(r["score"], 6) for r in byte_network.scored(docs, labels).collect()] == [want] * 5
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1)], none.schema)
    rows = byte_network.scored(docs, labels).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] and len(rows) == 5 and all(0 <= s <= 1 for s in by.values())
    assert byte_network.scored(docs.where("false"), labels).count() == 0
