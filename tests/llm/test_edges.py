"""Nulls, empty and long texts, ties, repeated rows, empty tables and odd extra columns, for every operator and stage."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from wayframe.llm import catalog, html_text, jaccard_join, line_dedup, mixing, packing, quality, secret_scan, sharding, token_files, vector_dedup
from wayframe.llm.common import components, running

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _text string, n bigint, size int, th string, _k int, copies int, `a.b` int"


def prose(seed, n, words=400):
    r = random.Random(seed)
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    return " ".join("w" + name(r.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = "\n".join(prose(i, 12) for i in range(9))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (None, base, None, None), (3, None, "en", None), (4, "", None, "b"),
        (5, " \n\t ", "en", "b"), (6, "two words", "en", "b"), (7, prose(7, 30_000, 9000), "de", "b"), (8, "x" * 200_000, "en", "c"), (None, None, None, None),
        (9, "ä 日本 \U0001f600\n\n" + prose(9, 60), "en", "a"), (10, base + "\nextra line here", "en", "c"), (1, "same id, other text " + prose(3, 80), "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", -1, -2, "clash", 7, 8, 9) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


OF_DOCUMENTS = {
    "mix": mixing.mix, "mixed": mixing.mixed, "scan": secret_scan.scan, "files": token_files.token_files, "lines": line_dedup.drop_lines,
    "groups": jaccard_join.similar_groups, "keep_one": jaccard_join.keep_one, "pack": packing.pack, "quality": quality.quality, "keep_good": quality.keep_good, "shard": sharding.shard,
}


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_empty_table(none, name):
    assert OF_DOCUMENTS[name](none).count() == 0


@pytest.mark.parametrize("name", ["mix", "scan", "files", "lines", "groups", "quality", "shard"])
def test_one_row_per_document(odd, name):
    got = collections.Counter(r["doc_id"] for r in OF_DOCUMENTS[name](odd).collect())
    assert got == collections.Counter(r["doc_id"] for r in odd.collect())


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, none):
        assert stage(spark, docs, "").columns == odd.columns
        assert stage(spark, docs, "").count() <= 2 * odd.count()


def test_mix_copies_match(odd):
    taken = sum(r["copies"] for r in mixing.mix(odd).collect())
    assert mixing.mixed(odd).count() == taken
    rows = mixing.mix(odd).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x) / 2 + 1e-6


def test_mix_prefers_by_length(spark):
    """Within a source, long documents are taken more often than short ones, in proportion to the root of their length."""
    r = random.Random(8)
    rows, n = [], 0
    for source, many in (("a", 4000), ("b", 4000), ("c", 4000)):
        for _ in range(many):
            n += 1
            rows.append((n, "w " * r.choice((4, 100)), source))
    got = [x for x in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect() if x["source"] == "c"]
    # weights 5, 2 and 1 of 150 %: c's target is below its size, so every document is taken once or not at all
    assert {x["copies"] for x in got} == {0, 1}
    rate = {k: sum(x["copies"] for x in got if x["size"] == k) / sum(x["size"] == k for x in got) for k in (4, 100)}
    words = sum(x["size"] for x in got)
    liked = sum(mixing_root(x["size"]) * x["size"] for x in got)
    for k in rate:
        assert abs(rate[k] - got[0]["target"] / liked * mixing_root(k)) < 0.03
    assert rate[100] > 3 * rate[4] and abs(sum(x["taken"] for x in got) - got[0]["target"]) <= 50 and words > 0


def mixing_root(size):
    return max(1, int(size**0.5))


def test_full_sources_are_not_sorted(spark):
    """A source that stops at twice its size takes whole copies; its rows meet no window."""
    rows = [(i, "two words", "a") for i in range(50)] + [(100 + i, "w " * 300, "c") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert {(x["source"], x["copies"]) for x in got.where("source = 'a'").collect()} == {("a", 2)}


def test_lines(spark):
    line = "please read the notice number {} before you leave the hall today"
    long = prose("long", 60)
    rows = [(i, f"own words {prose(i, 20)}\n{line.format(i)}\nbye\n{long}") for i in range(1, 7)] + [(7, None), (8, ""), (9, prose(9, 30))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_dropped"] == 0
    for i in range(2, 7):
        assert got[i]["text"].split("\n") == [rows[i - 1][1].split("\n")[0], "bye"] and got[i]["n_dropped"] == 2
    assert got[7]["text"] is None and got[8]["text"] == "" and got[9]["n_dropped"] == 0


def test_lines_of_numbers_are_no_template(spark):
    rows = [(i, " ".join(str(i * k) for k in range(3, 40))) for i in range(1, 30)]
    assert line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_dropped > 0").count() == 0


def test_lines_with_a_variable_word(spark):
    rows = [(i, f"{prose(i, 20)}\nthis page was last changed by user {name} who holds all of the rights to the text and the pictures on it") for i, name in enumerate(("ann", "bob", "cy", "dee"), 1)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("edits", [2, 3])
def test_long_lines_with_several_variable_words(spark, edits):
    base = prose("template", 64).split()
    rows = []
    for i in range(1, 6):
        w = list(base)
        for k in range(edits):
            w[5 + 20 * k] = prose(f"{i} {k}", 1, 9**5)
        rows.append((i, f"{prose(i, 20)}\n{' '.join(w)}"))
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1}


def plain_dropped(rows):
    """(n_dropped, text) by document, for distinct doc_ids: in a leaf, templates in order of documents join the first seed that they are like."""
    held, lines = collections.defaultdict(set), []
    for doc, text in rows:
        for line in (text or "").split("\n"):
            t = tuple(re.sub("[0-9]+", "<*>", line).split())
            if sum("<*>" not in w for w in t) >= line_dedup.SHORT:
                held[t].add(doc)
                lines.append((doc, t))
    leaves = collections.defaultdict(list)
    for t in held:
        leaves[len(t), t[: line_dedup.DEPTH]].append(t)
    first = {}
    for leaf in leaves.values():
        groups = {}
        for t in sorted(leaf, key=lambda t: (-len(held[t]), int(hashlib.md5(" ".join(t).encode()).hexdigest()[:15], 16))):
            seed = next((s for s in groups if 100 * sum(x == y for x, y in zip(s, t)) >= line_dedup.SIMILAR * len(t)), t)
            groups.setdefault(seed, []).append(t)
        for g in groups.values():
            docs = sum(len(held[t]) for t in g)
            fixed = min(sum("<*>" not in w for w in t) for t in g)
            of = set().union(*(held[t] for t in g))
            if len(of) > 1 and (fixed >= line_dedup.LONG or docs >= line_dedup.SHORT_DOCS):
                first |= dict.fromkeys(g, min(of))
    out = {}
    for doc, text in rows:
        kept = [x for x in (text or "").split("\n") if first.get(t := tuple(re.sub("[0-9]+", "<*>", x).split()), doc) == doc or not t]
        n = len((text or "").split("\n")) - len(kept)
        out[doc] = (n, "\n".join(kept) if n else text)
    return out


def dropped(docs):
    return {x["doc_id"]: (x["n_dropped"], x["text"]) for x in line_dedup.drop_lines(docs).collect()}


def test_lines_against_all_templates_of_a_leaf(spark):
    r = random.Random(4)
    rows = []
    for family in range(12):
        w = ["all", "lines", "begin", *prose(family, r.choice((7, 9, 17, 57))).split()]
        for _ in range(r.choice((2, 5, 9))):
            v = list(w)
            for k in r.sample(range(3, len(w)), r.choice((0, 1, len(w) // 10))):
                v[k] = prose(r.random(), 1, 9**5)
            rows.append((len(rows) + 1, "\n".join([" ".join(v)] * r.choice((1, 2)) + [prose(r.random(), 15)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert dropped(docs) == plain_dropped(rows)


def test_places_of_lines_go_without_arrays(spark):
    """All kinds of white space and digits, told from the words themselves; the plan splits each text once and has no lambda."""
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b1", "22", "<*>", "x<*>y3", "\u00e4\u00a0", " ", "  ", "\t", "\x0b", "\f", "\r", "\n", " \t ", "\u0660"]) for _ in range(r.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id bigint, text string")
    lines = line_dedup.lines_of(docs)
    want = []
    for doc, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n")):
            if t := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]+", "<*>", line)):
                want.append((doc, pos, len(t), sum("<*>" not in w for w in t), int(hashlib.md5(" ".join(t).encode()).hexdigest()[:15], 16)))
    assert sorted((x["id"], x["pos"], x["n"], x["fixed"], x["tpl"]) for x in lines.collect()) == want
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "translate" not in plan


def test_lines_of_the_tables_against_all_templates_of_a_leaf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(x) for x in docs.collect()]
    assert len({d for d, _ in rows}) == len(rows)
    assert dropped(docs) == plain_dropped(rows)


def plain_groups(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().decode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 512), (5, 80, 512), (3, 90, 8)])
def test_groups_against_all_pairs(spark, monkeypatch, words, percent, block):
    r = random.Random(words)
    rows = []
    for base in range(12):
        w = prose(base, r.choice((6, 40, 150, 300))).split()
        for _ in range(r.choice((1, 3, 12))):
            v = list(w)
            for _ in range(r.choice((0, 0, 1, 2, 5, 20))):
                v[r.randrange(len(v))] = "z%d" % r.randrange(99)
            rows.append((len(rows) + 1, " ".join(v)))
    shared = prose("shared", 55)
    rows += [(len(rows) + 1 + i, f"{prose(1000 + i, 8)} {shared}") for i in range(30)]
    rows += [(9001, "a B"), (9002, "A b"), (9003, None), (9004, ""), (9005, "solo")]
    monkeypatch.setattr(jaccard_join.joined, "__defaults__", (block,))
    n, label = plain_groups(rows, words, percent)
    least = {}
    for (doc, _), x in zip(rows, label):
        least[x] = min(least.get(x, doc), doc)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words, percent).collect()}
    assert got == {doc: (k, least[x]) for (doc, _), k, x in zip(rows, n, label)}
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), words, percent)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values()))


def test_pairs_to_verify_grow_with_the_texts(spark, monkeypatch):
    """A family of texts around the threshold: the pairs that are verified stay a few per text and not the square, and bitmaps are small beside the sets."""
    r, rows = random.Random(6), []
    base = prose("family", 400).split()
    for i in range(150):
        v = list(base)
        for k in r.sample(range(len(v)), r.choice((2, 3, 4, 5))):
            v[k] = f"y{i}x{k}"
        rows.append((i + 1, " ".join(v)))
    count, verified = [], jaccard_join.verified

    def counted(pairs, sets, percent):
        count.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    n, label = plain_groups(rows, 3, 90)
    least = {x: min(doc for (doc, _), y in zip(rows, label) if x == y) for x in set(label)}
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.similar_groups(docs).collect()}
    assert got == {doc: least[x] for (doc, _), x in zip(rows, label)}
    assert sum(count) < 8 * len(rows)
    bits = jaccard_join.sets_of(docs, 3, {"doc_id": docs.doc_id}).select("n", "bits").collect()
    assert all(8 * len(x["bits"]) <= 2 * x["n"] for x in bits)


def test_tree_loses_no_pair():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**48, r.integers(3, 400), dtype=np.uint64)
        for _ in range(r.integers(1, 6)):
            x = base.copy()
            x[r.integers(0, len(x), r.integers(0, 1 + len(x) // 15))] = r.integers(0, 2**48)
            sets.append(np.unique(x))
    width = 2048
    bits = np.stack([jaccard_join.folded(jaccard_join.bitmap(s), min(width, jaccard_join.width_of(len(s)))) if jaccard_join.width_of(len(s)) >= width else jaccard_join.folded(np.packbits(np.isin(np.arange(width), (s & np.uint64(width - 1)).astype(int)), bitorder="little").tobytes(), width) for s in sets])
    n = np.array([len(s) for s in sets])
    got = {tuple(sorted(p)) for p in jaccard_join.likely(bits, n, 90).T.tolist()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert want <= got and len(got) < len(sets) ** 2 / 8


def test_tree_tells_families_just_below_the_threshold():
    """Texts that share 88 % with each other: shared hashes that meet in a bit hide nothing, so nearly no pair is left to verify."""
    r = np.random.default_rng(8)
    for size in (200, 500, 1000):
        base, sets = r.integers(0, 2**48, size, dtype=np.uint64), []
        for _ in range(60):
            x = base.copy()
            x[r.permutation(size)[: size // 32 + 1]] = r.integers(0, 2**48, size // 32 + 1, dtype=np.uint64)
            sets.append(np.unique(x))
        raw = [jaccard_join.bitmap(s, parity=True) for s in sets]
        for width in (8 * len(raw[0]), 4 * len(raw[0])):
            bits = np.stack([jaccard_join.folded(x, width, parity=True) for x in raw])
            n = np.array([len(s) for s in sets])
            share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            share = {(i, j): share(i, j) for i in range(60) for j in range(i + 1, 60)}
            got = {tuple(sorted(p)) for p in jaccard_join.likely(bits, n, 90).T.tolist()}
            assert {p for p, x in share.items() if x >= 0.9} <= got
            assert sum(share[p] < 0.9 for p in got) < len(share) / 5


def test_vectors(spark):
    r = np.random.default_rng(3)
    rows, unit = [], lambda x: x / np.linalg.norm(x)
    for _ in range(30):
        c = r.normal(size=24)
        for _ in range(r.integers(1, 9)):
            rows.append((len(rows) + 1, (unit(c) + r.normal(size=24) * 0.02).tolist()))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [2 * x for x in rows[0][1]])]
    rows += [(950, None), (951, []), (952, [0.0] * 24), (953, [float("nan")] * 24), (954, [None, 1.0]), (955, [1.0, 2.0]), (None, [5.0, -1.0, 2.0]), (956, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumnRenamed("x", "y")
    m = np.array([unit(np.array(v)) for _, v in rows[:-8]])
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    for block in (512, 4):
        got = {x["vec_id"]: x for x in vector_dedup.near_duplicates(df, block=block).collect()}
        ids = [v for v, _ in rows[:-8]]
        label = np.array(ids)
        for _ in range(len(ids)):
            label = np.minimum(label, np.where(link, label[None, :], 10**9).min(axis=1))
        assert [(got[v]["n_links"], got[v]["component_id"]) for v in ids] == [(int(k), int(c)) for k, c in zip(link.sum(axis=1), label)]
        for v, _ in rows[-8:]:
            assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (0, v, v is not None)
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 384])
@pytest.mark.parametrize("kind", ["even", "mean", "strong mean", "clusters", "tight groups"])
def test_vector_recall_at_the_threshold(kind, dim):
    """Pairs with a cosine of 0.951 share enough pivots in more than nine of ten cases, however the vectors lie; few others do."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n = 6000
    x = unit(r.normal(size=(n, dim)))
    if "mean" in kind:
        x = unit(x + (1.3 if kind == "strong mean" else 1.0) * unit(r.normal(size=(1, dim))))
    elif kind == "clusters":
        x = unit(unit(r.normal(size=(40, dim)))[r.integers(40, size=n)] + 0.5 * x)
    elif kind == "tight groups":
        x = unit(unit(r.normal(size=(40, dim)))[r.integers(40, size=n)] + 0.15 * x)
    z = r.normal(size=(2000, dim))
    z = unit(z - (z * x[:2000]).sum(axis=1, keepdims=True) * x[:2000])
    y = 0.951 * x[:2000] + np.sqrt(1 - 0.951**2) * z
    centre, pivots = vector_dedup.pivots_of(x[-vector_dedup.SAMPLE :])
    near = [vector_dedup.nearest(v, centre, pivots, vector_dedup.NEAR) for v in (x[:2000], y, x[2000:4000])]
    share = lambda a, b: ((a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1) >= vector_dedup.SHARED).mean()
    assert share(near[0], near[1]) > 0.9
    assert share(near[0], near[2]) < {"clusters": 0.1, "tight groups": 0.3}.get(kind, 0.02)


def test_checked_tokens():
    import zlib

    body = "abcdefghijABCDEFGHIJ0123456789"
    good = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()))
    assert secret_scan.spans(f"é {good} ghp_{body}000000") == [(3, 2, 2 + len(good))]
    assert secret_scan.written(secret_scan.spans("TOKEN = 'abc' secret:abcdefgh")) == "assign:14:29"
    assert secret_scan.spans("ſecret=abcdefghij toKen=abcdefghij") == []


def test_token_codes():
    r = np.random.default_rng(0)
    ranks = (r.integers(0, 2**32, 4001, dtype=np.uint32) >> r.integers(0, 32, 4001, dtype=np.uint32)).astype(np.uint32)
    for cut in (0, 1, 4, 5, 4001):
        docs, counts, back = token_files.unpack(token_files.pack([None, 7], np.array([cut, 0]), ranks[:cut]))
        assert docs == [None, 7] and counts.tolist() == [cut, 0] and (back == ranks[:cut]).all()


def test_least_squares():
    r = np.random.default_rng(1)
    a, b = r.random((20, 60)), r.random(20) * 10
    x = packing.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g > -1e-4).all() and np.abs(g[x > 1e-9]).max() < 1e-4


def test_map_grows_into_the_new_shard_only():
    units = [(s, 0, 100 + s % 37, 1) for s in range(3000)]
    now = sharding.balance(units, 16)
    then = sharding.grow(units, now)
    assert all(then[k] in (now[k], 16) for k in now)
    load = collections.Counter()
    for s, p, n, _ in units:
        load[then[s, p]] += n
    assert max(load.values()) < 1.02 * min(load.values())


def test_held_out_pages():
    """The block model on fillings of the layouts that it has not seen, and on markup that is cut off."""
    from wayframe.llm import labelled_pages

    crf = html_text.model()
    wrong = total = 0
    for page in labelled_pages.filled(3, seed=99):
        blocks = html_text.blocks_of(page)
        wrong += sum(y != b[3] for y, b in zip(crf.decode(blocks), blocks))
        total += len(blocks)
    assert wrong <= 0.01 * total
    assert html_text.main_text(None, crf) == html_text.main_text("<p>", crf) == ""
    page = "<nav>x y</nav><article><h1>A &amp; B</h1><p>One two&nbsp;three.<p>F<b>ou</b>r.<br>Five.<script>if (a<b) {}</script></article><footer>z</footer>"
    assert html_text.main_text(page, crf) == "A & B One two three. Four. Five."
    assert html_text.main_text(page[: page.index("Five")], crf) == "A & B One two three. Four."


UNSEEN = [
    ("<body><nav><a href='#'>Home</a></nav><main><h1>A title here</h1><p>First words of it that go on. And more.</p></main><div class='x'>© 2024 Some Company. All rights reserved.</div></body>", "A title here First words of it that go on. And more."),
    ("<body><main><h1>A title</h1><p>First words of it that go on. And more.</p></main><div class='reviews'><p>I liked this a lot. We will buy more.</p></div></body>", "A title First words of it that go on. And more."),
    ("<body><article><header><h1>The heading of it</h1></header><p>First words of it that go on. And more.</p></article><footer>foot</footer></body>", "The heading of it First words of it that go on. And more."),
    ("<body><main><p>Prose a | b | c | goes on | for ever | until its end | is near.</p></main><section><p>A reader says: I have read it twice.</p></section></body>", "Prose a | b | c | goes on | for ever | until its end | is near."),
    ("<body><div id='content'><h1>Bars | in the title</h1><p>if a > b then c | d © me, and this goes on</p><p>Another ends here.</p></div><div id='footer'>Imprint</div></body>", "Bars | in the title if a > b then c | d © me, and this goes on Another ends here."),
    ("<body><article><p>One | two | three |<br></article><footer>x</footer></body>", "One | two | three |"),
]


@pytest.mark.parametrize(("page", "text"), UNSEEN)
def test_pages_of_other_layouts(page, text):
    assert html_text.main_text(page, html_text.model()) == text


def test_odd_pages(spark):
    page = "<nav>x</nav><article><p>Some words stand here.</p></article>"
    long = "<article>" + "<p>Many words make up this long text.</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "c", 5), (1, "u", page, "c", 5), (None, None, page, "c", 5), (2, "v", None, "c", 5), (3, "w", "", "c", 5), (4, "w", "<p", "c", 5), (5, "l", long, "c", 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    want = {page: "Some words stand here.", long: " ".join(["Many words make up this long text."] * 20_000)}
    assert sorted(got, key=str) == sorted(((i, u, want.get(h, ""), len(want.get(h, ""))) for i, u, h, _, _ in rows), key=str)
    assert html_text.extract(pages.where("false")).count() == 0


def test_ids_of_all_scripts():
    """Pieces are cut before the library normalises: letters that it takes apart, in front of marks, in every script."""
    import unicodedata

    from tokenizers import Tokenizer

    from wayframe.llm import tokens

    r = random.Random(11)
    letters = [chr(c) for c in range(0x20, 0x2FA20) if unicodedata.category(chr(c))[0] in "LMNPSZ" and not 0xAC00 < c < 0xD7A0]
    odd = ["\u0130", "\u0958", "\ufb2a", "BİTTİ", "क़", "אשׁ", "ǅ", "ﬁ", "\u0345", "\u1e9e", "é", "ß", "\u00aa", "\u00b5", "\u0149", "i\u0307", "日本", "\U0001f600", "\u200d"]
    marks = [".", ",", ";", ":", ".,", ": ", ", ", "\n", " ", "  "]
    texts = [x + m for x in odd for m in (".", ",", ";", ":", ". ", ":\n")] + [x + m + y for x in odd for m in ".,;:" for y in ("a", " b", "é")]
    texts += ["".join(r.choice((r.choice(odd), r.choice(letters) * r.choice((1, 2)), r.choice("aZé9"), r.choice(marks))) for _ in range(r.randrange(1, 30))) for _ in range(6000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokens.path_of(name)
        whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
        for t in texts:
            want = whole.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(own(t), own.dtype).tolist() == want, (name, t)
        ids, count = own.batch(pa.array([*texts, None, ""]), 2)
        for t, raw, n in zip([*texts, "", ""], ids.to_pylist(), count.tolist()):
            want = [*whole.encode(t, add_special_tokens=False).ids, 2]
            assert (np.frombuffer(raw, own.dtype).tolist(), n) == (want, len(want)), (name, t)


@pytest.mark.parametrize("size", [60, 400])
def test_each_source_has_its_own_fence(spark, size):
    """Code holds signs in every line, prose does not; what is usual in one source is odd in the other, at any size."""
    r = random.Random(size)
    signs = lambda seed, share: " ".join(w + ("{#}" if r.random() < share else "") for w in prose(seed, 90).split())
    rows = [(i, signs(i, r.uniform(0.15, 0.3)), "en", "code") for i in range(size)]
    rows += [(size + i, signs(size + i, r.uniform(0, 0.01)), "en", "prose") for i in range(size)]
    rows += [(2 * size, signs("odd", 0.6), "en", "prose"), (2 * size + 1, signs("wild", 1.0), "en", "code")]
    got = {x["doc_id"]: x["kept"] for x in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sorted(i for i, k in got.items() if not k) == [2 * size, 2 * size + 1]


def test_running_and_components(spark):
    df = spark.createDataFrame([(i % 7, i, 2) for i in range(500)], "a int, b int, n bigint")
    got = [r["before_n"] for r in running(df, ["a", "b"], ["n"]).orderBy("a", "b").collect()]
    assert got == list(range(0, 1000, 2))
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 101), (103, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100}


def test_catalogue_names():
    assert all(callable(f) for f in catalog.QUERIES.values())
