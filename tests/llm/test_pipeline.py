"""The whole pipeline over the smallest tables, against plain versions of its stages put one after the other."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest

from wayframe.llm import mixing, quality

from .test_edges import plain_dropped
from .test_queries import SF, all_ids, crc


def good(docs):
    """Documents that pass the rules, by the SQL of the rules."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.sql(quality.BASE_COUNTS_SQL)}) WHERE kept").fetchall()}
    return [d for d in docs if d[0] in kept]


def without_lines(docs):
    lost = plain_dropped([(d[0], d[1]) for d in docs])
    words = lambda text: sum(1 for x in (text or "").split("\n") if x.split())
    return [(d[0], lost[d[0]][1], d[2], d[3], len(lost[d[0]][1]) if lost[d[0]][0] else d[4]) for d in docs if not lost[d[0]][0] or lost[d[0]][0] < words(d[1])]


def one_of_each(docs):
    """The first document of each group linked by 80 % of their five-word shingles."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(d[0], shingles(d[1])) for d in docs]
    group = {i: i for i, _ in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                lo, hi = sorted((root(i), root(j)))
                group[hi] = lo
    return [d for d in docs if root(d[0]) == d[0]]


def mixture(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall())
    return [d for d in docs for _ in range(copies[d[0]])]


PLAIN = {"quality_rules": good, "line_dedup": without_lines, "near_duplicates": one_of_each, "mix_sources": mixture}


@pytest.fixture(scope="module")
def start():
    docs = duckdb.execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    assert len({d[0] for d in docs}) == len(docs)
    return docs


def test_stages_equal_plain_versions(spark, start):
    docs = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        docs = sorted(PLAIN[name](docs), key=str)
        got = sorted(map(tuple, stage(spark, given, SF).collect()), key=str)
        assert got == docs, name
    assert 50 < len(docs) != len(start)


def test_whole_pipeline(spark, start):
    docs = start
    for plain in PLAIN.values():
        docs = plain(docs)
    ids = all_ids("byte_bpe_50k.json", [(d[0], d[1]) for d in docs], 1)
    rows = corpus_pipeline.run(spark, SF).collect()
    taken, pieces, sequences = Counter(d[0] for d in docs), defaultdict(Counter), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for at in (r["start"], r["start"] + r["length"]):
            pieces[r["doc_id"]][at] += 1 if at == r["start"] else -1
    assert set(pieces) == set(taken)
    for d, ends in pieces.items():  # each copy covers its document from 0 to its end, without gap or overlap
        assert {k: v for k, v in ends.items() if v} == {0: taken[d], len(ids[d]): -taken[d]}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_odd_rows(spark, start):
    """Nulls, empty and repeated rows, and an empty table go through every stage."""
    rows = [*start[:40], *start[:3], (None, None, None, None, None), (900001, "", "en", "x", 0), (900002, None, None, "x", 0), (None, start[5][1], None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for given in (docs, docs.where("false")):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        got = now.collect()
        assert (len(got) > 0) == (given is docs)
