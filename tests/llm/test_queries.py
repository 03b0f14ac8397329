"""The corpus queries over the smallest tables: against their SQL, or against a plain version in Python."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tools.compare import TABLES, rows_of
from wayframe.llm import catalog, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def run(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 14))


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def test_secret_scan(spark, con):
    larger = SF.replace("0.001", "0.01")  # the smallest table holds no secret
    documents = con.execute(f"SELECT doc_id, text FROM '{larger}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r.asDict() for r in catalog.QUERIES["op2_secret_scan"](spark, larger).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        want = plain_secrets(text or "")
        digest = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        r = got[doc_id]
        counts = Counter(k for _, k, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (counts[0], counts[1], counts[2], digest)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0


def all_ids(name, documents, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path_of(name))
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, end] for d, x in documents}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, documents):
    ids, start, want = all_ids("word_bpe_49k.json", documents, 2), 0, {}
    for d, _ in documents:
        want[d] = (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op3_token_files")} == want


def test_packing(spark, documents):
    ids = all_ids("byte_bpe_50k.json", documents, 1)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in run(spark, "op7_pack_windows"):
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, x in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(x)
    total = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += 2048
    assert total <= 1.03 * sum(map(len, ids.values())) + 2048


def test_sharding(spark, documents):
    rows = run(spark, "op9_virtual_slots")
    size = {d: len((x or "").encode()) + 1 for d, x in documents}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (size[d], zlib.crc32((x or "").encode())) for d, x in documents}
    held, places = Counter(), defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert r["rebalanced_shard"] in (r["shard"], 16)
    assert set(held) == set(range(16)) and max(held.values()) - min(held.values()) < max(size.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    moved = sum(r["size"] for r in rows if r["rebalanced_shard"] == 16)
    assert 0.8 * sum(size.values()) / 17 < moved < 1.2 * sum(size.values()) / 17


def plain_article(page):
    """These pages hold their text in one article element, with b as the only tag inside a line."""
    page = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page)
    inside = re.sub(r"</?b>", "", re.search(r"(?s)<article[^>]*>(.*?)</article>", page)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_html_text(spark):
    larger = SF.replace("0.001", "0.1")
    pages = duckdb.execute(f"SELECT page_id, url, html FROM '{larger}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in catalog.QUERIES["op5_html_text"](spark, larger).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        want = plain_article(page)
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, want, len(want))
