"""Secret scan: keyword automaton, anchored expressions at its hits, checksums inside the tokens.

One Aho-Corasick pass over the whole text, with A-Z lowered, finds the literals that every pattern but one
starts with; a pattern is tried only where its literal stands.  Runs of hex digits have no literal
and are found by their own expression.  Access tokens that carry a checksum of themselves count
only if it fits.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns, and the token formats that end in a base-62 CRC-32 of their body.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED_HEADS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "checked")
MIN_VALUE, MIN_ACCESS = 8, 16


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, BASE62[0])


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, literals in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_HEADS)):
        for w in literals:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_built: list = []


def spans(text: str) -> list[tuple[int, int, str]]:
    """(kind number, start, end) of all spans, by start and kind; code points, end exclusive."""
    if not _built:
        _built.append(_automaton())
    found = [(m.start(), HEX_NO, m.end()) for m in HEX.finditer(text)]
    done = {"assign": 0, "access": 0}  # where the last match of a kind ended, kept or not
    # bytes.lower() changes A-Z only, so every character keeps its place
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()
    hits = [(end - n + 1, kind) for end, (kind, n) in _built[0].iter(lowered)]
    hits.sort()
    for at, kind in hits:
        if kind == "checked":
            m = CHECKED.match(text, at)
            if m and (at == 0 or not text[at - 1].isalnum()) and base62(zlib.crc32(m[1].encode())) == m[2]:
                found.append((at, 3, m.end()))
        elif at >= done[kind]:
            m = (ASSIGN if kind == "assign" else ACCESS).match(text, at)
            if m:
                done[kind] = m.end()
                if kind == "assign" and len(m[1]) >= MIN_VALUE:
                    found.append((at, 0, m.end()))
                elif kind == "access" and m.end() - at >= MIN_ACCESS:
                    found.append((at, 1, m.end()))
    found.sort()
    return [(k, s, e) for s, k, e in found]


HEX_NO = KINDS.index("hex")


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans.

    Null and empty texts have no spans (base_sha256 of the empty string); long ones are scanned as a whole, in time that grows with their length.  Rows are scanned one by one, so
    repeated rows and null doc_ids give rows alike; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                found = spans(t) if t else []
                base = [x for x in found if x[0] <= HEX_NO]
                rows.append((*(sum(x[0] == k for x in found) for k in range(len(KINDS))), hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_checked bigint, base_sha256 string, spans string")


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
