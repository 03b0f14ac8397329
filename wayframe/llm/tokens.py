"""Token ids of whole texts, with public tokenizer files and the tokenizers library.

Byte-pair merges never cross the borders that a tokenizer's own splitting rule sets, and a single space
between two words is always such a border.  So a text is cut there and the ids of each piece, computed by
the library once, are kept: natural text repeats its words, and only new pieces cost a library call.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Pieces kept per Python worker in each of two generations, and the longest one that is kept.
KEPT, LONGEST = 500_000, 64
#: Texts encoded at a time.
ROWS = 4096


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_marks() -> dict[int, int]:
    """How byte-level files write the bytes that are no printable Latin-1 character: as the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_MARKS = _byte_marks()
#: Words on which the direct way must agree with the whole tokenizer before it is used.
_PROBES = ("the", "word", "tokenisation", "\u00e9t\u00e9", "stra\u00dfe", "xqzjv", "\u00b5\u00aa")


class _Pieces(dict):
    """piece -> bytes of its ids.  Full generations are set aside; what is still in use comes back from there."""

    def __init__(self, tokenizer, lead: str, dtype: str, marks: _Pieces | None = None, lowers: bool = False):
        super().__init__()
        self._of, self._lead, self._lowers = tokenizer, lead, lowers
        self._merge, self._code = tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[dtype]
        self._marks = self if marks is None else marks
        self._space = chr(_MARKS[ord(" ")]) if lead == " " else ""
        self._direct = all(self._word(w) == self._encode(w) for w in _PROBES)
        self._old: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        return self._bytes(self._of.encode(self._lead + piece, add_special_tokens=False).ids)

    def _word(self, piece: str) -> bytes:
        """A piece of Latin-1 letters in the case that the tokenizer keeps: one word, straight to the library's merge model."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_MARKS)
        return self._bytes([t.id for t in self._merge(self._space + text)])

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self._code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".,;:" and piece[-2] < "\u0100" and piece[-2].isalpha():
            # Latin letters never join the punctuation after them, so both are looked up on their own.  Others may: a
            # tokenizer that lowers or composes its text can leave a mark there, which does.
            return self[piece[:-1]] + self._marks[piece[-1]]
        ids = self._old.get(piece)
        if ids is None:
            latin = max(piece, default="") < "\u0100"
            low = piece.lower() if self._lowers and latin else piece
            if low != piece:
                ids = self[low]
            else:
                ids = self._word(piece) if self._direct and latin and piece.isalpha() else self._encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Bytes of the ids (little-endian, ``dtype``) of whole texts.

    ``spaced``: a word's token carries the space before it (byte-level files); else white space is dropped.
    """

    _near_space = re.compile(r"\A |\s | \s| \Z")
    _border = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.dtype = "<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.spaced = tokenizer.encode("a b", add_special_tokens=False).tokens[1] != tokenizer.encode("b", add_special_tokens=False).tokens[0]
        lowers = tokenizer.encode("A", add_special_tokens=False).ids == tokenizer.encode("a", add_special_tokens=False).ids
        self._bare = _Pieces(tokenizer, "", self.dtype, lowers=lowers)
        self._after = _Pieces(tokenizer, " ", self.dtype, self._bare, lowers)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.spaced:
            return b"".join(map(self._bare.__getitem__, text.replace("\n", " ").split(" ")))
        parts = self._border.split(text) if self._near_space.search(text) else text.split(" ")
        return self._bare[parts[0]] + b"".join(map(self._after.__getitem__, parts[1:]))

    def batch(self, texts: pa.Array, end: int) -> tuple[pa.Array, np.ndarray]:
        """Ids of many texts, each with ``end`` after it, as bytes, and their numbers.

        Pieces are cut and told apart in Arrow; Python sees each different piece of the batch once.
        """
        texts = pc.fill_null(texts, "")
        if self.spaced:
            odd = pc.match_substring_regex(texts, r"(^ )|([\pZ\pC] )|( [\pZ\pC])|( $)")
            plain, whole = texts.filter(pc.invert(odd)), texts.filter(odd)
            order = np.argsort(np.concatenate([np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))]), kind="stable")
        else:
            plain, whole, order = pc.replace_substring(texts, "\n", " "), [], None
        lists = pc.split_pattern(plain, " ")
        starts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if self.spaced:
            first, back = np.unique(codes[starts[:-1]], return_inverse=True)
            codes[starts[:-1]] = len(pieces) + back
            blobs = [*map(self._after.__getitem__, pieces), *(self._bare[pieces[k]] for k in first.tolist())]
            codes = np.concatenate([codes, len(blobs) + np.arange(len(whole))])
            blobs += [self(x) for x in whole.to_pylist()]
            starts = np.concatenate([starts, starts[-1] + 1 + np.arange(len(whole))])
        else:
            blobs = [*map(self._bare.__getitem__, pieces)]
        width = np.dtype(self.dtype).itemsize
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // width
        at = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(blobs), self.dtype)
        n = lengths[codes]
        per_doc = np.add.reduceat(n, starts[:-1]) if len(texts) else np.zeros(0, np.int64)
        ends = np.cumsum(per_doc + 1)
        ids = np.full(int(ends[-1]) if len(ends) else 0, end, self.dtype)
        body = np.ones(len(ids), bool)
        body[ends - 1] = False
        ids[body] = pool[np.repeat(at[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        offsets = np.concatenate([[0], ends * width])
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
        if order is not None:
            out, per_doc = out.take(pa.array(order)), per_doc[order]
        return out.cast(pa.binary()), per_doc + 1


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder per file and Python worker."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def encoded(docs: DataFrame, file: str, end: int) -> DataFrame:
    """Rows (rid, doc_id, ids, n): the ids of each whole text and then ``end``, as bytes of the encoder's dtype.

    A null text is empty.  rid numbers rows uniquely once the result is written (partition and place in it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(file)
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                ids, n = enc.batch(part.column(1), end)
                rid = pa.array(np.arange(at, at + len(n), dtype=np.int64))
                at += len(n)
                yield pa.RecordBatch.from_arrays([rid, part.column(0).cast(pa.int64()), ids, pa.array(n)], names=["rid", "doc_id", "ids", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "rid bigint, doc_id bigint, ids binary, n bigint")


def dtype_of(file: str) -> str:
    return encoder(file).dtype
