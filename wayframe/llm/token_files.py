"""Token files: frequency-ranked ids in a byte-aligned code of variable length.

Ids are replaced by their rank in the corpus, so frequent ones are small.  A file holds, little-endian:

    b"RVB1", number of documents and of ids (u8 each)
    doc_id (i8), whether it is null (u1), number of ids (u8): one of each per document
    control bytes: 2 bits per id, lowest first, its number of data bytes less one
    data bytes: each rank's low bytes

Control bytes look up four lengths at once in a table of 256 rows; the data bytes of a whole file then
fall into place with one mask.  The rank table is stored beside the files.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayframe.llm import tokens
from wayframe.llm.common import fresh_dir, running, settle

MAGIC = b"RVB1"
TOKENIZER, END = "word_bpe_49k.json", 2
#: A file is closed once it has this many ids; a document is never split over files.
IDS_PER_FILE = 4_000_000

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_PLACE = np.arange(4)


def pack(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One file's bytes."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_PLACE < lengths[:, None]]
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    head = np.array([len(ids), len(ranks)], "<u8")
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in (MAGIC, head, ids, nulls, np.asarray(counts, "<u8"), control, data))


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, ranks."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n = (int(x) for x in np.frombuffer(blob, "<u8", 2, 4))
    at = 20
    ids = np.frombuffer(blob, "<i8", docs, at)
    nulls = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    control = np.frombuffer(blob, np.uint8, -(-n // 4), at)
    lengths = _LENGTHS[control].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_PLACE < lengths[:, None]] = np.frombuffer(blob, np.uint8, int(lengths.sum(dtype=np.int64)), at + len(control))
    return [None if z else int(x) for x, z in zip(ids, nulls)], counts, out.view("<u4").ravel()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def rank_table(staged: DataFrame, dtype: str) -> np.ndarray:
    """Ids by falling frequency over the whole corpus, ties by id.  One row per id that occurs: bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n = np.bincount(np.frombuffer(x, dtype))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["id", "n"])

    rows = staged.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], "<u4")


def write_files(staged: DataFrame, path: str, id_of: np.ndarray, dtype: str, per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write rows (rid, doc_id, ids) in ascending doc_id order (null first) and return the manifest (part, k, file, n_docs, n_ids).

    Ties in doc_id are ordered by ids and rid.  Each task writes its own range; a file gets its name when it
    is complete, and the manifest, written by Spark's commit protocol, lists only files of tasks that counted.
    """
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        made: list[tuple] = []
        docs: list = []
        held: list[bytes] = []
        n = 0

        def close() -> None:
            nonlocal n
            if not docs:
                return
            ids = np.frombuffer(b"".join(held), dtype)
            counts = np.array([len(x) for x in held]) // ids.itemsize
            name = f"part-{task.partitionId():06d}-{len(made):05d}-{task.taskAttemptId()}.rvb"
            with store.open_output_stream(f"{base}/{name}.tmp") as out:
                out.write(pack(docs, counts, rank_of[ids]))
            store.move(f"{base}/{name}.tmp", f"{base}/{name}")
            made.append((task.partitionId(), len(made), name, len(docs), len(ids)))
            docs.clear()
            held.clear()
            n = 0

        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                docs.append(doc_id)
                held.append(x)
                n += len(x) // np.dtype(dtype).itemsize
                if n >= per_file:
                    close()
        close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=["part", "k", "file", "n_docs", "n_ids"])

    ordered = staged.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h", "rid").sortWithinPartitions("doc_id", "h", "rid")
    manifest = settle(ordered.select("doc_id", "ids").mapInArrow(write, "part bigint, k bigint, file string, n_docs bigint, n_ids bigint"), "manifest")
    store, base = _store(path)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/ranks.u4") as out:
        out.write(id_of.tobytes())
    return manifest


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """Decode the files of a manifest: (doc_id, start, n_tokens, ids_crc32, file) per document, in no particular order."""
    placed = running(manifest.select("part", "k", "file", "n_ids"), ["part", "k"], ["n_ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        id_of = None
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                if id_of is None:
                    with store.open_input_stream(f"{base}/ranks.u4") as f:
                        id_of = np.frombuffer(f.read(), "<u4")
                with store.open_input_stream(f"{base}/{file}") as f:
                    docs, counts, ranks = unpack(io.BytesIO(f.read()).getvalue())
                ids = memoryview(id_of[ranks].astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins + start), pa.array(counts), pa.array(crc, pa.int64()), pa.array([file] * len(docs))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    # A stated number of partitions: adaptive execution would put the few small rows, and so all files, into one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = placed.select("file", F.col("before_n_ids").cast("bigint").alias("start")).repartition(tasks, "file")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = END, per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode every whole text, write the token files to the shared folder, and return what they hold.

    Null texts are empty documents with the end id only.  Null doc_ids come first; repeated rows are kept
    as so many documents.  A text of any length is encoded as a whole.  An empty table writes no file and gives no row.  Other columns are ignored.
    """
    file = tokenizer or tokens.path_of(TOKENIZER)
    dtype = tokens.dtype_of(file)
    staged = settle(tokens.encoded(docs, file, end), "tokens")
    path = fresh_dir(docs.sparkSession, "token_files")
    manifest = write_files(staged, path, rank_table(staged, dtype), dtype, per_file)
    return read_files(manifest, path)
