"""Tar shards of npy members: one member per sample and field.

Spark brings the samples of a shard together and orders them; the per-shard
task only streams them into (or out of) one archive, without holding it.

Archives are gzip streams by default: a member of a few bytes takes a kilobyte of headers and
padding in a plain archive.  ``tar`` and ``tarfile.open`` see by the first bytes which of the two they read,
and so do the readers here.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

METADATA = "__metadata__.json"
SHARD_FILE = "shard-%06d.tar"
MANIFEST, STAGING = "_manifest", "_staging-"
BUFFER = 1 << 16
#: Rows framed at a time and bytes read ahead: some hundred samples of a few members, which stay in the processor's cache.
FRAMED, COMPARED, AHEAD, STEP = 256, 32, 1 << 21, 1 << 18

_NUMPY = {
    T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8",
    T.DoubleType: "float64", T.FloatType: "float32", T.BooleanType: "bool",
}


def _dtype(kind: T.DataType, narrow: bool) -> str:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return "float32" if narrow and isinstance(kind, T.DoubleType) else _NUMPY[type(kind)]


def _member(tar: tarfile.TarFile, name: str, payload: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size = len(payload)
    tar.addfile(info, io.BytesIO(payload))


def _written(name: str, payload: bytes) -> bytes:
    """A member's bytes, further headers included."""
    out = io.BytesIO()
    _member(tarfile.open(fileobj=out, mode="w"), name, payload)
    return out.getvalue()


class _Framer:
    """Members of one size and kind, as tarfile writes them, from one header: only name and checksum differ."""

    def __init__(self, size: int) -> None:
        info = tarfile.TarInfo("")
        info.size = size
        self.head, self.pad = info.tobuf(), bytes(-size % tarfile.BLOCKSIZE)
        self.sum = int(self.head[148:154], 8)

    def frame(self, name: bytes, payload: bytes) -> bytes:
        return b"".join((name.ljust(100, b"\0"), self.head[100:148], b"%06o" % (self.sum + sum(name)), self.head[154:], payload, self.pad))


class _Rows:
    """Samples whose fields have one shape each, as rows of bytes: only digits, checksums and payloads differ."""

    def __init__(self, digits: int, fields: Mapping[str, tuple[bytes, _Framer, int]]) -> None:
        import numpy as np

        row, self.places = b"", []
        for f, (head, framer, nbytes) in fields.items():
            name = f"{'0' * digits}.{f}.npy".encode()
            self.places.append((len(row), len(row) + tarfile.BLOCKSIZE + len(head), framer.sum + sum(name)))
            row += framer.frame(name, head + bytes(nbytes))
        self.row, self.digits = np.frombuffer(row, np.uint8), digits

    def frame(self, index, payloads: Sequence) -> memoryview:
        """The bytes of samples of these numbers, from a matrix of bytes per field."""
        import numpy as np

        rows = np.empty((len(index), len(self.row)), np.uint8)
        rows[:] = self.row
        number = (index[:, None] // 10 ** np.arange(self.digits - 1, -1, -1) % 10).astype(np.uint8)
        total = number.sum(1, dtype=np.int64)
        for (at, start, base), payload in zip(self.places, payloads):
            rows[:, at : at + self.digits] += number
            rows[:, at + 148 : at + 154] = _octal(total + base)
            rows[:, start : start + payload.shape[1]] = payload
        return rows.reshape(-1).data


def _octal(sums):
    """Checksums as the six digits that headers hold."""
    import numpy as np

    return (sums[:, None] >> np.arange(15, -1, -3) & 7).astype(np.uint8) + 48


def _even(column, dtype: str):
    """An Arrow column as one array, rows first; None where rows differ in shape, are absent, or hold a null that ``dtype`` can't say."""
    import numpy as np
    import pyarrow as pa

    shape = [len(column)]
    while pa.types.is_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        if column.null_count or not len(sizes) or not sizes[0] or (sizes != sizes[0]).any():
            return None
        shape.append(int(sizes[0]))
        column = column.flatten()
    if column.null_count:
        if np.dtype(dtype).kind not in "fb":
            return None
        column = column.fill_null(False if dtype == "bool" else float("nan"))  # as np.asarray takes None
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)).reshape(shape)


def _store(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _unpacked(src) -> io.BufferedIOBase:
    """The bytes of an archive, gzip or plain."""
    raw = io.BufferedReader(src, BUFFER)
    return raw if raw.peek(2)[:2] != b"\x1f\x8b" else gzip.GzipFile(fileobj=raw)


def _opened(src) -> tarfile.TarFile:
    """The archive in a stream of bytes, gzip or plain, read from front to back."""
    return tarfile.open(fileobj=io.BufferedReader(_unpacked(src), BUFFER), mode="r|")


class _Ahead:
    """A stream of bytes, read from front to back, and ahead: ``held`` from ``lo`` to ``hi`` comes next.

    What goes wrong in reading ahead is raised when those bytes are wanted.
    """

    def __init__(self, src: io.BufferedIOBase) -> None:
        self.src, self.held, self.lo, self.hi, self.at, self.wrong = src, bytearray(AHEAD), 0, 0, 0, None

    def ahead(self, n: int) -> int:
        """How many of the next bytes are held: ``n`` or more, if there are so many and they fit."""
        if self.hi - self.lo < n <= len(self.held) and self.wrong is None:
            left = self.hi - self.lo
            self.held[:left] = self.held[self.lo : self.hi]
            self.lo, self.hi = 0, left
            try:
                with memoryview(self.held) as view:
                    while self.hi < len(view) and (got := self.src.readinto(view[self.hi : self.hi + STEP])):
                        self.hi += got
            except (OSError, EOFError, zlib.error) as e:
                self.wrong = e
        return self.hi - self.lo

    def peek(self, n: int) -> bytes:
        n = min(n, self.ahead(n))
        return bytes(self.held[self.lo : self.lo + n])

    def skip(self, n: int) -> None:
        """Past bytes that are held."""
        self.lo, self.at = self.lo + n, self.at + n

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0 and (have := min(n, self.ahead(1))):
            parts.append(bytes(self.held[self.lo : self.lo + have]))
            self.skip(have)
            n -= have
        if n > 0 and self.wrong is not None:
            raise self.wrong
        return b"".join(parts)

    def tell(self) -> int:
        return self.at

    def seek(self, to: int) -> None:
        while self.at < to and self.read(min(to - self.at, STEP)):
            pass


def _plain_member(head: bytes) -> tarfile.TarInfo | None:
    """What a header says, if it is one of a member without further headers."""
    try:
        m = tarfile.TarInfo.frombuf(head, tarfile.ENCODING, "surrogateescape")
    except tarfile.HeaderError:
        return None
    return m if m.type in (tarfile.REGTYPE, tarfile.AREGTYPE) and m.size >= 0 else None


class _Alike:
    """Samples that differ from a given one in digits, checksums and payloads only; they are read many at a time."""

    @classmethod
    def of(cls, members: Sequence[tuple[str, str, bytes, int]], wanted: Mapping, kinds) -> "_Alike | None":
        """From key, field, bytes and size of a sample's members; None if they can't be told from their bytes alone, or given in these kinds."""
        key = members[0][0]
        if not (key.isascii() and key.isdigit() and len(key) <= 18):
            return None
        for k, f, raw, size in members:
            said = 10 + int.from_bytes(raw[520:522], "little")
            if k != key or not raw.startswith(f"{key}.{f}.npy".encode()) or f in wanted and (raw[512:519] != b"\x93NUMPY\x01" or said > size):
                return None
            if raw[148:156] != b"%06o\0 " % (256 + sum(raw[:148]) + sum(raw[156:512])):
                return None
        alike = cls(members, wanted)
        return alike if 2 * alike.size <= AHEAD and all(alike.fits(f, kinds.field(f).type) for f in alike.fields) else None

    def __init__(self, members: Sequence[tuple[str, str, bytes, int]], wanted: Mapping) -> None:
        import numpy as np

        row = b"".join(m[2] for m in members)
        self.digits, self.size, self.fields, self.starts = len(members[0][0]), len(row), {}, []
        fixed, at = np.full(len(row), 255, np.uint8), 0
        for key, f, raw, size in members:
            start, end = at + 512, at + 512 + size
            if f in wanted:
                a = np.load(io.BytesIO(raw[512 : 512 + size]), allow_pickle=False)
                start += 10 + int.from_bytes(raw[520:522], "little")
                self.fields[f] = (start, a.nbytes, a.dtype, a.shape, a.flags.c_contiguous and start + a.nbytes == end)
            self.starts.append((at, 256 + sum(raw[:148]) + sum(raw[156:512]) - sum(map(int, key))))
            fixed[at : at + len(key)] = fixed[at + 148 : at + 154] = fixed[start:end] = 0
            at += len(raw)
        self.row, self.fixed = np.frombuffer(row, np.uint8).view(np.uint64), fixed.view(np.uint64)
        self.differ = np.empty((COMPARED, len(self.row)), np.uint64)

    def first(self, held: bytearray, at: int, n: int):
        """Of ``n`` such rows at most: their numbers and bytes, up to the first that differs or shares its number with the next."""
        import numpy as np

        rows = np.frombuffer(held, np.uint8, n * self.size, at).reshape(n, self.size)
        number = rows[:, : self.digits] - 48
        good, words = (number <= 9).all(1), rows.view(np.uint64)
        for lo in range(0, n, COMPARED):
            differ = self.differ[: min(COMPARED, n - lo)]
            np.bitwise_xor(words[lo : lo + COMPARED], self.row, out=differ)
            differ &= self.fixed
            if differ.view(np.bool_).any():
                good[lo : lo + COMPARED] &= ~differ.view(np.bool_).any(1)
        total = number.sum(1, dtype=np.int64)
        for start, base in self.starts:
            good &= (rows[:, start : start + self.digits] == rows[:, : self.digits]).all(1)
            good &= (rows[:, start + 148 : start + 154] == _octal(total + base)).all(1)
        n = n if good.all() else int(good.argmin())
        index = number[:n].astype(np.int64) @ 10 ** np.arange(self.digits - 1, -1, -1)
        # The last one may go on in what follows.
        n = int(np.append(index[1:] == index[:-1], True).argmax()) if n else 0
        return index[:n], rows[:n]

    def column(self, rows, f: str, kind):
        """A field of such rows, as Arrow holds it."""
        import numpy as np
        import pyarrow as pa

        start, nbytes, dtype, shape, _ = self.fields[f]
        flat = rows[:, start : start + nbytes].copy().reshape(-1).view(dtype)  # the bytes are read over
        kinds = [kind]
        for _ in shape:
            kinds.append(kinds[-1].value_type)
        out = pa.array(flat, from_pandas=True).cast(kinds[-1])  # what is no number is null
        n = len(flat)
        for size, of in zip(reversed(shape), reversed(kinds[:-1])):
            out = pa.ListArray.from_arrays(np.arange(0, n + 1, size, dtype=np.int32), out, type=of)
            n //= size
        return out

    def fits(self, f: str, kind) -> bool:
        """Whether :meth:`column` gives a field in this kind."""
        import pyarrow as pa

        _, _, dtype, shape, whole = self.fields[f]
        for _ in shape:
            if not pa.types.is_list(kind):
                return False
            kind = kind.value_type
        whole &= dtype.isnative and 0 not in shape
        if dtype.kind == "i":
            return whole and pa.types.is_signed_integer(kind) and kind.bit_width >= 8 * dtype.itemsize
        if dtype.kind == "f":
            return whole and dtype.itemsize in (4, 8) and kind in (pa.float32(), pa.float64()) and kind.bit_width >= 8 * dtype.itemsize
        return whole and dtype.kind == "b" and pa.types.is_boolean(kind)


def _archives(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """The archives' paths, dealt out over ``tasks`` (as many as the session shuffles with, by default).

    The number is stated, as adaptive execution would merge the tiny rows into one task.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tar").load(path).select("path")
    return listed.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


@dataclass
class _Written(WriterCommitMessage):
    """What a task wrote: metadata of each archive, and its place in the staging folder."""

    shards: list[tuple[dict, str]]


class _TarWriter(DataSourceArrowWriter):
    """Tasks write whole archives into a staging folder of the job; the driver publishes them when all are there.

    On commit the manifest goes first and comes last: without it, the folder is no finished data set.  Old archives go, so a
    rerun with fewer shards leaves none behind.  Only files that the successful attempts report are moved; the staging folder, with what failed
    or repeated attempts left in it, goes on commit and on abort.
    """

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.index, self.shard, self.level = path, options["index"], options["shard"], int(options["level"])
        self.dtypes: dict[str, str] = json.loads(options["dtypes"])
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        import numpy as np
        import pyarrow as pa

        store, base = _store(self.path)
        mine = f"{base}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done: list[tuple[dict, str]] = []
        state: dict = {}
        heads: dict = {}  # npy headers and frames by field and shape
        alike: dict = {}  # whole rows by digits and shapes

        def put(data: bytes | memoryview) -> None:
            state["zip"].write(data)
            state["size"] += len(data)

        def close() -> None:
            if not state:
                return
            meta = {"shard_idx": state["shard"], "first_sample_idx": state["first"], "last_sample_idx": state["last"], "sample_count": state["n"]}
            put(_written(METADATA, json.dumps(meta).encode()))
            put(bytes(2 * tarfile.BLOCKSIZE + -(state["size"] + 2 * tarfile.BLOCKSIZE) % tarfile.RECORDSIZE))
            state["zip"].close()
            state["out"].close()
            done.append((meta, state["name"]))
            state.clear()

        def enter(s: int, i: int) -> None:
            if state.get("shard") != s:
                close()
                name = f"{mine}/{s}.tar"
                out = store.open_output_stream(name)
                # Without time and name, so that a rerun gives the same bytes.
                packed = gzip.GzipFile("", "wb", self.level, out, mtime=0) if self.level else out
                state.update(shard=s, first=i, n=0, name=name, out=out, zip=packed, size=0)

        def framed(f: str, a: np.ndarray) -> tuple[bytes, _Framer]:
            known = heads.get((f, a.shape))
            if known is None:
                buf = io.BytesIO()
                np.save(buf, a, allow_pickle=False)
                known = heads[(f, a.shape)] = buf.getvalue()[: len(buf.getvalue()) - a.nbytes], _Framer(len(buf.getvalue()))
            return known

        def one_by_one(batch) -> None:
            columns = [batch.column(f).to_pylist() for f in self.dtypes]
            for s, i, *values in zip(batch.column(self.shard).to_pylist(), batch.column(self.index).to_pylist(), *columns):
                enter(s, i)
                members = []
                for (f, dtype), v in zip(self.dtypes.items(), values):
                    a = np.asarray(v, dtype=dtype)
                    head, framer = framed(f, a)
                    name = f"{i:08d}.{f}.npy".encode()
                    if len(name) <= tarfile.LENGTH_NAME:
                        members.append(framer.frame(name, head + a.tobytes()))
                    else:
                        put(b"".join(members))
                        members = []
                        put(_written(name.decode(), head + a.tobytes()))
                put(b"".join(members))
                state["last"], state["n"] = i, state["n"] + 1

        def together(batch) -> bool:
            """Many rows at a time, if they are alike."""
            arrays = {f: _even(batch.column(f), dtype) for f, dtype in self.dtypes.items()}
            if not batch.num_rows or not arrays or any(a is None for a in arrays.values()):
                return False
            if any(batch.column(c).null_count or not pa.types.is_integer(batch.column(c).type) for c in (self.shard, self.index)):
                return False
            shards, index = (batch.column(c).to_numpy().astype(np.int64) for c in (self.shard, self.index))
            digits = np.maximum(8, (index[:, None] >= 10 ** np.arange(1, 19)).sum(1) + 1)
            if index.min() < 0 or any(digits.max() + len(f".{f}.npy".encode()) > tarfile.LENGTH_NAME for f in arrays):
                return False
            payloads = [a.reshape(-1).view(np.uint8).reshape(len(a), -1) for a in arrays.values()]
            shapes = tuple(a.shape[1:] for a in arrays.values())
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (digits[1:] != digits[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(index)]):
                kind = (int(digits[lo]), shapes)
                if kind not in alike:
                    alike[kind] = _Rows(kind[0], {f: (*framed(f, a[0]), a[0].nbytes) for f, a in arrays.items()})
                enter(int(shards[lo]), int(index[lo]))
                rows = max(1, min(FRAMED, FRAMED * 4096 // len(alike[kind].row)))
                for at in range(lo, hi, rows):
                    end = min(at + rows, hi)
                    put(alike[kind].frame(index[at:end], [p[at:end] for p in payloads]))
                state["last"], state["n"] = int(index[hi - 1]), state["n"] + int(hi - lo)
            return True

        for batch in iterator:
            if not together(batch):
                one_by_one(batch)
        close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        store, base = _store(self.path)
        shards = sorted(((meta, name) for m in messages if m is not None for meta, name in m.shards), key=lambda s: s[0]["shard_idx"])
        if store.get_file_info(f"{base}/{MANIFEST}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{MANIFEST}")
        if store.get_file_info(base).type == fs.FileType.NotFound:
            store.create_dir(base, recursive=True)
        here = store.get_file_info(fs.FileSelector(base))
        stale = [f.path for f in here if f.base_name.startswith("shard-") and f.base_name.endswith(".tar")]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(store.delete_file, stale))
            list(pool.map(lambda s: store.move(s[1], f"{base}/{SHARD_FILE % s[0]['shard_idx']}"), shards))
        lines = "".join(json.dumps({**meta, "file": SHARD_FILE % meta["shard_idx"]}) + "\n" for meta, _ in shards)
        store.create_dir(f"{base}/{MANIFEST}", recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}/part-00000.json") as out:
            out.write(lines.encode())
        self._clear(store, base)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


class TarShards(DataSource):
    """``df.write.format("wayframe_tar")``: see :func:`write_tar_shards`."""

    @classmethod
    def name(cls) -> str:
        return "wayframe_tar"

    def writer(self, schema: T.StructType, overwrite: bool) -> _TarWriter:
        return _TarWriter(self.options["target"], {k: self.options[k] for k in ("index", "shard", "dtypes", "level")})


def write_tar_shards(
    df: DataFrame,
    path: str,
    fields: Sequence[str],
    index: str = "sample_idx",
    shard: str = "shard_idx",
    tasks: int | None = None,
    narrow: bool = False,
    level: int = 1,
) -> DataFrame:
    """Write one archive per shard and return the manifest (shard, first, last, count, file).

    ``index`` and ``shard`` come from sharding.index_and_shard.  The write replaces what the folder held, in two steps: tasks write
    into a staging folder, and the driver publishes all archives once every task has committed, the manifest last (JSON lines
    beside the shards).  A job that fails leaves the folder as it was.  ``tasks`` is the number of writers; the session's
    shuffle partitions by default.  ``narrow`` stores doubles as float32; ``level`` is that of gzip, 0 for plain archives.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    dtypes = {f: _dtype(df.schema[f].dataType, narrow) for f in fields}
    # A stated number: adaptive execution must not merge small partitions of a slow writer.
    writers = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(shard, index, *[c for c in fields if c not in (shard, index)]).repartition(writers, shard).sortWithinPartitions(shard, index)
    spark.dataSource.register(TarShards)
    options = {"target": path, "index": index, "shard": shard, "dtypes": json.dumps(dtypes), "level": str(level)}
    placed.write.format(TarShards.name()).mode("overwrite").options(**options).save()
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published archives of a folder; one without a manifest is an error."""
    kinds = "shard_idx bigint, first_sample_idx bigint, last_sample_idx bigint, sample_count bigint, file string"
    return spark.read.schema(kinds).json(f"{path.rstrip('/')}/{MANIFEST}")


def read_tar_shards(
    spark: SparkSession, path: str, fields: Mapping[str, str], required: Sequence[str] | None = None, tasks: int | None = None
) -> DataFrame:
    """Samples of all shards: ``file``, ``sample_idx`` and the fields (Spark type names).

    Samples without all ``required`` fields (by default, all fields) are dropped.
    Only paths go through the listing; each of ``tasks`` tasks (the session's shuffle partitions by default) streams its own archives.
    """
    path = path.rstrip("/")
    needed = set(fields if required is None else required)
    names = list(fields)
    schema = T.StructType.fromDDL("file string, sample_idx bigint, " + ", ".join(f"`{n}` {t}" for n, t in fields.items()))

    kinds = to_arrow_schema(schema)

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyarrow import fs

        heads: dict = {}  # dtype and shape by npy header: few differ, and parsing them is slow
        latest: dict = {}  # what samples were last read together by

        def decode(raw: bytes) -> object:
            # A version 1 header is 10 bytes and as many more as its bytes 8 and 9 say.
            end = 10 + int.from_bytes(raw[8:10], "little")
            if raw[6:7] != b"\x01":
                return np.load(io.BytesIO(raw), allow_pickle=False).tolist()
            known = heads.get(raw[:end])
            if known is None:
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                if a.flags.c_contiguous:
                    heads[raw[:end]] = (a.dtype, a.shape)
                return a.tolist()
            return np.frombuffer(raw, known[0], offset=end).reshape(known[1]).tolist()

        def column(values: tuple, kind: pa.DataType) -> pa.Array:
            try:
                return pa.array(values, kind, from_pandas=True)
            except (pa.ArrowException, TypeError, OverflowError):  # another kind than the stored one
                series = pd.Series(list(values))
                try:
                    return pa.Array.from_pandas(series, series.isnull(), kind, safe=False)
                except pa.ArrowInvalid:
                    return pa.Array.from_pandas(series, series.isnull()).cast(kind, safe=False)

        def packed(parts: list) -> pa.RecordBatch:
            parts = [p if isinstance(p, pa.RecordBatch) else pa.RecordBatch.from_arrays([column(c, k) for c, k in zip(zip(*p), kinds.types)], schema=kinds) for p in parts]
            return pa.concat_batches(parts) if len(parts) > 1 else parts[0]

        def samples(file: str, stream: _Ahead) -> Iterator:
            """Lists of rows, and record batches of samples that are alike."""
            at, got, rows = None, {}, []
            own, before = [], None  # the sample's members so far, None if some are of another kind; names and sizes of the sample before
            wait, pause = 0, 1  # samples until the next attempt to read many, and after one in vain

            def take(key: str, field: str, load) -> None:
                nonlocal at, got
                if int(key) != at:
                    finish()
                    at, got = int(key), {}
                if field in fields:
                    got[field] = decode(load())

            def finish() -> None:
                nonlocal at
                if at is not None and needed <= set(got):
                    rows.append((file, at, *[got.get(n) for n in names]))
                at = None

            while (m := _plain_member(stream.peek(tarfile.BLOCKSIZE))) is not None:
                key, field, _ = m.name.rsplit(".", 2) if m.name.endswith(".npy") else (None, None, None)
                if key is not None and at is not None and int(key) != at:
                    finish()
                    if len(rows) >= 256:
                        yield rows
                        rows = []
                    shape = own and [(f, len(raw)) for _, f, raw, _ in own]
                    index, wait = (), max(wait - 1, 0)
                    if shape and shape == before and not wait:
                        for alike in (latest.get("alike"), None):
                            if alike is None:
                                alike = latest["alike"] = _Alike.of(own, fields, kinds)
                            if alike is not None and stream.ahead(2 * alike.size) >= 2 * alike.size and len(alike.first(stream.held, stream.lo, 2)[0]):
                                index, found = alike.first(stream.held, stream.lo, (stream.hi - stream.lo) // alike.size)
                                break
                        if n := len(index):
                            if rows:
                                yield rows
                                rows = []
                            if needed <= set(alike.fields):
                                columns = [alike.column(found, f, kinds.field(f).type) if f in alike.fields else pa.nulls(n, kinds.field(f).type) for f in names]
                                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), n), pa.array(index), *columns], schema=kinds)
                            stream.skip(n * alike.size)
                            pause = 1
                        else:
                            wait, pause = pause, min(2 * pause, 1024)
                    own, before = [], shape
                    if len(index):
                        continue
                size = m.size + -m.size % tarfile.BLOCKSIZE
                if own is not None and (key is None or size > AHEAD):
                    own = None
                if key is None or field not in fields and own is None:
                    stream.seek(stream.tell() + tarfile.BLOCKSIZE + size - 1)
                    raw = stream.read(1)
                    if not raw:
                        raise tarfile.ReadError("unexpected end of data")
                    if key is not None:
                        take(key, field, None)
                    continue
                raw = stream.read(tarfile.BLOCKSIZE + size)
                if len(raw) < tarfile.BLOCKSIZE + size:
                    raise tarfile.ReadError("unexpected end of data")
                take(key, field, lambda: raw[tarfile.BLOCKSIZE : tarfile.BLOCKSIZE + m.size])
                if own is not None:
                    own.append((key, field, raw, m.size))
            # What is no plain member, the archive's end included, is for tarfile, and so is all that follows.
            with tarfile.TarFile(fileobj=stream, stream=True) as tar:
                for m in tar:
                    if m.name.endswith(".npy"):
                        key, field, _ = m.name.rsplit(".", 2)
                        take(key, field, lambda: tar.extractfile(m).read())
                        if len(rows) >= 256:
                            yield rows
                            rows = []
            finish()
            if rows:
                yield rows

        for batch in batches:
            for p in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(p if "://" in p else p.replace("file:", "file://", 1))
                with store.open_input_stream(name) as src:
                    parts, n = [], 0
                    for part in samples(p.rsplit("/", 1)[-1], _Ahead(_unpacked(src))):
                        parts.append(part)
                        n += len(part)
                        if n >= 1000:
                            yield packed(parts)
                            parts, n = [], 0
                    if parts:
                        yield packed(parts)

    return _archives(spark, path, tasks).mapInArrow(read, schema)


def shard_counts(spark: SparkSession, path: str) -> DataFrame:
    """Per archive: the sample count its metadata states, or else its counted frame ids, and the ``reason`` of a null count.

    A malformed archive has no count.  A store that fails to answer fails the task, which Spark repeats.
    """
    path = path.rstrip("/")

    def count(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        for pdf in frames:
            rows = []
            for p in pdf["path"].tolist():
                n, stated, reason = 0, 0, None
                try:
                    store, name = fs.FileSystem.from_uri(p if "://" in p else p.replace("file:", "file://", 1))
                    with store.open_input_stream(name) as src, _opened(src) as tar:
                        for m in tar:
                            if m.name == METADATA:
                                stated = int(json.loads(tar.extractfile(m).read()).get("sample_count", 0))
                            elif m.name.endswith(".frame_id.npy"):
                                n += 1
                except (tarfile.TarError, zlib.error, EOFError, gzip.BadGzipFile, ValueError) as e:
                    n, stated, reason = 0, 0, f"malformed archive: {e}"
                if not (stated or n or reason):
                    reason = "no samples"
                rows.append((p.rsplit("/", 1)[-1], stated or n or None, reason))
            yield pd.DataFrame(rows, columns=["file", "sample_count", "reason"]).astype({"sample_count": "Int64", "reason": object})

    return _archives(spark, path).mapInPandas(count, "file string, sample_count bigint, reason string")
