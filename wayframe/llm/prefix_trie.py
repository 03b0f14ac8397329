"""The prefix trie of conversations by van Emde Boas recursion.

Depths are cut at half, each half at half again, down to single turns.  A node at depth d hangs from its cut prefix, the node
at depth d less its lowest set bit, by one block of turns; the name of a node is a hash of the cut prefix's name and of the
block's name, which is built from those of its halves.  So every prefix of a conversation is named in as many steps as the
depth has binary digits, and equal prefixes of all conversations get equal names without being compared.

Upper tries and lower forests are built side by side: with level k, windows of 2**k depths have their totals.  Then the nodes
at the cut of the next wider windows graft theirs on each of the nodes above them in the upper half.  A node is grafted at
one level only, so a trie of n nodes and depth d moves about n * log2(d) / 2 rows, not n * d.

A conversation is cut into chunks of CHUNK turns, and no step has more of it in a row.  Turns are numbered over
ranges of the whole table, so one conversation may be most of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm.common import fresh_dir, settle

SHARED, HEADS = 5, 9
CHUNK = 256
NAME = 16
#: Decimal ids are joined into pieces of up to this many characters before they are brought together by node.
PIECE = 1 << 20
ROOT_LEVEL = 99


def short_hash(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * NAME))


def joined_name(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(a + b).digest()[:NAME]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): rows (conv, pos, dig, size, length) of rebuilt turns, and (conv, length) of all, turnless ones too."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    d = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", short_hash(said).alias("dig"), F.octet_length(text).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("salt")
    )
    order = ["conv", "turn", "dig", "salt"]
    path = fresh_dir(spark, "ordered_turns")
    d.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = spark.read.schema(d.schema).parquet(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))
    earlier = Window.partitionBy("conv").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file", "conv").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    files = settle(files, "turn_counts")
    convs = files.groupBy("conv").agg(F.sum("n").alias("n"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = convs.select("conv", "n", head.alias("h"), (F.col("conv") - F.col("conv") % SHARED).alias("base"))
    bases = convs.select(F.col("conv").alias("_base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, F.col("base") == F.col("_base"), "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = settle(convs.select("conv", "h", "base", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    # One row per file and conversation: no join meets more of a conversation than a file holds.
    own = files.select("file", F.col("conv").alias("c"), "offset").join(convs, F.col("c") == F.col("conv")).drop("conv").withColumnRenamed("file", "f")
    own = rows.join(own, (F.col("file") == F.col("f")) & (F.col("conv") == F.col("c")))
    place = F.row_number().over(Window.partitionBy("file", "conv").orderBy("turn", "dig", "salt"))
    own = settle(own.select("conv", (F.col("offset") + place - 1).alias("p"), "dig", "size", "h", "k", "length"), "numbered_turns")
    tails = own.where("p >= h").select("conv", (F.col("k") + F.col("p") - F.col("h")).alias("pos"), "dig", "size", "length")
    heads = own.where(F.col("p") < HEADS - 1).where(F.col("conv") % SHARED == 0).select(F.col("conv").alias("_b"), F.col("p").alias("pos"), "dig", "size")
    heads = heads.join(convs, (F.col("_b") == F.col("base")) & (F.col("pos") < F.col("h"))).select("conv", "pos", "dig", "size", "length")
    return tails.union(heads), convs.select("conv", "length")


def blocks(turns: list[bytes]) -> list[list[bytes]]:
    """Names of the aligned blocks of 1, 2, 4, ... turns."""
    out = [turns]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([joined_name(below[i], below[i + 1]) for i in range(0, len(below) - 1, 2)])
    return out


def named(start: bytes, turns: list[bytes], end: bytes | None) -> list[bytes]:
    """Names of the chunk's nodes, its start included; ``end`` is the name of the last one of a full chunk."""
    level, out = blocks(turns), [start]
    for i in range(1, len(turns) + 1):
        if i == CHUNK:
            out.append(end)
        else:
            low = i & -i
            out.append(joined_name(out[i - low], level[low.bit_length() - 1][i // low - 1]))
    return out


def chunk_starts(chunks: DataFrame) -> DataFrame | None:
    """(conv, j, name): the nodes at the depths j * CHUNK that are reached, by the same recursion over blocks of chunks; None if none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [blocks([t["dig"] for t in turns])[-1][0] for turns in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.binary())], names=["conv", "i", "name"])

    full = chunks.where(F.size("turns") == CHUNK).select("conv", "q", F.transform("turns", lambda t: F.struct(t["dig"].alias("dig"))).alias("turns"))
    level = [settle(full.mapInArrow(run, "conv bigint, i bigint, name binary"), "blocks")]
    if level[0].isEmpty():
        return None
    pair = short_hash(F.concat("name", "_name"))
    while True:
        odd = level[-1].where("i % 2 = 1").select(F.col("conv").alias("_conv"), (F.col("i") - 1).alias("_i"), F.col("name").alias("_name"))
        above = level[-1].join(odd, (F.col("conv") == F.col("_conv")) & (F.col("i") == F.col("_i"))).select("conv", F.expr("i div 2").alias("i"), pair.alias("name"))
        above = settle(above, "blocks")
        if above.isEmpty():
            break
        level.append(above)
    known = level[0].where("i = 0").select("conv", F.lit(0).cast("bigint").alias("j"), F.lit(bytes(NAME)).alias("name"))
    for k in range(len(level) - 1, -1, -1):
        block = level[k].where("i % 2 = 0").select(F.col("conv").alias("_conv"), F.col("i").alias("_i"), F.col("name").alias("_name"))
        cut = known.join(block, (F.col("conv") == F.col("_conv")) & (F.col("j") == F.col("_i") * 2**k))
        known = settle(known.union(cut.select("conv", ((F.col("_i") + 1) * 2**k).alias("j"), pair.alias("name"))), "chunk_starts")
    return known


def paths(turns: DataFrame) -> DataFrame:
    """One row per chunk of a conversation: (conv, q, length, ids, sizes).  ids holds the nodes at depths q * CHUNK onwards as pairs of longs, one more than sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, at = [], [], [0]
            for turns, start, end in zip(*(b.column(c).to_pylist() for c in ("turns", "start", "end"))):
                names += named(start, [t["dig"] for t in turns], end)
                sizes.append([t["size"] for t in turns])
                at.append(len(names))
            flat = np.frombuffer(b"".join(names), "<i8")
            pairs = pa.StructArray.from_arrays([pa.array(flat[0::2]), pa.array(flat[1::2])], names=["a", "b"])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("q"), b.column("length"), ids, pa.array(sizes, pa.list_(pa.int64()))], names=["conv", "q", "length", "ids", "sizes"])

    chunks = turns.groupBy("conv", F.expr(f"pos div {CHUNK}").alias("q")).agg(F.sort_array(F.collect_list(F.struct("pos", "dig", "size"))).alias("turns"), F.max("length").alias("length"))
    chunks = settle(chunks, "turn_chunks")
    known = chunk_starts(chunks)
    root = F.lit(bytes(NAME))
    if known is None:
        chunks = chunks.withColumns({"start": root, "end": F.lit(None).cast("binary")})
    else:
        first = known.select(F.col("conv").alias("_c1"), F.col("j").alias("_j1"), F.col("name").alias("_start"))
        then = known.select(F.col("conv").alias("_c2"), (F.col("j") - 1).alias("_j2"), F.col("name").alias("end"))
        chunks = chunks.join(first, (F.col("conv") == F.col("_c1")) & (F.col("q") == F.col("_j1")), "left").join(then, (F.col("conv") == F.col("_c2")) & (F.col("q") == F.col("_j2")), "left")
        chunks = chunks.withColumn("start", F.coalesce("_start", root))
    return settle(chunks.select("conv", "q", "length", "turns", "start", "end").mapInArrow(run, "conv bigint, q bigint, length bigint, ids array<struct<a: bigint, b: bigint>>, sizes array<bigint>"), "paths")


def level_of(depth: Column) -> Column:
    """The number of zeros at the end of the depth's binary digits; ROOT_LEVEL for the root."""
    return F.when(depth == 0, F.lit(ROOT_LEVEL)).otherwise(F.bit_count(depth.bitwiseAND(-depth) - 1)).cast("int")


def grafts(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """(k, xa, xb, a, b, ak): the node x at the cut of windows of level k, each node above it in the upper half, and that one's own level."""
    spark = nodes.sparkSession
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    wanted = nodes.where("depth > 0").select(F.col("conv").alias("c"), F.col("a").alias("xa"), F.col("b").alias("xb"), "depth", (F.col("depth") - low).alias("top"), level_of(F.col("depth")).alias("k"))
    wanted = wanted.withColumn("cq", F.explode(F.sequence(F.expr(f"top div {CHUNK}"), F.expr(f"(depth - 1) div {CHUNK}"))))
    j = wanted.join(path.select("conv", "q", "ids"), (F.col("c") == F.col("conv")) & (F.col("cq") == F.col("q")))
    first = F.greatest(F.col("top"), F.col("q") * CHUNK)
    last = F.least(F.col("depth") - 1, F.col("q") * CHUNK + CHUNK - 1)
    above = F.slice("ids", (first - F.col("q") * CHUNK + 1).cast("int"), (last - first + 1).cast("int"))
    j = j.select("k", "xa", "xb", first.alias("first"), F.posexplode(above).alias("at", "id"))
    out = j.select("xa", "xb", F.col("id.a").alias("a"), F.col("id.b").alias("b"), level_of(F.col("first") + F.col("at")).alias("ak"), "k")
    folder = fresh_dir(spark, "grafts")
    out.write.partitionBy("k").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def totals(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """(a, b, leaves, saved): what the nodes below each node add to its own, by grafting level after level."""
    top = nodes.agg(F.max("depth")).first()[0]
    above = grafts(nodes, path)
    done = None
    for k in range(int(top).bit_length()):
        x = nodes.where(level_of(F.col("depth")) == k).select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved"))
        if done is not None:
            below = done.where(F.col("ak") == k).select(F.col("a").alias("xa"), F.col("b").alias("xb"), "leaves", "saved")
            x = x.union(below).groupBy("xa", "xb").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moved = above.where(F.col("k") == k).join(x, ["xa", "xb"]).groupBy("a", "b", "ak").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        moved = settle(moved, f"grafted-{k}")
        done = moved if done is None else done.union(moved)
    if done is None:
        return nodes.where("false").select("a", "b", F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved"))
    return done.groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def digests(ends: DataFrame) -> DataFrame:
    """(a, b, conv) to (a, b, sha): SHA-256 of each node's conv ids, ascending.

    SHA-256 reads its text in order, so a node's ids end in one task; they come there as joined pieces and are read in a stream.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, length = None, 0, [], 0
        for batch in batches:
            rows: list[tuple] = []
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (a, b) or length > PIECE:
                    if ids:
                        rows.append((*key, first, ",".join(ids)))
                    key, first, ids, length = (a, b), c, [], 0
                ids.append(str(c))
                length += len(ids[-1]) + 1
            if rows:
                yield piece(rows)
        if ids:
            yield piece([(*key, first, ",".join(ids))])

    def piece(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string()])], names=["a", "b", "first", "ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (a, b):
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if rows:
                yield whole(rows)
        if key is not None:
            yield whole([(*key, state.hexdigest())])

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64()] * 2 + [pa.string()])], names=["a", "b", "sha"])

    pieces = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(join, "a bigint, b bigint, first bigint, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(read, "a bigint, b bigint, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows (conv_id, turn, role, text): null roles and texts are empty; a null conv_id is no conversation; a null turn comes first;
    rows of one turn go by the hash of role and text, and repeated rows are repeated turns.  A conversation without
    turns of its own left and without a base ends at the root.  Texts and conversations may be of any length.  An empty table
    gives an empty result (no root either); other columns are ignored.
    """
    turns, convs = rebuilt(conversations)
    turns = settle(turns, "rebuilt_turns")
    path = paths(turns)
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    steps = path.select("conv", F.posexplode("sizes").alias("i", "size"), "q", "ids")
    here, up = F.get("ids", F.col("i") + 1), F.get("ids", F.col("i"))
    steps = steps.select("conv", (F.col("q") * CHUNK + F.col("i") + 1).alias("depth"), here["a"].alias("a"), here["b"].alias("b"), up["a"].alias("pa"), up["b"].alias("pb"), "size")
    nodes = steps.groupBy("a", "b").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "size")])
    # one row, null in all but the count where there is no conversation
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    nodes = settle(nodes.union(top.select(zero, zero, "conv", "n_convs", zero, none, none, zero)), "nodes")
    kids = nodes.where("pa IS NOT NULL").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children")
    saved = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.join(kids, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").drop("ka", "kb").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes.withColumns({"own_leaves": (F.col("n_children") == 0).cast("bigint"), "own_saved": saved}), "nodes")
    last = F.element_at("ids", -1)
    ends = path.where(F.col("q") * CHUNK + F.size("sizes") == F.col("length")).select(last["a"].alias("a"), last["b"].alias("b"), "conv")
    ends = ends.union(convs.where("length = 0").select(zero, zero, "conv"))
    below = totals(nodes, path).select(F.col("a").alias("ta"), F.col("b").alias("tb"), "leaves", "saved") if root["n"] else None
    if below is None:
        return conversations.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    ended = digests(ends).select(F.col("a").alias("ea"), F.col("b").alias("eb"), "sha")
    over = nodes.where("n_children > 0 AND depth > 0").select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("conv").alias("over"))
    full = nodes.join(below, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left").join(ended, (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    full = full.select("conv", "depth", "pa", "pb", "n_convs", "n_children", (F.col("own_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"), (F.col("own_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "sha")
    # the root's children know their parent without a join, so a root with very many doesn't make one
    full = full.join(over, (F.col("depth") > 1) & (F.col("pa") == F.col("oa")) & (F.col("pb") == F.col("ob")), "left")
    parent = F.when(F.col("depth") == 1, F.lit(root["conv"])).otherwise(F.col("over"))
    return full.select(
        F.col("conv").alias("conv_id"), "depth", parent.cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"

SQL = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS p FROM t),
cv AS (SELECT c, {_CRC} % {HEADS} AS h, c - c % {SHARED} AS base FROM (SELECT DISTINCT c FROM t)),
q AS (SELECT cv.c, 0 AS half, p, role, text FROM cv JOIN o ON o.c = cv.base AND p < h UNION ALL SELECT cv.c, 1, p, role, text FROM cv JOIN o ON o.c = cv.c AND p >= h),
s AS MATERIALIZED (SELECT cv.c, coalesce(list({{'r': role, 't': text}} ORDER BY half, p) FILTER (p IS NOT NULL), []) AS seq FROM cv LEFT JOIN q ON q.c = cv.c GROUP BY cv.c),
m AS MATERIALIZED (SELECT c, d, seq[1:d] AS pre, len(seq) = d AS ends, CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS b FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM m GROUP BY pre, d),
k AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.pre[1:n.d] = n.pre) AS n_children FROM n),
u AS (SELECT pre[1:j] AS pre, j AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(k.e) AS ends_sha256
FROM k JOIN u ON u.d = k.d AND u.pre = k.pre LEFT JOIN k p ON p.d = k.d - 1 AND p.pre = k.pre[1:k.d - 1]"""
