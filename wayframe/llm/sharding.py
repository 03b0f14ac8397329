"""Sharding by fixed virtual slots.

Records are hashed into a fixed, large number of virtual slots; bytes and rows are summed per slot; a
versioned map says which shard holds a slot.  The map is built so that shards have nearly equal bytes
(largest slots first, each to the lightest shard) and edited, not rebuilt, when a shard is added: only
slots that move into the new shard change.  The map is a small table in the shared folder, one version
per folder.

A slot that weighs too much for balance (repeated rows may hash alike) is split into parts by row
number, and its parts are mapped one by one.  The driver sees slots and parts, never rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm.common import fresh_dir, settle

SLOTS, PARTS, SHARDS = 8192, 64, 16
#: A slot is split if it holds more than a shard's share divided by this.
FINE = 8

Unit = tuple[int, int, int, int]  # slot, part, bytes, rows


def balance(units: list[Unit], shards: int) -> dict[tuple[int, int], int]:
    """(slot, part) -> shard, bytes nearly equal."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for slot, part, size, _ in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        held, s = heapq.heappop(load)
        out[slot, part] = s
        heapq.heappush(load, (held + size, s))
    return out


def grow(units: list[Unit], mapped: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """The map with one more shard: heavier shards give slots to it, as long as that evens them out; nothing else moves."""
    shards = max(mapped.values(), default=-1) + 1
    size = {(u[0], u[1]): u[2] for u in units}
    load = [0] * shards
    owned: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for k, s in mapped.items():
        load[s] += size.get(k, 0)
        owned[s].append(k)
    share = sum(load) / (shards + 1)
    out, new = dict(mapped), 0
    for s in range(shards):
        for k in sorted(owned[s], key=lambda k: (-size.get(k, 0), k)):
            n = size.get(k, 0)
            if load[s] - n >= share - n / 2 and new + n <= share + n / 2:
                out[k] = shards
                load[s] -= n
                new += n
    return out


def store_map(spark: SparkSession, mapped: dict[tuple[int, int], int], units: list[Unit], version: int, root: str) -> DataFrame:
    """Write one version of the map, with each unit's first place in its shard, and read it back."""
    rows, place = [], {}
    count = {(u[0], u[1]): u[3] for u in units}
    for k in sorted(mapped):
        s = mapped[k]
        rows.append((k[0], k[1], s, place.get(s, 0), version))
        place[s] = place.get(s, 0) + count.get(k, 0)
    path = f"{root}/version={version}"
    schema = "m_slot int, m_part int, shard int, first bigint, map_version int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per row of documents: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard.

    The law is ``bytes``.  Null texts weigh 1 byte.  Null doc_ids and repeated rows are rows like others, placed by
    doc_id and text together.  Also virtual_slot, map_version, and rebalanced_shard: where the row goes when
    the map is edited for one more shard.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("h"))
    d = settle(d.withColumn("virtual_slot", F.expr(f"CAST(pmod(h, {slots}) AS INT)")), "records")
    # A row's number in its file is the same whenever the written rows are read.
    d = d.withColumn("_salt", F.expr(f"CAST(pmod(_metadata.row_index, {PARTS}) AS INT)"))
    parts = d.groupBy("virtual_slot", "_salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    per_slot = parts.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    limit = sum(r["bytes"] for r in per_slot) / (shards * FINE)
    hot = sorted(r["virtual_slot"] for r in per_slot if r["bytes"] > limit and r["rows"] > 1)
    units: list[Unit] = [(r["virtual_slot"], 0, r["bytes"], r["rows"]) for r in per_slot if r["virtual_slot"] not in set(hot)]
    if hot:
        units += [(r["virtual_slot"], r["_salt"], r["bytes"], r["rows"]) for r in parts.where(F.col("virtual_slot").isin(hot)).collect()]
    root = fresh_dir(spark, "slot_map")
    now = balance(units, shards)
    first = store_map(spark, now, units, 1, root)
    then = store_map(spark, grow(units, now), units, 2, root).select(F.col("m_slot").alias("g_slot"), F.col("m_part").alias("g_part"), F.col("shard").alias("rebalanced_shard"))
    d = d.withColumn("part", F.when(F.col("virtual_slot").isin(hot), F.col("_salt")).otherwise(F.lit(0))) if hot else d.withColumn("part", F.lit(0))
    j = d.join(first, (F.col("virtual_slot") == F.col("m_slot")) & (F.col("part") == F.col("m_part"))).join(then, (F.col("virtual_slot") == F.col("g_slot")) & (F.col("part") == F.col("g_part")))
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "h", "size", "text_crc32")
    return j.withColumn("slot", F.col("first") + F.row_number().over(order) - 1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "rebalanced_shard"
    )
