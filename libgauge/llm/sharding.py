"""Sharding through fixed virtual slots, in DataFrame expressions only.

Records are hashed into SLOTS virtual slots.  Bytes and rows are summed per slot, and a versioned
slot-to-shard map says where each slot lives.  Version 0 deals slots out in turn; a rebalancing
appends a version that holds nothing but the slots it moves.  Only the slot table (SLOTS rows,
whatever the input) is brought to one task or broadcast.

Defined results: a null text has no bytes; a null id is hashed by its text; repeated rows share a
slot and get places of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, as_columns

SLOTS = 4096
SHARDS = 24


def records(df: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot for every row.  Id and text decide the slot, so that rows that
    share a null or repeated id don't fill one slot."""
    rows = df.select(*as_columns(id_col, text_col))
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.col("doc_id"), text)
    return rows.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: slots are dealt out in turn."""
    return spark.range(0, slots, 1, 1).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def current_map(versions: DataFrame, version: int | None = None) -> DataFrame:
    """The shard of each slot: the last edit up to a version holds."""
    held = versions if version is None else versions.filter(F.col("version") <= version)
    return held.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(versions: DataFrame, sums: DataFrame, shards: int, version: int) -> DataFrame:
    """The edits that make the shards' bytes near equal, as rows of a new version.

    Each shard keeps its largest slots up to the mean load.  The other slots are pooled and go, the
    largest first, each to the shard with the least bytes.  Slots that stay are not in the result.
    """
    loads = current_map(versions).join(sums, "virtual_slot", "left").select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    mean = loads.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    split = loads.crossJoin(F.broadcast(mean)).withColumn("kept", (F.sum("bytes").over(largest) <= F.col("mean")) & (F.col("shard") < shards))
    at_hand = split.agg(
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard")))).alias("pool"),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(0).cast("long")).alias("zero"),
        F.collect_list(F.when(F.col("kept"), F.struct("shard", "bytes"))).alias("stay"),
    )
    base = F.aggregate("stay", F.col("zero"), lambda acc, x: F.transform(acc, lambda b, i: F.when(i == x["shard"], b + x["bytes"]).otherwise(b)))

    def place(acc, x):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])) - F.lit(1)
        return F.struct(
            F.transform(acc["loads"], lambda b, i: F.when(i == to, b - x["less"]).otherwise(b)).alias("loads"),
            F.when(to == x["shard"], acc["moves"]).otherwise(F.concat(acc["moves"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), to.cast("int").alias("shard"))))).alias("moves"),
        )

    start = F.struct(base.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("moves"))
    moved = at_hand.select(F.inline(F.aggregate("pool", start, place, lambda acc: acc["moves"])))
    return moved.select(F.lit(version).alias("version"), "virtual_slot", "shard")


def assign(df: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot, map_version."""
    spark, work = df.sparkSession, Workspace(df.sparkSession, "sharding")
    rows = work.save(records(df, slots, id_col, text_col), "records")
    sums = work.save(slot_sums(rows).coalesce(1), "sums")
    zero = first_map(spark, shards, slots)
    versions = work.save(zero.unionByName(rebalance(zero, sums, shards, 1)).coalesce(1), "slot_map")
    now = current_map(versions).join(sums, "virtual_slot", "left")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = now.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"),
    )


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
