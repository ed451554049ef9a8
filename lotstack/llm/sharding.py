"""Sharding by fixed virtual slots with a versioned slot-to-shard map. DataFrame operations only.

Records are hashed by id into `SLOTS` virtual slots; the number of slots never changes. Bytes are summed by
slot (at most `SLOTS` rows), and the slot-to-shard map gives each slot, largest first, to the lightest
shard. Rebalancing edits the map alone: `grow` moves whole slots, and only into the new shard.

Defined results: a null text has no bytes and counts 1; a null id is hashed like a value of its own; repeated
rows are kept, each with a place of its own; ties between slots go to the smaller slot number, ties between
shards to the smaller shard. An empty table gives an empty result. Extra columns pass through `assign`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.llm.common import free_name, shared_dir

SLOTS = 4096


def virtual_slot(key: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, and one for the record itself."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, slot_bytes, slot_rows) of the slots that hold rows: a map-side combined sum."""
    return (
        docs.select(virtual_slot(key, slots).alias("virtual_slot"), record_size(text).alias("size"))
        .groupBy("virtual_slot")
        .agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))
    )


def build_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """The slot-to-shard map: (version, virtual_slot, shard, slot_bytes, slot_rows), largest slot to lightest shard.

    At most `SLOTS` rows meet in the one fold, whatever the table's size.
    """
    loads = F.array(*(F.lit(0).cast("long") for _ in range(shards)))
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("given"))

    def give(done: Column, slot: Column) -> Column:
        lightest = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        return F.struct(
            F.transform(done["loads"], lambda x, i: x + F.when(i == lightest, -slot["less"]).otherwise(F.lit(0))).alias("loads"),
            F.array_append(done["given"], lightest).alias("given"),
        )

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot", "slot_rows")))
    return (
        sizes.agg(ordered.alias("all_slots"))
        .select("all_slots", F.aggregate("all_slots", start, give)["given"].alias("given"))
        .select(F.inline(F.arrays_zip("all_slots", "given")))
        .select(
            F.lit(version).alias("version"),
            F.col("all_slots.virtual_slot").alias("virtual_slot"),
            F.col("given").cast("int").alias("shard"),
            (-F.col("all_slots.less")).alias("slot_bytes"),
            F.col("all_slots.slot_rows").alias("slot_rows"),
        )
    )


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map over `shards` shards, with one more: each shard hands over about its share.

    Slots move only into the new shard, numbered `shards`; the rest stays where it was.
    """
    within = Window.partitionBy("shard")
    running = F.sum("slot_bytes").over(within.orderBy("slot_bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    share = F.sum("slot_bytes").over(within) / (shards + 1)
    return slot_map.select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.when(running <= share, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        "slot_bytes",
        "slot_rows",
    )


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store one version beside the earlier ones: `path`/version=N."""
    slot_map.drop("version").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def assign(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """`docs` with `virtual_slot`, `shard` and `place`: the row's place in its shard, gapless from 0.

    A place is the number of rows in the shard's earlier slots plus the row's rank in its own slot, so no shard
    is gathered in one task. The map has at most `slots` rows, small enough to broadcast at any input size.
    Columns of these three names are replaced; all others pass through.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("virtual_slot", "shard", "place")))
    ahead = free_name("rows_before", docs)
    before = F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    mapped = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias(ahead))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key))
    return (
        docs.withColumn("virtual_slot", virtual_slot(key, slots))
        .join(F.broadcast(mapped), "virtual_slot")
        .withColumn("place", (F.col(ahead) + rank - 1).cast("long"))
        .drop(ahead)
    )


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, by the first version of a stored map."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    save_map(build_map(slot_bytes(docs), 8), path, 1)
    slot_map = load_map(spark, path, 1)
    slim = docs.select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign(slim, slot_map).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
