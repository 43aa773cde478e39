"""Sharding by fixed virtual slots. DataFrame functions only.

Records hash into thousands of slots once and for ever; a small versioned map says which shard holds each slot.
Only that map is edited when shards are added or loads drift, so a move concerns whole slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlake.llm.common import rows_of, scratch_path, stage_table

SLOTS = 4096
#: A slot's rows are numbered in so many parts, so that one slot never is one task's sort.
PARTS = 16
SLACK = 0.02


def record_slot(*keys: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record by its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def with_slots(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """records (doc_id, size, text_crc32, row) with virtual_slot, which follows from doc_id, checksum and size, so that records without an
    id, or with one id, go to many slots. Records that have all three in common, and together more bytes than a mean slot, are
    dealt over the slots by row: nothing but their number tells them apart. There are `slots` such keys at most, which bounds the broadcast."""
    keys = ["doc_id", "text_crc32", "size"]
    total = records.agg(F.sum("size").alias("total"))
    heavy = records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").crossJoin(F.broadcast(total)).where(F.col("n") * F.col("size") * slots > F.col("total"))
    heavy = heavy.select(*(F.col(x).alias(f"heavy_{x}") for x in keys), F.lit(True).alias("heavy"))
    same = F.col("doc_id").eqNullSafe(F.col("heavy_doc_id")) & (F.col("text_crc32") == F.col("heavy_text_crc32")) & (F.col("size") == F.col("heavy_size"))
    salt = F.when(F.col("heavy"), F.col("row") % slots).otherwise(0)
    dealt = records.join(F.broadcast(heavy), same, "left")
    return dealt.select(*keys, record_slot(*map(F.col, keys), salt, slots=slots).alias("virtual_slot"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def edit_map(slot_bytes: DataFrame, shards: int, old: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """(virtual_slot, bytes, shard) for every slot of slot_bytes (virtual_slot, bytes).

    Slots are taken largest first. One stays where `old` (virtual_slot, shard) had it while that shard exists and
    its load stays below (1 + slack) times the mean; otherwise it goes to the lightest shard. Without `old` that is
    largest-first assignment, whose shards differ by one slot at most. The fold runs over one array of as many
    entries as there are slots, a fixed number. An empty table gives an empty map.
    """
    before = slot_bytes.join(F.broadcast(old.select("virtual_slot", F.col("shard").alias("was"))), "virtual_slot", "left") if old is not None else slot_bytes.withColumn("was", F.lit(None).cast("int"))
    one = before.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", F.coalesce("was", F.lit(-1)).alias("was")))).alias("all"),
        (F.sum("bytes") / shards * (1 + slack)).alias("most"),
    )
    lightest = "cast(array_position(state.loads, array_min(state.loads)) - 1 as int)"
    stays = f"x.was between 0 and {shards - 1} and element_at(state.loads, least(greatest(x.was, 0), {shards - 1}) + 1) - x.less <= most"
    folded = one.select(
        "all",
        F.expr(
            f"""aggregate(all, named_struct('loads', array_repeat(0L, {shards}), 'picks', cast(array() as array<int>)), (state, x) ->
            aggregate(array(if({stays}, x.was, {lightest})), state, (s, pick) -> named_struct(
                'loads', transform(s.loads, (load, i) -> if(i = pick, load - x.less, load)), 'picks', array_append(s.picks, pick)))).picks"""
        ).alias("picks"),
    )
    return folded.select(F.explode(F.arrays_zip("all", "picks")).alias("z")).select(
        F.col("z.all.virtual_slot").alias("virtual_slot"), (-F.col("z.all.less")).alias("bytes"), F.col("z.picks").alias("shard")
    )


def store_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of the map. An existing version is never overwritten: writing it again fails."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records (virtual_slot, text_crc32, doc_id, size) with shard and `slot`, the place in the shard, gapless from 0.

    Places follow virtual slot, then part, then doc_id, size and checksum. Equal rows get different places, in any
    order. The offsets table has SLOTS * PARTS rows at most, which bounds the broadcast.
    """
    records = records.withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        records.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
        .join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
        .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n")
    )
    here = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        records.withColumn("nth", F.row_number().over(here))
        .join(F.broadcast(offsets), ["virtual_slot", "part"])
        .withColumn("slot", F.col("ahead") + F.col("nth") - 1)
        .drop("part", "nth", "ahead")
    )


def shard_documents(docs: DataFrame, shards: int, map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: shards of near equal bytes.

    Version 1 of the slot map is stored below map_path (by default in the session's shared folder). A null text has
    size 1 and the checksum of the empty text; texts of any length count whole; empty tables give empty results; repeated rows and
    rows with one id or none are placed one by one, in many slots. Columns but doc_id and text stay behind.
    """
    spark = docs.sparkSession
    rows = rows_of(docs, doc_id=F.col("doc_id"), size=text_bytes(F.col("text")), text_crc32=F.crc32(F.coalesce("text", F.lit(""))), row=F.monotonically_increasing_id())
    records = stage_table(with_slots(stage_table(rows, "shard-rows"), slots), "shard-records")
    path = map_path or scratch_path(spark, "slot-map")
    store_map(edit_map(records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")), shards), path, 1)
    return place(records, read_map(spark, path, 1))


def rebalance(records: DataFrame, map_path: str, version: int, shards: int) -> DataFrame:
    """Store version + 1 of the map for the present sizes and `shards` shards; returns that version."""
    spark = records.sparkSession
    sizes = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    store_map(edit_map(sizes, shards, read_map(spark, map_path, version)), map_path, version + 1)
    return read_map(spark, map_path, version + 1)
