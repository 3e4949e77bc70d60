"""Sharding over fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.session import cut_lineage, ensure_checkpoint_dir, table

SLOTS = 4096
OVERHEAD = 16  # bytes of a record besides its text
PORTION = 256  # equal rows that share a virtual slot


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, part, copies, virtual_slot)``: equal rows of ``docs`` (by doc_id and text) in portions of
    up to PORTION, with the number of rows of each.

    Rows are counted before they are dealt, and each portion is hashed by doc_id, text and its own number, so that neither a
    repeated id nor a repeated row fills one slot. A null text has no bytes and the crc32 of none.
    """
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    parts = equal.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PORTION).cast("int"))))
    copies = F.least(F.lit(PORTION), F.col("n") - F.col("part") * PORTION).cast("long")
    return parts.select("doc_id", "size", "text_crc32", "part", copies.alias("copies"), F.pmod(F.xxhash64("key", "part"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; ``slots`` numbers, however many rows there are."""
    sums = {r["virtual_slot"]: r["size"] for r in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()}
    return [sums.get(s, 0) for s in range(slots)]


def rebalance_map(current: list[int], sizes: list[int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The map edited so that every shard is within ``tolerance`` of the mean, moving slots only from the fullest shard
    to the emptiest, until no such move brings them nearer. Slots of shards that are gone are placed first."""
    out, held = list(current), [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            held[shard] += sizes[slot]
    for slot in sorted((s for s, shard in enumerate(out) if shard >= shards), key=lambda s: (-sizes[s], s)):
        out[slot] = min(range(shards), key=lambda x: (held[x], x))
        held[out[slot]] += sizes[slot]
    mean = sum(sizes) / shards
    slots_of: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        slots_of[shard].add(slot)
    for _ in range(len(sizes) * 4):
        full, empty = max(range(shards), key=lambda x: (held[x], -x)), min(range(shards), key=lambda x: (held[x], x))
        gap = held[full] - held[empty]
        movable = [s for s in slots_of[full] if 0 < sizes[s] < gap]
        if gap <= tolerance * mean or not movable:
            break
        slot = min(movable, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        slots_of[full].remove(slot)
        slots_of[empty].add(slot)
        out[slot], held[full], held[empty] = empty, held[full] - sizes[slot], held[empty] + sizes[slot]
    return out


def save_map(spark: SparkSession, slot_map: list[int], path: str, version: int) -> None:
    """Store a version of the map; older versions stay readable."""
    listed = F.split(F.lit(",".join(map(str, slot_map))), ",")
    rows = spark.range(len(slot_map)).select(F.col("id").cast("int").alias("virtual_slot"), F.element_at(listed, (F.col("id") + 1).cast("int")).cast("int").alias("shard"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("map_version", F.lit(version))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give every row its shard by the map and its place in it, ``slot``, from 0 without gaps.

    Places are counted within (shard, virtual slot) and carried on over the counts of the virtual slots, so that no task
    gets a whole shard. Within a virtual slot rows go by doc_id (null first), crc32, size and portion; a portion takes as many
    places as it has rows. The map has a fixed number of rows and is broadcast.
    """
    dealt = rows.join(F.broadcast(slot_map), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "virtual_slot").agg(F.sum("copies").alias("n")).select("virtual_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("inner", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(F.broadcast(starts), "virtual_slot")
    each = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("slot", (F.col("start") + F.col("inner") + F.col("copy")).cast("long")).drop("start", "inner", "part", "copies", "copy")


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, size, text_crc32, virtual_slot, shard, slot, map_version)``.

    Records are hashed to ``slots`` virtual slots by doc_id and text, equal ones in portions. Version 1 of the slot-to-shard map deals the slots in turn; the bytes of
    each slot then decide which of them move, so that the shards' sizes are near equal, and the edited map is version 2.
    Both are stored under ``path``; rows are placed by version 2 as it is read back. Null texts count as empty, repeated
    rows are rows of their own, an empty table gives no rows; columns but doc_id and text are not read. Equal texts may go
    to different shards: a text that a third of all rows share could not stay together with sizes near equal.
    """
    spark = docs.sparkSession
    rows = cut_lineage(slotted(docs, slots))
    path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"
    first = [slot % shards for slot in range(slots)]
    save_map(spark, first, path, 1)
    save_map(spark, rebalance_map(first, slot_bytes(rows, slots), shards, tolerance=0.0), path, 2)
    return place(rows, load_map(spark, path, 2))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shard_documents`` of all rows of ``documents`` under the law ``bytes``."""
    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
