"""Sharding by jump consistent hashing, in DataFrame expressions only.

The shard of a key needs no ring table: a 64-bit linear congruential sequence seeded by the key jumps
forward over the shard numbers, and the last jump below the shard count is the shard. With one more
shard a key either stays or moves to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import blank, materialize, packed

#: Fixed value: multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757
LOW16, LOW32 = (1 << 16) - 1, (1 << 32) - 1


def key_halves(key: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a 64-bit key: the first half of the MD5 of the key as text (null: empty)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return half(1), half(9)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of key * MULTIPLIER + 1 modulo 2^64, every product below 2^49."""
    a_high, a_low = MULTIPLIER >> 32, MULTIPLIER & LOW32

    def times(x: Column, a: int) -> tuple[Column, Column]:
        """(x * a modulo 2^32, what is carried) for 32-bit x and a."""
        upper = x * F.lit(a >> 16)
        total = x * F.lit(a & LOW16) + F.shiftleft(upper.bitwiseAND(F.lit(LOW16)), 16)
        return total, F.shiftright(upper, 16)

    low_total, low_carry = times(low, a_low)
    low_total = low_total + F.lit(1)
    carry = F.shiftright(low_total, 32) + low_carry
    high_total = times(high, a_low)[0] + times(low, a_high)[0].bitwiseAND(F.lit(LOW32)) + carry
    return high_total.bitwiseAND(F.lit(LOW32)), low_total.bitwiseAND(F.lit(LOW32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key, 0 to shards - 1. Every jump gains at least one, so `shards` steps always suffice."""
    high, low = key_halves(key)
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), high.alias("h"), low.alias("l"))

    def step(s: Column, _: Column) -> Column:
        h, l_ = _next(s["h"], s["l"])
        top = F.shiftright(h, 1)  # key >> 33
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), j.alias("j"), h.alias("h"), l_.alias("l"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, law, shard, slot, grown_shard.

    Only the key and the shard count decide the shard; equal keys and repeated rows share a shard, a null
    key hashes as the empty string and a null text as the empty text. `slot` numbers the rows of a shard
    from 0 without gaps, by key (nulls first), then CRC. `grown_shard` is the shard once one more is appended.

    The narrow columns are range-partitioned once by (shard, key, CRC, random tie), so copies of one key
    spread over tasks, and written sorted with a running row id. The slot is that id less the first id of the
    (partition, shard) block plus the size of the shard's earlier blocks: a table of one row per partition
    and shard boundary. The texts are never shuffled. An empty table gives no rows.
    """
    body = blank(text)
    narrow = packed(docs, key, text).select(
        F.col(f"`{key}`"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(F.col(f"`{key}`"), shards).alias("shard"),
        jump_shard(F.col(f"`{key}`"), shards + 1).alias("grown_shard"),
        F.rand(11).alias("tie"),
    )
    order = ["shard", key, "text_crc32", "tie"]
    placed = materialize(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("row", F.monotonically_increasing_id()), "shards")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    blocks = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(blocks, ["shard", "part"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot"), "grown_shard"
    )
