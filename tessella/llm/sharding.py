"""Stable shards by jump consistent hashing. SQL functions only.

A key is hashed to 64 bits (the first half of the MD5 of its decimal text), which seed the linear
congruential generator of Lamping and Veach (2014). ``shard`` depends on the key and the number of shards
alone; with one more shard a row keeps its place or goes to the new shard.

Defined results: a null text has size 1 and CRC 0; a null key counts as the text "null"; repeated rows each
get a slot of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The multiplier of the published jump hash, in two halves of 32 bits.
JUMP_MULTIPLIER = 2862933555777941757
_HI, _LO = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & 0xFFFFFFFF
#: Slots are dealt in this many parts of each shard, so that no task holds a whole shard.
SLOT_PARTS = 1024


def key_hash(key: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a key's hash, as longs."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"))


def jump_shard(hi: Column, lo: Column, shards: int) -> Column:
    """The jump hash of a 64-bit key in two halves. At most ``shards`` steps, as each jumps ahead."""
    mask16, mask32 = F.lit(0xFFFF), F.lit(0xFFFFFFFF)

    def step(s: Column, _: Column) -> Column:
        h, low = s["hi"], s["lo"]
        # 64-bit product modulo 2**64 in limbs that never overflow a long
        p0 = low.bitwiseAND(mask16) * F.lit(_LO) + F.lit(1)
        p1 = F.shiftright(low, 16) * F.lit(_LO) + F.shiftright(p0, 16)
        new_lo = F.shiftleft(p1.bitwiseAND(mask16), 16) + p0.bitwiseAND(mask16)
        part = h.bitwiseAND(mask16) * F.lit(_LO) + F.shiftleft((F.shiftright(h, 16) * F.lit(_LO)).bitwiseAND(mask16), 16)
        new_hi = (F.shiftright(p1, 16) + (low * F.lit(_HI)).bitwiseAND(mask32) + part.bitwiseAND(mask32)).bitwiseAND(mask32)
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("long")
        done = s["j"] >= F.lit(shards)
        return F.struct(
            F.when(done, s["b"]).otherwise(s["j"]).alias("b"), F.when(done, s["j"]).otherwise(jump).alias("j"),
            F.when(done, h).otherwise(new_hi).alias("hi"), F.when(done, low).otherwise(new_lo).alias("lo"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slot_parts: int = SLOT_PARTS) -> DataFrame:
    """One row a document: its shard of ``shards``, its slot there (gapless from 0) and its shard of one more."""
    hi, lo = key_hash(F.col(key))
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        hi.alias("hi"), lo.alias("lo"),
    )
    placed = base.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), jump_shard(F.col("hi"), F.col("lo"), shards).alias("shard"),
        jump_shard(F.col("hi"), F.col("lo"), shards + 1).alias("grown_shard"), (F.col("lo") % slot_parts).cast("int").alias("part"),
    )
    # shards * slot_parts counts at most, so the broadcast has a fixed bound
    sizes = placed.groupBy("shard", "part").count()
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(own))
    return ranked.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
