"""Weighted rendezvous hashing: stable keys to shards, with gapless slots inside each shard.

Every (key, shard) pair has its own hash, so a key's shard depends on the key and the shards alone; a
further shard takes keys only for itself. ``md5`` is the hash: the same everywhere and for ever.

Edge cases: a null key counts as the empty string, a null text as no bytes (size 16, checksum 0); equal
keys share a shard and take different slots; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.session import materialize

ROW_OVERHEAD = 16
#: Slots are numbered inside this many buckets per shard, so no shard meets in one task.
SLOT_BUCKETS = 512


def shard_costs(key: Column, weights: list[float]) -> Column:
    """``array<struct<cost, shard>>``: -ln(u) / weight for u in (0, 1) from the hash of key and shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def cost(s: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), s["shard"].cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
        return F.struct((-F.log(u) / s["weight"]).alias("cost"), s["shard"].alias("shard"))

    return F.transform(shards, cost)


def rendezvous_shards(rows: DataFrame, key: Column, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """Add ``shard``, the cheapest of the shards, and ``grown_shard``, the same with one more shard."""
    text_key = F.coalesce(key.cast("string"), F.lit(""))
    costs = rows.withColumn("_costs", shard_costs(text_key, [*weights, grown_weight]))
    return costs.withColumn("shard", F.array_min(F.slice("_costs", 1, len(weights)))["shard"]).withColumn("grown_shard", F.array_min("_costs")["shard"]).drop("_costs")


def gapless_slots(rows: DataFrame, key: str, order: list[str], slot: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows of each ``key`` from 0 without a gap.

    Rows are numbered inside hash buckets of ``order``; the buckets' counts, at most ``buckets`` per key,
    give each bucket its offset. ``rows`` is read twice, so hand in a written table.
    """
    placed = rows.withColumn("_bucket", F.pmod(F.hash(*order), F.lit(buckets)))
    counts = placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_pos", F.row_number().over(W.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    return numbered.join(offsets, [key, "_bucket"]).withColumn(slot, F.col("_pos") + F.col("_offset")).drop("_bucket", "_pos", "_offset")


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards by key, and where they go with a 41st."""
    body = F.coalesce("text", F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    sharded = materialize(rendezvous_shards(light, F.col("doc_id"), [1.0] * 40), "shards")
    return gapless_slots(sharded, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
