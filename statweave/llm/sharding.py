"""Sharding by longest-processing-time scheduling of groups that must stay together."""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statweave.llm.shared import cut, table


def least_loaded(sizes: list[tuple[int, str]], shards: int) -> list[tuple[str, int]]:
    """(key, shard) of items (size, key): the largest first, each to the shard with the least so far (ties: the smaller number)."""
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out.append((key, k))
    return out


def shard_documents(docs: DataFrame, shards: int = 16, share: int = 65_536, bundles: int = 16_384, buckets: int = 4_096) -> DataFrame:
    """Documents dealt to shards of near equal bytes; rows with equal texts (null: empty) stay together.

    A group of at least 1/share of all bytes is an item of the schedule, so there are at most `share` such items; all others stay together in `bundles`
    by a hash of their text. The driver sorts and deals these items, a bounded number, and broadcasts what they got. Slots count rows within (shard, bucket of
    doc_id) behind the counts of the buckets before. Repeated rows and null doc_id are rows like others; no rows give no rows.
    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = cut(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                           F.unhex(F.sha2(text, 256)).alias("digest")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("string"))
    large = cut(slim.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("item", F.when(F.col("bytes") * share >= total, F.hex("digest")).otherwise(bundle)))
    items = large.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()          # at most share + bundles rows
    dealt = spark.createDataFrame(least_loaded([(r.bytes, r.item) for r in items], shards), "item string, shard int")
    named = dealt.withColumn("digest", F.when(~F.col("item").startswith("b"), F.unhex("item")))
    alone = named.filter(F.col("digest").isNotNull()).select("digest", F.col("shard").alias("own"))
    together = named.filter(F.col("digest").isNull()).select("item", F.col("shard").alias("shared"))
    placed = (slim.join(F.broadcast(alone), "digest", "left").withColumn("item", bundle).join(F.broadcast(together), "item", "left")
              .select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))              # at most shards x buckets rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("k", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("k") - 1).alias("slot")))


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
