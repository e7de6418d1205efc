"""Extendible hashing: shards by prefixes of a hash, split on another bit only where they are too large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Bytes of text that a shard may hold, bits of the hash, bits by which a directory is finer than shards of equal size.
LIMIT_BYTES, BITS, SLACK_BITS = 1 << 20, 60, 6


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def extendible_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, shard, shard_bytes, shard_docs.

    A shard is a prefix of ``depth`` bits of the hash of doc_id.  It is split on the next bit while
    its texts hold over ``limit`` bytes and it holds more than one hash value, so only a shard of a
    single key can be larger than the limit.  Null texts have 0 bytes; rows without doc_id share one
    hash; rows of one doc_id stay together; an empty table gives no rows.

    Documents are summed once by a prefix finer than any likely shard; directories are worked out on
    these sums alone.  Prefixes that are still too large there are summed again, finer.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(f"`{doc_id}`")).alias("bits")
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, SLACK_BITS + max(0, math.ceil(math.log2(max(1, total) / limit))))
    placed, open_rows, floor = None, rows, 0
    while True:
        leaf = F.shiftrightunsigned("bits", BITS - depth)
        sums = written(
            open_rows.groupBy(leaf.alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        )
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(floor), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {depth} - depth)"))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).drop("low", "high")
        first = F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard")
        directory = written(levels.select("leaf", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("leaf").agg(first))
        done = open_rows.withColumn("leaf", leaf).join(directory, "leaf").select("doc_id", "n_bytes", "shard.*")
        placed = done if placed is None else placed.unionByName(done)
        rest = sums.select("leaf").join(directory, "leaf", "left_anti")
        if depth == BITS or rest.isEmpty():
            break
        open_rows = open_rows.withColumn("leaf", leaf).join(rest, "leaf", "left_semi").drop("leaf")
        floor, depth = depth + 1, min(BITS, depth + 8)
    shard = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("prefix").cast("string"))
    return placed.select("doc_id", "n_bytes", "depth", "prefix", shard.alias("shard"), "shard_bytes", "shard_docs")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS bits FROM documents
), levels AS (
  SELECT doc_id, n_bytes, bits, g AS depth, bits >> ({BITS} - g) AS prefix FROM d, range(0, {BITS + 1}) r(g)
), buckets AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT_BYTES} OR min(bits) = max(bits)
), picked AS (
  SELECT levels.doc_id, n_bytes, levels.depth, levels.prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY levels.doc_id ORDER BY levels.depth) AS k
  FROM levels JOIN buckets ON levels.depth = buckets.depth AND levels.prefix = buckets.prefix
)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, prefix::BIGINT AS prefix, depth || ':' || prefix AS shard, shard_bytes, shard_docs::BIGINT AS shard_docs FROM picked WHERE k = 1
"""
