"""Sharding by extendible hashing.

Every document hashes to 60 bits of md5(doc_id).  The directory is indexed by
leading bits; a bucket whose documents exceed the byte limit splits on one more
bit, and only such buckets do.  The split of every bucket follows from the byte
sums of the prefixes: a document's shard is its shortest prefix whose sum is
within the limit.  The sums come from one pre-aggregated pass; prefixes deeper
than the first directory are only worked out for the documents in buckets that
are still too large.

DataFrame operations only.  Null text has no bytes; null doc_id hashes as the
empty string.  Rows of one doc_id share a hash and stay together; a bucket that
holds one hash value only cannot split and is the only kind that may exceed the
limit, marked by ``oversized``.  Texts are only measured and do not travel, of
whatever length.  An empty table gives an empty result.  Of the columns only doc_id
and the text are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalweave.llm.store import materialize

HASH_BITS = 60
#: Bits that each round adds to the directory.
ROUND_BITS = 12


def hash60(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def assign_shards(docs: DataFrame, max_bytes: int = 1 << 20, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (bits, '' for the whole), depth, shard_bytes, oversized."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"), hash60(F.col("doc_id")).alias("hash"))
    rest, done, low = materialize(rows, "sharding"), [], 0
    while True:
        high = min(low + ROUND_BITS, HASH_BITS)
        # Byte sums of the cells of the deepest directory of this round, then of each of their prefixes.
        cells = rest.groupBy(F.shiftright("hash", HASH_BITS - high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        cells = materialize(cells, "cells")
        levels = cells.select("cell", "bytes", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, cast({high} - depth as int))")
        sums = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = sums.where((F.col("bytes") <= max_bytes) | (F.col("lo") == F.col("hi")))
        chosen = levels.select("cell", "depth", prefix.alias("prefix")).join(fits, ["depth", "prefix"])
        directory = materialize(chosen.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "bytes"), "depth").alias("b")), "directory")
        keyed = rest.withColumn("cell", F.shiftright("hash", HASH_BITS - high))
        done.append(keyed.join(directory, "cell").select("doc_id", "n_bytes", "hash", "b.depth", "b.prefix", F.col("b.bytes").alias("shard_bytes")))
        if high == HASH_BITS:
            break
        left = materialize(keyed.join(directory, "cell", "left_anti").drop("cell"), "oversized")
        if left.isEmpty():
            break
        rest, low = left, high + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > max_bytes).alias("oversized"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Writes the documents as Parquet, one folder ``shard=...`` a shard, and returns (doc_id, shard).

    A column of the documents that is called shard is written as ``own_shard``.
    Documents without an id are one bucket.
    """
    shards = materialize(assign_shards(docs, max_bytes).select("doc_id", "shard").distinct(), "shards")
    taken = [c for c in docs.columns if c.lower() == "shard"]
    renamed = docs.withColumnsRenamed({c: f"own_{c}" for c in taken})
    joined = renamed.join(shards.withColumnRenamed("doc_id", "_shard_of"), F.col("doc_id").eqNullSafe(F.col("_shard_of"))).drop("_shard_of")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
    return shards


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
p AS (
  SELECT doc_id, n_bytes, hash, depth, (hash >> (60 - depth)::INT) AS prefix
  FROM d, range(0, 61) t(depth)),
s AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, min(hash) = max(hash) AS single
  FROM p GROUP BY ALL),
c AS (
  SELECT p.doc_id, p.n_bytes, min_by({{'depth': p.depth, 'prefix': p.prefix, 'bytes': s.shard_bytes}}, p.depth) AS b
  FROM p JOIN s USING (depth, prefix)
  WHERE s.shard_bytes <= {limit} OR s.single
  GROUP BY p.doc_id, p.n_bytes)
SELECT doc_id, n_bytes,
       CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(b.prefix), b.depth::INT, '0') END AS shard,
       b.depth::INT AS depth, b.bytes AS shard_bytes, b.bytes > {limit} AS oversized
FROM c
"""
