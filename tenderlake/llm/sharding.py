"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, running, table

SHARDS = 8


def shard_by_bytes(docs: DataFrame, *, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows stand by id (null last), then by hash and size of the text. Sizes are summed up to each row from the totals of
    the partitions before it, and the line of bytes is cut at ``shards`` equal targets: a row goes where its middle byte
    falls. Shards are contiguous and differ from the target by less than one document. Slots number a shard's rows
    from 0. A null text counts as no bytes (size 1, CRC 0); repeated rows stand side by side, each with a slot of its own;
    an empty table gives no rows. grown_shard is null: this law moves rows when a shard is added.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"))
    rows = durable(running(rows, [], ["doc_id", "text_crc32", "size"], {"_start": "size"}, rank="_rank"), "shards")
    whole = rows.agg(F.sum("size")).first()[0] or 1
    middle = (2 * F.col("_start") + F.col("size")).cast("decimal(38,0)") * shards
    rows = rows.withColumn("shard", F.least(F.floor(middle / F.lit(2 * whole)), F.lit(shards - 1)).cast("int"))
    first = F.broadcast(rows.groupBy("shard").agg(F.min("_rank").alias("_first")))  # a row per shard
    rows = rows.join(first, "shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b)) AS t),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, crc_table),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS whole,
             row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS k FROM c),
s AS (SELECT *, CAST(least((2 * start + size) * 8 // (2 * whole), 7) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(k - min(k) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
