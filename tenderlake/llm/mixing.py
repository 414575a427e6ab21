"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, running, table, words_of

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """From rows (source, size): source_size and target of each source.

    Sources by code point (null last) weigh ``weights``, repeating, and share ``share_percent`` of all sizes. A target
    stops at ``most`` times its source's size; what is above is shared anew by weight until none is above. Each round
    tests all sources against one level in exact integers; only the sums come to the driver.
    """
    per = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(per, [], ["source"], {}, rank="_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = durable(ranked.withColumn("weight", weight.cast("long")).drop("_rank"), "sources")
    whole = per.agg(F.sum("source_size")).first()[0] or 0
    top = F.lit(0)  # the level is top / below, for one unit of weight
    below, capped, n_capped = 1, F.lit(False), -1
    while True:
        cap_sum, weight_sum, n = per.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == n_capped or not weight_sum:
            break
        n_capped = n
        top, below = share_percent * whole - 100 * most * (cap_sum or 0), 100 * weight_sum
        wide = "decimal(38,0)"
        capped = capped | (F.lit(top).cast(wide) * F.col("weight") > (F.lit(most * below).cast(wide) * F.col("source_size")).cast(wide))
    level = (F.lit(top).cast("long") * F.col("weight")).cast("double") / F.lit(float(below))
    cap = (most * F.col("source_size")).cast("double")
    return per.select("source", "source_size", F.when(capped, cap).otherwise(F.least(level, cap)).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, **rules) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over its size. Within a source the documents stand by size (then
    id, then hash of the text), the expected copies are summed up to each, one random offset of the source is added, and a
    document is taken once for each whole number the sum crosses. Standing by size keeps the words taken near the target.
    Null texts have size 0; a null source is a source of its own; an empty table gives an empty one. The result depends
    on the rows and the seed alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.substring(F.md5(t), 1, 16).alias("_tie"))
    rows = durable(rows, "sizes")  # words are counted once, not again to sample the ranges
    rows = durable(running(rows, ["source"], ["size", "doc_id", "_tie"], {}, rank="_rank"), "mix")
    targets = source_targets(rows.select("source", "size"), **rules).withColumnRenamed("source", "_source")
    out = rows.join(targets, rows["source"].eqNullSafe(targets["_source"]))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("_u", offset).withColumn("_r", rate)
    crossed = F.floor(F.col("_u") + F.col("_r") * (F.col("_rank") + 1)) - F.floor(F.col("_u") + F.col("_r") * F.col("_rank"))
    most = rules.get("most", MOST_COPIES)
    out = out.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source", "_tie")


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "_tie")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  substr(md5(coalesce(text, '')), 1, 16) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
c AS (SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size * 1.0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top,
             100 * sum(weight) OVER (ORDER BY source_size * 1.0 / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below,
             row_number() OVER (ORDER BY source_size * 1.0 / weight, source) AS k FROM w),
f AS (SELECT top, below, k FROM c WHERE top * weight <= 2 * source_size * below ORDER BY k LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN c.k < f.k THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(f.top * weight AS DOUBLE) / CAST(f.below AS DOUBLE) END AS target FROM c, f),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST, tie) - 1 AS k,
             CAST(CAST('0x' || substr(md5('mix-1' || coalesce(d.source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u,
             CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(least(floor(u + rate * CAST(k + 1 AS DOUBLE)) - floor(u + rate * CAST(k AS DOUBLE)), 2) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM q
"""
