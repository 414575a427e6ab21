"""Landing, versions and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import seconds_between

#: Hours of silence that a tier may have, and rank of a tier.
BUDGET_HOURS = {"official_api": 6, "platform": 24, "long_tail": 72, "signals": 72}
TIER_RANK = {"official_api": 1, "platform": 2, "long_tail": 3, "signals": 4}
LEGAL = ("open-license", "tos-reviewed", "robots-ok")
LEAST_VOLUME, DROP = 20, 0.4
RAW_KEY = ["source", "external_id", "content_hash"]


#: Where the two feeds keep records, their ids in order of preference, and their addresses. Fixed values.
FEEDS = {
    "TED": {"records": "notices", "ids": ["publication-number"], "url": "https://ted.europa.eu/en/notice/{id}"},
    "BOAMP": {"records": "results", "ids": ["idweb", "id"], "url": "url_avis"},
}


def explode_pages(pages: DataFrame, feed: str) -> DataFrame:
    """L-01, L-02. source, external_id, url and payload of each record of a feed's landed pages.

    The id is the first of the feed's id fields that isn't null or empty; records without one are left out, never given one.
    The address is a template over the id or a field of the record (null where that is missing). Null or empty lists of
    records give no rows, repeated records one each.
    """
    of = FEEDS[feed]
    rows = pages.select(F.explode(of["records"]).alias("r"))
    held = rows.schema["r"].dataType.names
    ids = [F.nullif(F.col(f"r.`{c}`").cast("string"), F.lit("")) for c in of["ids"] if c in held] or [F.lit(None).cast("string")]
    rows = rows.select(F.lit(feed).alias("source"), F.coalesce(*ids).alias("external_id"), "r").filter("external_id is not null")
    head, _, tail = of["url"].partition("{id}")
    url = F.concat(F.lit(head), "external_id", F.lit(tail)) if "{id}" in of["url"] else F.col(f"r.`{head}`") if head in held else F.lit(None)
    return rows.select("source", "external_id", url.cast("string").alias("url"), F.to_json("r").alias("payload"))


def new_rows(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """L-04. Rows not stored yet, one for each key, the earliest fetched."""
    w = Window.partitionBy(*RAW_KEY).orderBy("fetched_at", "event_id" if "event_id" in batch.columns else "fetched_at")
    first = batch.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return first.join(existing.select(*RAW_KEY), RAW_KEY, "left_anti")


def landing_counts(batch: DataFrame) -> DataFrame:
    """Fetched and distinct rows of each source."""
    return batch.groupBy("source").agg(F.count("*").alias("fetched"), F.count_distinct("external_id", "content_hash").alias("stored"))


def cursors(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """L-05. The next pass of an enabled source starts at its latest fetch; a disabled one is skipped."""
    last = rows.groupBy("source").agg(F.max("fetched_at").alias("cursor"))
    return sources.join(last, "source", "left").select("source", F.when(F.col("enabled"), F.col("cursor")).alias("cursor"), (~F.col("enabled")).cast("int").alias("skipped_disabled"))


def volumes(rows: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """L-07, H-01. Counts of the last days and of as many before, and the latest fetch, in one pass."""
    since, before = F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86_400_000_000)), F.timestamp_micros(F.unix_micros(now) - F.lit(2 * days * 86_400_000_000))
    at = F.col("fetched_at")
    return rows.groupBy("source").agg(F.count_if(at > since).alias("last"), F.count_if((at > before) & (at <= since)).alias("previous"), F.max(at).alias("last_success_at"))


def quarantine_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L-10. Sources with a tier rank and a legal basis, and those refused."""
    rank = F.coalesce(*[F.when(F.col("tier") == t, F.lit(r)) for t, r in TIER_RANK.items()], F.lit(3))
    ranked = sources.withColumn("tier_rank", rank)
    legal = F.coalesce(F.col("legal_basis").isin(*LEGAL), F.lit(False))
    return ranked.filter(legal), ranked.filter(~legal)


def failure_facts(failures: DataFrame) -> DataFrame:
    """L-08. Event rows of failed fetches, the error cut at 1000 characters."""
    return failures.select(F.lit("source.fetch_failed").alias("kind"), F.col("source").alias("entity"), F.to_json(F.struct(F.substring("error", 1, 1000).alias("error"))).alias("payload"), "at")


def marked_degraded(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """L-08. Sources after their failed fetches: health is degraded and last_run_at the latest failure, unless a later run is
    known; the others stay as they are. Failures of unknown sources mark nothing."""
    last = failures.groupBy(F.col("source").alias("_source")).agg(F.max("at").alias("_at"))
    out = sources.join(last, sources["source"].eqNullSafe(F.col("_source")), "left")
    failed = F.col("_source").isNotNull()
    return out.withColumns({"health": F.when(failed, "degraded").otherwise(F.col("health")), "last_run_at": F.greatest("last_run_at", "_at")}).drop("_source", "_at")


def incremental_window(rows: DataFrame, cursor: Column, now: Column, *, countries: list[str] | None = None, lookback_days: int = 2, at: str = "published_at", places: str = "places") -> DataFrame:
    """L-06. Rows published since the cursor's day, by default two days back, in one of the countries. The bound is a day and
    reaches the scan."""
    since = F.coalesce(cursor, F.timestamp_micros(F.unix_micros(now) - F.lit(lookback_days * 86_400_000_000)))
    out = rows.filter(F.col(at) >= F.least(F.date_trunc("day", since), F.date_trunc("day", now)))
    return out.filter(F.arrays_overlap(places, F.array(*map(F.lit, countries)))) if countries else out


def write_replay(notices: DataFrame, path: str) -> None:
    """L-11. Canonical notices as JSON lines, one corpus over many files."""
    notices.write.json(path)


def read_replay(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """L-11. A corpus read back by the schema of its notices; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def seeded(notices: DataFrame) -> DataFrame:
    """L-15. Notices with buyer_siren: the siren, else the first nine digits of the siret."""
    return notices.withColumn("buyer_siren", F.coalesce("buyer.siren", F.substring("buyer.siret", 1, 9)))


def gold_pairs(gold: DataFrame, files: DataFrame) -> DataFrame:
    """L-12. Gold rows (path, ...) with the document row (path, ...) of the same stem. No gold at all, or gold without a
    document, is an error, never a pass."""
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"(\.gold)?\.[^.]+$", "")
    left = gold.withColumn("stem", stem("path")).drop("path")
    right = files.withColumn("stem", stem("path")).drop("path")
    if left.isEmpty():
        raise ValueError("no gold files")
    alone = left.join(right.select("stem"), "stem", "left_anti").select("stem").limit(5)
    if missing := [r.stem for r in alone.collect()]:
        raise ValueError(f"gold files without a document: {missing}")
    return left.join(right, "stem")


def append_once(rows: DataFrame, path: str, key: list[str]) -> None:
    """L-16. Append notification, event or digest rows under a deterministic row_id of their key; a replay adds nothing."""
    spark = rows.sparkSession
    fresh = rows.withColumn("row_id", F.sha2(F.to_json(F.struct(*key)), 256)).dropDuplicates(["row_id"])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        fresh = fresh.join(spark.read.parquet(path).select("row_id"), "row_id", "left_anti")
    fresh.write.mode("append").parquet(path)


def amendments(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """N-34. version, previous_hash and amended of every row: a version starts where the hash differs from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    previous = F.lag("content_hash").over(w)
    out = rows.withColumn("previous_hash", previous)
    changed = F.col("previous_hash").isNotNull() & F.col("content_hash").isNotNull() & (F.col("previous_hash") != F.col("content_hash"))
    out = out.withColumn("amended", F.coalesce(changed, F.lit(False)))
    return out.withColumn("version", (F.sum(F.col("amended").cast("int")).over(w) + 1).cast("int"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """L-14. The last state of each key, with the first sight as created_at."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    out = rows.withColumn("created_at", F.min(order[0]).over(Window.partitionBy(*key)))
    return out.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def drift(rows: DataFrame, known: list[str], payload: str = "payload") -> DataFrame:
    """N-22. How often each source sends keys that the mapping doesn't know."""
    keys = F.explode(F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in known]).cast("array<string>")))
    return rows.select("source", keys.alias("key")).groupBy("source", "key").agg(F.count("*").alias("n"))


def health(sources: DataFrame, volume: DataFrame, now: Column) -> DataFrame:
    """H-02, H-03. verdict, reason and should_page of each source."""
    budget = F.coalesce(*[F.when(F.col("tier") == t, F.lit(h)) for t, h in BUDGET_HOURS.items()], F.lit(24))
    rows = sources.join(volume, "source", "left").withColumn("silent_hours", seconds_between(now, F.col("last_success_at")) / 3600)
    prev, last = F.coalesce("previous", F.lit(0)), F.coalesce("last", F.lit(0))
    cases = [
        (~F.col("enabled"), "green", "disabled"),
        (F.col("schedule").isNull(), "green", "not polled"),
        (F.col("last_success_at").isNull(), "silent", "never ran"),
        (F.col("silent_hours") > budget, "silent", "over budget"),
        ((prev >= LEAST_VOLUME) & ((prev - last) / prev > DROP), "degraded", "volume drop"),
    ]
    verdict, reason = F.lit("green"), F.lit("ok")
    for cond, v, r in reversed(cases):
        verdict, reason = F.when(cond, v).otherwise(verdict), F.when(cond, r).otherwise(reason)
    out = rows.withColumns({"verdict": verdict, "reason": reason})
    return out.withColumn("should_page", (F.col("verdict") == "silent") & F.col("tier").isin("official_api", "platform"))


def transitions(verdicts: DataFrame) -> DataFrame:
    """H-04. Events where the verdict is bad and differs from the stored health."""
    return verdicts.filter((F.col("verdict") != F.col("health")) & F.col("verdict").isin("silent", "degraded"))


def health_summary(verdicts: DataFrame) -> DataFrame:
    """H-05."""
    return verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("green", "degraded", "silent")], F.array_sort(F.collect_list(F.when(F.col("should_page"), F.col("source")))).alias("paging"))


def coverage(sources: DataFrame, volume: DataFrame, now: Column) -> DataFrame:
    """Q-08. Hours since success and whether within the tier's budget (null if never), with the tier's rank."""
    budget = F.coalesce(*[F.when(F.col("tier") == t, F.lit(h)) for t, h in BUDGET_HOURS.items()], F.lit(24))
    rank = F.coalesce(*[F.when(F.col("tier") == t, F.lit(r)) for t, r in TIER_RANK.items()], F.lit(3))
    hours = F.round(seconds_between(now, F.col("last_success_at")) / 3600, 1)
    return sources.join(volume, "source", "left").select("source", rank.alias("tier_rank"), hours.alias("hours"), (hours <= budget).alias("within_budget"), "enabled")
