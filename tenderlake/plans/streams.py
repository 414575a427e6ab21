"""Streaming jobs run to the end of what is there; their results equal those of the batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..sources import tables as t
from ..sources.storage import new_folder
from ..streaming import jobs
from . import ingest, product


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of two or more files in time order."""
    path = new_folder(spark, "events")
    t.read(spark, sf_dir, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return jobs.read_stream(spark, path, files=100)


def _raw(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), content_hash(F.col("props")).alias("content_hash"), F.col("ts").cast("timestamp").alias("fetched_at"))


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_folder(spark, "landed")
    jobs.landing_stream(_raw(_events(spark, sf_dir)), target, new_folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(target).groupBy("source").agg(F.count("*").alias("stored"))


def _drained(frame: DataFrame) -> DataFrame:
    """The last state of a stream in complete mode: each batch replaces the table before, and the last one is read."""
    spark = frame.sparkSession
    root = new_folder(spark, "drained")
    last: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{n}")
        last[:] = [n]

    frame.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", new_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{root}/{last[0]}") if last else spark.createDataFrame([], frame.schema)


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, offsets = new_folder(spark, "versions"), new_folder(spark, "offsets")
    out = jobs.version_stream(_raw(_events(spark, sf_dir)))
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", offsets).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("event_id", "version", "amended")


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    usage = e.select(F.col("user_id").alias("org_id"), F.col("event_type").alias("feature"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(jobs.usage_stream(usage))


SQL = {
    "stream_landing": ingest.W_RAW + " SELECT source, count(DISTINCT (external_id, content_hash)) AS stored FROM n_raw GROUP BY source",
    "stream_versions": ingest.VERSIONS + " SELECT event_id, version, amended FROM z",
    "stream_usage": product.SQL["usage_monthly"],
}
QUERIES = {f.__name__: f for f in (stream_landing, stream_versions, stream_usage)}
