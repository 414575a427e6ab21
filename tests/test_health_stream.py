"""Health by timers against the batch rules at every midnight."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderlake.operators import landing
from tenderlake.sources.storage import new_folder
from tenderlake.streaming import jobs

START = datetime(2026, 6, 1)
SOURCES = [("a", "official_api", "*", True, "green"), ("b", "platform", "*", True, "silent"), ("c", "long_tail", "*", True, "green"), ("d", "signals", None, True, "green"), ("e", "platform", "*", False, "green"), ("f", "other", "*", True, "green")]


def test_health_at_every_midnight(spark):
    rnd = random.Random(2)
    rows = []
    for name, *_ in SOURCES:
        day = START + timedelta(days=rnd.randint(0, 3))
        for k in range(40):
            at = day + timedelta(days=k)
            quiet = name in "abf" and 15 <= k < 24
            rows += [(name, at + timedelta(minutes=rnd.randint(0, 1440))) for _ in range(rnd.randint(0, 1) if quiet else rnd.randint(3, 9)) if not (name in "ac" and 28 <= k < 33)]
    rows.append(("a", START + timedelta(days=5)))  # midnight itself
    rows.append(("c", START + timedelta(days=60)))
    rows.sort(key=lambda r: r[1])
    path, target = new_folder(spark, "rows"), new_folder(spark, "health")
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        rnd.shuffle(part)
        spark.createDataFrame(part, "source string, fetched_at timestamp").coalesce(1).write.mode("append").parquet(path)
    sources = spark.createDataFrame(SOURCES, "source string, tier string, schedule string, enabled boolean, health string")
    out = jobs.health_stream(jobs.read_stream(spark, path), sources).writeStream.format("parquet").option("path", target).option("checkpointLocation", new_folder(spark, "offsets"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.at, r.source, r.health, r.verdict) for r in spark.read.parquet(target).collect())
    # The batch rules at every midnight in one frame: a source is judged from its first row on.
    ticks = spark.createDataFrame([(START + timedelta(days=d),) for d in range(1, 60)], "now timestamp")
    stored = spark.createDataFrame(rows, "source string, fetched_at timestamp")
    at = F.col("fetched_at")
    back = lambda n: F.col("now") - F.expr(f"interval {n} days")
    per = stored.join(ticks, at <= F.col("now")).groupBy("now", "source").agg(F.count_if(at > back(7)).alias("last"), F.count_if((at > back(14)) & (at <= back(7))).alias("previous"), F.max("fetched_at").alias("last_success_at"))
    judged = landing.health(sources, per, F.col("now")).select("now", "source", "health", "verdict").filter("now is not null").collect()
    want, health = [], {s[0]: s[4] for s in SOURCES}
    for r in sorted(judged, key=lambda r: (r.now, r.source)):
        if r.verdict != health[r.source]:
            if r.verdict != "green":
                want.append((r.now, r.source, health[r.source], r.verdict))
            health[r.source] = r.verdict
    assert got == want and {r[3] for r in want} == {"silent", "degraded"}
