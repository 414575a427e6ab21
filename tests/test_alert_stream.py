"""Alerts by timers against a plain loop over all ticks."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderlake.operators.worklists import CLOSED, OFFSETS
from tenderlake.sources.storage import new_folder
from tenderlake.streaming import jobs

START = datetime(2026, 6, 1)
DAYS = 70


def working_days_before(at, n):
    while n:
        at -= timedelta(days=1)
        n -= at.weekday() < 5
    return at


def by_ticks(changes):
    """What a daily run gives that remembers what it sent."""
    sent, out = set(), []
    for day in range(-40, DAYS + 1):
        tick = START + timedelta(days=day)
        now = {}
        for tender, stage, deadline, at in sorted(changes, key=lambda c: c[3]):
            if at <= tick:
                now[tender] = (stage, deadline)
        for tender, (stage, deadline) in now.items():
            if stage in CLOSED or deadline is None or deadline <= tick:
                continue
            due = [n for n in OFFSETS if (tender, n) not in sent and working_days_before(deadline, n) <= tick]
            if due:
                sent.add((tender, max(due)))
                out.append((tender, max(due), tick))
    return sorted(out)


def test_timers_follow_deadlines(spark):
    rnd = random.Random(3)
    at = lambda lo, hi: START + timedelta(minutes=rnd.randint(lo * 1440, hi * 1440))
    changes = []
    for tender in range(40):
        made = at(0, 20)
        changes.append((tender, "analysis", at(10, 60), made))
        for _ in range(rnd.randint(0, 3)):
            moved = at(2, 55)
            if moved > made:
                changes.append((tender, rnd.choice(["analysis", "drafting", "drafting", "submitted"]), rnd.choice([None, at(5, 65), at(5, 65)]), moved))
    # Twice moved, first later, then nearer.
    changes += [(90, "analysis", START + timedelta(days=20), START), (90, "analysis", START + timedelta(days=45), START + timedelta(days=6)), (90, "analysis", START + timedelta(days=30), START + timedelta(days=29))]
    changes += [(99, "closed", None, START + timedelta(days=d, hours=3)) for d in range(0, DAYS + 2, 5)]  # a clock
    path, target = new_folder(spark, "changes"), new_folder(spark, "alerts")
    schema = "tender_id int, stage string, deadline_at timestamp, at timestamp"
    ordered = sorted(changes, key=lambda c: c[3])
    cuts = [0, len(ordered) // 3, 2 * len(ordered) // 3, len(ordered)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = ordered[a:b]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("org_id", F.lit(1)).coalesce(1).write.mode("append").parquet(path)
    out = jobs.alerts_stream(jobs.read_stream(spark, path)).writeStream.format("parquet").option("path", target).option("checkpointLocation", new_folder(spark, "offsets"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.tender_id, r.offset, r.at) for r in spark.read.parquet(target).collect())
    end = max(c[3] for c in changes) - timedelta(hours=1)
    assert got == [x for x in by_ticks(changes) if x[2] <= end]
    # Moved away and then near: the offsets between are due together, and one is sent a tick.
    assert [n for t, n, _ in got if t == 90] == [7, 14] and len(got) > 60


def test_a_call_serves_many_keys(spark, monkeypatch):
    """Groups of tenders and of notices, with null and odd keys: as many groups as are set, not one for each key."""
    monkeypatch.setattr(jobs, "GROUPS", 3)
    path, kept = new_folder(spark, "raw"), new_folder(spark, "versions")
    rows = [(i, f"s{i % 3}", [None, "a", 'b"', "é"][i % 4], [None, "x", "y"][i * 7 % 11 % 3], START + timedelta(minutes=i * 7 % 100)) for i in range(240)]
    df = spark.createDataFrame(rows, "event_id long, source string, external_id string, content_hash string, fetched_at timestamp")
    for k in range(2):
        df.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(path)
    out = jobs.version_stream(jobs.read_stream(spark, path, files=9)).writeStream.format("parquet").option("path", kept).option("checkpointLocation", new_folder(spark, "offsets"))
    query = out.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    want, state = set(), {}
    for i, source, external, h, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        last, version = state.get((source, external), (None, 1))
        amended = last is not None and h is not None and h != last
        state[source, external] = (h, version + amended)
        want.add((source, external, i, version + amended, amended))
    assert {tuple(r) for r in spark.read.parquet(kept).select("source", "external_id", "event_id", "version", "amended").collect()} == want


def test_states_lie_on_disk(spark, sf_dir, monkeypatch):
    """the query's states are in RocksDB, in groups of a bounded number of tenders; the session's settings stay."""
    from tenderlake.plans import records

    made, key = [], "spark.sql.streaming.stateStore.providerClass"
    kept = jobs.alerts_stream
    monkeypatch.setattr(jobs, "alerts_stream", lambda rows, **more: made.append((spark.conf.get(key), more["groups"])) or kept(rows, **more))
    monkeypatch.setattr(jobs, "GROUPS", 8)
    monkeypatch.setattr(records, "TENDERS_A_GROUP", 100)
    before = spark.conf.get(key, None)
    got = {r.kind: r.tenders for r in records.stream_deadline_alerts(spark, sf_dir).collect()}
    assert made == [("org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", 14)] and spark.conf.get(key, None) == before
    assert set(got) == {f"deadline.j{n}" for n in OFFSETS} and min(got.values()) > 500
