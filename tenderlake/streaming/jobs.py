"""Streaming twins of landing, versions and usage. Each takes a streaming or static frame of raw rows."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dates import working_days_before
from ..operators.landing import BUDGET_HOURS, DROP, LEAST_VOLUME, RAW_KEY
from ..operators.placement import Store
from ..operators.worklists import CLOSED, OFFSETS
from ..shipping import ship

VERSION_SCHEMA = "source string, external_id string, event_id long, version int, amended boolean"


#: Sources that a batch may name for the stored rows to be pruned to them.
PRUNED_SOURCES = 1000


def landing_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """S-01. Append rows that aren't stored yet; the checkpoint is the cursor, and re-read rows are anti-joined away.

    The target is partitioned by source: a batch reads the keys of its own sources only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(RAW_KEY)
        named = [r.source for r in batch.select("source").distinct().limit(PRUNED_SOURCES + 1).collect()]
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = spark.read.schema(batch.schema).parquet(target)
            stored = stored.filter(F.col("source").isin(named)) if len(named) <= PRUNED_SOURCES else stored
            fresh = fresh.join(stored.select(*RAW_KEY), RAW_KEY, "left_anti")
        fresh.write.mode("append").partitionBy("source").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Groups that keys of a stream with a small state each are dealt to by hash: a group's keys are worked on and kept together, so that a
#: batch costs a call for each group, not for each key. The number is part of a running stream's state.
GROUPS = 1024


def _grouped(rows: DataFrame, *keys: str, groups: int | None = None) -> DataFrame:
    return rows.withColumns({"_key": F.to_json(F.struct(*keys)), "_group": F.pmod(F.xxhash64(*keys), F.lit(groups or GROUPS))})


#: States of streams in RocksDB within a share of memory, in place of all of them in the heap.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def states_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their states by ``ON_DISK``."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def version_stream(rows: DataFrame) -> DataFrame:
    """S-02. A version of every row; the state of a notice is its last hash and version, some 100 bytes. A notice may be
    amended at any time, so its state has no timeout and grows with the notices; keep it in RocksDB. A batch writes anew the
    states of the groups that it touches."""
    ship(rows.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        frame = pd.concat(list(frames)).sort_values(["fetched_at", "event_id"])
        versions, changes = [], []
        for k, now in zip(frame["_key"], frame["content_hash"], strict=True):
            last, version = held.get(k, (None, 1))
            amended = last is not None and now is not None and now != last
            version += amended
            held[k] = (now, version)
            versions.append(version)
            changes.append(amended)
        state.update((json.dumps(held),))
        yield frame[["source", "external_id", "event_id"]].assign(version=pd.Series(versions, frame.index, "int32"), amended=pd.Series(changes, frame.index, "bool"))

    return _grouped(rows, "source", "external_id").groupBy("_group").applyInPandasWithState(step, VERSION_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def usage_stream(rows: DataFrame) -> DataFrame:
    """S-08. Running monthly totals; write it in update or complete mode."""
    return rows.groupBy("org_id", F.date_format("at", "yyyy-MM").alias("month"), "feature").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def volume_stream(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """S-05. Seven-day volumes of each source, sliding by a day."""
    return rows.withWatermark("fetched_at", lateness).groupBy(F.window("fetched_at", "7 days", "1 day"), "source").agg(F.count("*").alias("n"))


DAY_MS = 86_400_000


def health_stream(rows: DataFrame, sources: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """S-05, H-04. Changes of a source's health to silent or degraded, as ``landing.health`` and ``transitions`` give them at every
    midnight: (source, at, health, verdict), from rows (source, fetched_at) and the sources (source, tier, schedule, enabled,
    health), which start with their stored health.

    Each source has one event-time timer, at the next midnight, so that silence is seen without a row. The state is its last
    verdict and a count for each of the last fourteen days, which compares a week with the one before. A midnight is judged
    once the watermark has passed it. A source is known from its first row on.
    """
    ship(rows.sparkSession)
    budget = F.coalesce(*[F.when(F.col("tier") == t, F.lit(h)) for t, h in BUDGET_HOURS.items()], F.lit(24))
    known = sources.select(F.col("source").alias("_s"), budget.alias("budget"), (F.col("enabled") & F.col("schedule").isNotNull()).alias("watched"), "health")
    timed = rows.filter("fetched_at is not null").withWatermark("fetched_at", lateness)
    timed = timed.join(known, F.col("source") == F.col("_s")).select("source", "budget", "watched", "health", F.unix_micros("fetched_at").alias("us"), "fetched_at")

    def verdict(now: dict, tick: int) -> str:
        days = {int(d): v for d, v in now["days"].items() if int(d) <= tick}
        week = sum(n for d, (n, _) in days.items() if d > tick - 7)
        before = sum(n for d, (n, _) in days.items() if tick - 14 < d <= tick - 7)
        last = max([now["last"], *[us for _, us in days.values()]])
        if not now["watched"]:
            return "green"
        if tick * DAY_MS * 1000 - last > now["budget"] * 3_600_000_000:
            return "silent"
        return "degraded" if before >= LEAST_VOLUME and (before - week) / before > DROP else "green"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        for frame in frames:
            day = -(-frame["us"] // (DAY_MS * 1000))  # a day ends at its midnight, which belongs to it
            if now is None:
                head = frame.iloc[0]
                now = {"budget": int(head["budget"]), "watched": bool(head["watched"]), "health": head["health"], "tick": int(day.min()) - 1, "last": 0, "days": {}}
            for d, n, us in frame.assign(day=day).groupby("day")["us"].agg(["count", "max"]).itertuples():
                n0, us0 = now["days"].get(str(d), (0, 0))
                now["days"][str(d)] = (n0 + int(n), max(us0, int(us)))
        out, seen = [], state.getCurrentWatermarkMs() // DAY_MS
        while now["tick"] < seen:
            now["tick"] += 1
            judged = verdict(now, now["tick"])
            if judged != now["health"]:
                if judged != "green":
                    out.append((key[0], now["tick"] * DAY_MS, now["health"], judged))
                now["health"] = judged
            for d in [d for d in now["days"] if int(d) <= now["tick"] - 14]:
                now["last"] = max(now["last"], now["days"].pop(d)[1])
        state.update((json.dumps(now),))
        state.setTimeoutTimestamp((now["tick"] + 1) * DAY_MS)
        if out:
            source, at, health, judged = zip(*out, strict=True)
            yield pd.DataFrame({"source": source, "at": pd.to_datetime(at, unit="ms"), "health": health, "verdict": judged})

    return timed.groupBy("source").applyInPandasWithState(step, "source string, at timestamp, health string, verdict string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def messages_once(rows: DataFrame, lateness: str = "1 day") -> DataFrame:
    """S-07. Each message id once within the watermark."""
    return rows.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["message_id"])


def late_duplicates(rows: DataFrame, store: Store, checkpoint: str, *, vectors: bool = True) -> StreamingQuery:
    """S-03. Each batch of new notices is placed among itself and among all that earlier batches placed, and stored under the
    batch's number: a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        store.add(batch, number, vectors=vectors)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts_stream(changes: DataFrame, *, every: str = "1 day", lateness: str = "1 hour", groups: int | None = None) -> DataFrame:
    """S-06. The alerts that ``worklists.due_alerts`` gives when it is run at every full ``every`` since the epoch, each alert
    once: (org_id, tender_id, offset, kind, at), from changes of tenders (org_id, tender_id, stage, deadline_at, at).

    Each tender has the next tick where an offset is due, and each of ``groups`` (GROUPS) groups of tenders one event-time timer, at the first
    of these; a change of its deadline or stage sets it anew. Changes wait in the state until the watermark has passed them, so that they may come in any order within
    ``lateness``. A tick fires once the watermark has passed it. Of a tender the last change, the offsets sent and the
    waiting changes are kept, some hundred bytes, packed by group: a task holds one group unpacked, so take a group for some thousand
    tenders. A null deadline has no alerts; changes without a time are left out.
    """
    ship(changes.sparkSession)
    step_ms = int(pd.Timedelta(every).total_seconds() * 1000)
    millis = lambda x: F.ceil(F.unix_micros(x) / 1000)
    due = F.array(*[millis(working_days_before(F.col("deadline_at"), F.lit(n))) for n in OFFSETS])
    rows = changes.filter("at is not null").withWatermark("at", lateness).select(
        "org_id", "tender_id", F.col("stage").isin(*CLOSED).alias("closed"), millis("deadline_at").alias("deadline"), F.when(F.col("deadline_at").isNotNull(), due).alias("due"), F.unix_millis("at").alias("ms"), "at"
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fire(now: dict, until: int, out: list) -> int | None:
        """Alerts of the ticks after now["tick"] up to ``until``; the next tick that has one, if nothing changes."""
        tick = (now["tick"] // step_ms + 1) * step_ms
        while not now["closed"] and now["due"] is not None:
            ahead = [(at, n) for n, at in zip(OFFSETS, now["due"], strict=True) if n not in now["sent"]]
            if not ahead:
                return None
            tick = max(tick, -(-min(ahead)[0] // step_ms) * step_ms)
            if now["deadline"] <= tick:
                return None
            if tick > until:
                return tick
            offset = max(n for at, n in ahead if at <= tick)
            now["sent"].append(offset)
            out.append((tick, offset))
            tick += step_ms
        return None

    def settle(now: dict, seen: int, out: list) -> None:
        """Changes and ticks up to ``seen``; when the tender has to be looked at next."""
        now["waiting"].sort(key=lambda x: x[0])
        while now["waiting"] and now["waiting"][0][0] <= seen:
            ms, closed, deadline, due = now["waiting"].pop(0)
            fire(now, ms - 1, out)
            now |= {"tick": max(now["tick"], ms - 1), "closed": closed, "deadline": deadline, "due": due}
        following = fire(now, seen, out)
        now["tick"] = max(now["tick"], seen)
        timers = [t for t in (following, now["waiting"][0][0] if now["waiting"] else None) if t is not None]
        now["next"] = min(timers) if timers else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        changed = set()
        for frame in frames:
            for k, closed, deadline, due, ms in zip(*[frame[c] for c in ("_key", "closed", "deadline", "due", "ms")], strict=True):
                known = due is not None and len(due) > 0
                now = held.setdefault(k, {"tick": -1, "closed": True, "deadline": 0, "due": None, "sent": [], "waiting": [], "next": None})
                now["waiting"].append([int(ms), bool(closed), int(deadline) if known else 0, [int(x) for x in due] if known else None])
                changed.add(k)
        seen, keys, alerts = state.getCurrentWatermarkMs(), [], []
        for k, now in held.items():
            if k in changed or (now["next"] is not None and now["next"] <= seen):
                out: list = []
                settle(now, seen, out)
                keys += [k] * len(out)
                alerts += out
        timers = [now["next"] for now in held.values() if now["next"] is not None]
        state.update((zlib.compress(json.dumps(held, separators=(",", ":")).encode(), 1),))
        if timers:
            state.setTimeoutTimestamp(max(min(timers), seen + 1))
        if alerts:
            yield pd.DataFrame({"_key": keys, "offset": pd.Series([n for _, n in alerts], dtype="int32"), "kind": [f"deadline.j{n}" for _, n in alerts], "at": pd.to_datetime([t for t, _ in alerts], unit="ms")})

    found = _grouped(rows, "org_id", "tender_id", groups=groups).groupBy("_group").applyInPandasWithState(step, "_key string, offset int, kind string, at timestamp", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    tender = F.from_json("_key", ", ".join(f"{c} {kinds[c]}" for c in ("org_id", "tender_id")))
    return found.select(tender.alias("_t"), "offset", "kind", "at").select("_t.org_id", "_t.tender_id", "offset", "kind", "at")


def read_stream(spark: SparkSession, path: str, *, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
