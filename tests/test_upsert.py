"""The sink of latest states: overlap, replay, failures before the swap, untouched files."""

import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderlake.sources.storage import new_folder
from tenderlake.sources.upsert import UpsertTable

SCHEMA = "source string, external_id string, title string, n int"
AT = [datetime(2026, 9, d) for d in range(1, 6)]


@pytest.fixture
def table(spark):
    return UpsertTable(spark, new_folder(spark, "upsert"), spark.createDataFrame([], SCHEMA).schema, ("source", "external_id"), buckets=8)


def put(table, spark, rows, batch):
    table.upsert(spark.createDataFrame(rows, SCHEMA), batch, F.lit(AT[batch]), F.col("n"))


def state(table):
    return {(r.source, r.external_id): (r.title, r.n, r.created_at.day, r.updated_at.day) for r in table.read().collect()}


def files(table):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(table.path).rglob("part-*.parquet")}


def test_overlap_replay_and_failure(spark, table, monkeypatch):
    assert state(table) == {} and table.manifest()["batch"] == -1
    put(table, spark, [("s", str(i), f"t{i}", 1) for i in range(40)] + [("s", "3", "later", 2), (None, None, "null", 1)], 0)
    first = state(table)
    assert len(first) == 41 and first["s", "3"] == ("later", 2, 1, 1) and first[None, None] == ("null", 1, 1, 1)
    before = files(table)
    second = [("s", "5", "new five", 0), ("s", "99", "added", 1), (None, None, "null again", 7)]
    with monkeypatch.context() as m:
        m.setattr(table, "_swap", lambda _: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(table, spark, second, 1)
    assert state(table) == first
    put(table, spark, second, 1)
    want = first | {("s", "5"): ("new five", 0, 1, 2), ("s", "99"): ("added", 1, 2, 2), (None, None): ("null again", 7, 1, 2)}
    assert state(table) == want
    put(table, spark, second, 1)  # a replay
    assert state(table) == want
    after = files(table)
    assert {k: after[k] for k in before} == before  # nothing that was written is written again
    buckets = table.manifest()["buckets"]
    assert len(set(buckets.values())) == 2 and sum(f.startswith("000000000001") for f in buckets.values()) <= 3
    assert len(table.vacuum()) == 1 and state(table) == want  # what the failed batch left
    put(table, spark, [], 2)
    assert state(table) == want and table.manifest()["batch"] == 2
