"""Placement batch by batch: within a batch, across batches, bridges, replays, and against clusters of all at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import dedupe, placement
from tenderlake.sources.storage import new_folder
from tenderlake.streaming import jobs

SCHEMA = "id long, notice_type string, country string, title string, buyer_name string, buyer_siren string, deadline_at timestamp, source_refs array<struct<source:string,external_id:string>>, embedding array<float>"
AT = datetime(2026, 9, 1, 12)


def row(i, *refs, title="mobilier scolaire", siren=None, at=None, kind="competition"):
    return (i, kind, "FR", title, None, siren, at, [("s", r) for r in refs], None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def state(store):
    return {r.id: r.cluster_id for r in store.members().select("id", "cluster_id").collect()}


@pytest.fixture
def store(spark):
    return placement.Store(spark, new_folder(spark, "store"))


def test_within_and_across_batches(spark, store):
    """Two new duplicates share a cluster; one two batches later joins it; the confidence is the least, what was absorbed grows."""
    store.add(frame(spark, row(1, "REF-100"), row(2, "REF-100"), row(3, "REF-300", siren="1", at=AT)), 0)
    assert state(store) == {1: 1, 2: 1, 3: 3}
    store.add(frame(spark, row(4, "REF-400")), 1)
    near = frame(spark, row(5, "REF-100"), row(6, "REF-600", siren="1", at=AT + timedelta(minutes=50), title="mobilier scolaire neuf"))
    store.add(near, 2)
    assert state(store) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 3}
    clusters = {r.cluster_id: (r.confidence, r.notices) for r in store.clusters().collect()}
    assert clusters[1] == (1.0, 3) and clusters[4] == (1.0, 1) and clusters[3][1] == 2 and 0.6 <= clusters[3][0] < 1
    absorbed = sorted((r.cluster_id, r.notice_id, r.reason) for r in store.merged_from().collect())
    assert absorbed == [(1, 2, "same_publication"), (1, 5, "same_publication"), (3, 6, "buyer_deadline_title")]


def test_bridges_and_replays(spark, store):
    """A notice that meets two clusters makes them one, the smaller id stays; a bridge of bridges too; a replay changes nothing."""
    store.add(frame(spark, row(10, "REF-A1"), row(20, "REF-B1"), row(30, "REF-C1"), row(40, "REF-D1")), 0)
    store.add(frame(spark, row(50, "REF-C1", "REF-D1")), 1)
    assert state(store) == {10: 10, 20: 20, 30: 30, 40: 30, 50: 30}
    bridge = frame(spark, row(60, "REF-D1", "REF-B1"), row(70, "REF-E1"))
    store.add(bridge, 2)
    want = {10: 10, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20, 70: 70}
    assert state(store) == want
    rows = lambda: sorted(map(repr, store.members().collect())) + sorted(map(repr, store.clusters().collect()))
    before = rows()
    store.add(bridge, 2)
    assert rows() == before
    store.add(frame(spark, row(60, "REF-A1"), row(5, "REF-A1", "REF-B1")), 3)  # 60 is placed already; 5 bridges 10 and 20
    assert state(store) == {k: 10 for k in (5, 10, 20, 30, 40, 50, 60)} | {70: 70}
    assert {r.cluster_id: r.notices for r in store.clusters().collect()} == {10: 7, 70: 1}


def test_batches_equal_all_at_once(spark, store):
    rnd = random.Random(4)
    rows = [row(i, *[f"REF-{rnd.randint(0, 70):03}" for _ in range(rnd.choice([1, 1, 2]))], kind=rnd.choice(["competition", "result"])) for i in range(120)]
    p = dedupe.prepared(frame(spark, *rows))
    want = {r.id: r.cluster_id for r in dedupe.cluster(p.select("id"), dedupe.verdicts(p, dedupe.candidate_pairs(p))).collect()}
    rnd.shuffle(rows)
    for k in range(3):
        store.add(frame(spark, *rows[40 * k : 40 * k + 40]), k)
    groups = lambda x: sorted(sorted(i for i in x if x[i] == c) for c in set(x.values()))
    assert groups(state(store)) == groups(want)


def test_stream_and_empty_batches(spark, store):
    path = new_folder(spark, "in")
    for rows in ([row(1, "REF-1")], [row(2, "REF-1")], []):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    jobs.late_duplicates(jobs.read_stream(spark, path), store, new_folder(spark, "offsets")).awaitTermination()
    store.add(frame(spark).limit(0), 9)
    assert state(store) == {1: 1, 2: 1}


def test_place_beside_stored(spark):
    stored = frame(spark, row(1, "REF-1"), row(2, "REF-2")).withColumn("cluster_id", F.col("id"))
    got = placement.place(frame(spark, row(8, "REF-8"), row(9, "REF-8"), row(11, "REF-2")), stored)
    assert {(r.id, r.cluster_id, r.reason, r.confidence) for r in got.collect()} == {(8, 8, None, 1.0), (9, 8, "same_publication", 1.0), (11, 2, "same_publication", 1.0)}


def test_long_chain(spark):
    """5,000 nodes in a chain of random order: no bound on rounds cuts it."""
    order = list(range(5000))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    out = dedupe.cluster(spark.range(5001), edges)
    assert {(r.cluster_id, r["count"]) for r in out.groupBy("cluster_id").count().collect()} == {(0, 5000), (5000, 1)}
    assert "rounds" not in dedupe.cluster.__code__.co_varnames


def test_no_name_is_defined_twice():
    """A later definition would silently replace an earlier one."""
    import ast
    from pathlib import Path

    import tenderlake

    for path in Path(tenderlake.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path


def test_classes_of_copies_against_all_pairs(spark):
    """Copies, nearby titles and deadlines and shared references, a part of them stored: clusters, best verdicts and merges are those
    of all pairs, but links are a few for each notice, not one for each two."""
    rnd = random.Random(7)
    titles = ["road works in the north quarter of town", "road works in the north quarters of town", "road works in north quarters of the town hall", "school meals", "", None]
    one = lambda i: row(i, f"REF-{rnd.randint(0, 150):03}", title=titles[0] if i % 2 else rnd.choice(titles), siren=rnd.choice(["1", "1", "2", None]), at=rnd.choice([None, AT]) if i % 9 == 0 else AT + timedelta(minutes=30 * rnd.choice([0, 0, 0, 1, 2, 3, 9])), kind=rnd.choice(["competition"] * 5 + ["result"]))
    p = dedupe.prepared(frame(spark, *[one(i) for i in range(400)]))
    old, new = p.filter("id % 3 = 0"), p.filter("id % 3 <> 0")
    every = lambda x, y, on: dedupe.verdicts(x, x.select(F.col("id").alias("a")).join(y.select(F.col("id").alias("b")), F.expr(on)), y).select("a", "b", "reason", "confidence")
    at_first = dedupe.cluster(old.select("id"), every(old, old, "a < b"))
    old = old.join(at_first, "id")
    owns, ways = [tuple(r) for r in every(new, new, "a < b").collect()], [tuple(r) for r in every(new, old.drop("cluster_id"), "true").collect()]
    of = {r.id: r.cluster_id for r in at_first.collect()}
    best, touched = {}, {}
    rank = lambda c, other, reason: (-c, other, dedupe.RULES.index(reason))
    for a, b, reason, c in [*owns, *((b, a, r, c) for a, b, r, c in owns), *ways]:
        best[a] = min(best.get(a, ((9,),)), (rank(c, b, reason), reason, c))
    for a, b, reason, c in ways:
        touched[of[b]] = min(touched.get(of[b], ((9,),)), (rank(c, a, reason), reason, c))
    edges = [((1, a), (1, b)) for a, b, *_ in owns] + [((0, of[b]), (1, a)) for a, b, *_ in ways]
    label = {n: n for n in {x for e in edges for x in e} | {(1, r.id) for r in new.select("id").collect()}}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    members, merges = placement.solved(new, old, vectors=False)
    got = {r.id: (r.cluster_id, r.reason, r.confidence) for r in members.collect()}
    assert got == {i: (label[k, i][1], *(best[i][1:] if label[k, i] != (k, i) else (None, 1.0))) for k, i in label if k}
    assert {(r.cluster_id, r.into, r.reason, r.confidence) for r in merges.collect()} == {(i, label[k, i][1], *touched[i][1:]) for k, i in label if not k and label[k, i] != (k, i)}
    inside, across, news, olds = (x.count() for x in placement.met(new, old.drop("cluster_id"), vectors=False))
    assert inside + across < len(owns + ways) / 4 and news < 4 * 267 and olds < 4 * 133
    whole = {}
    for a, b, reason, c in (tuple(r) for r in every(p, p, "a < b").collect()):
        whole[b] = min(whole.get(b, ((9,),)), (rank(c, a, reason), a, reason, c))
    assert {r.b: (r.a, r.reason, r.confidence) for r in dedupe.absorbing(p, vectors=False).collect()} == {b: v[1:] for b, v in whole.items()}
