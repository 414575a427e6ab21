"""The vector index against exact search, and the join of close pairs against all pairs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.operators import dedupe, search, vectors

AT = datetime(2026, 9, 1)


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors in 40 directions, a fifth of them one and the same; rows without a direction."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 24))
    x = heads[rng.integers(0, 40, 2000)] + 0.25 * rng.normal(size=(2000, 24))
    x[::5] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0] * 5), (3004, [float("nan")] * 24), (3005, [1.0] * 23 + [None])]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def test_index(clustered):
    index = vectors.VectorIndex(clustered, 24)
    assert index.rows.count() == 2000
    queries = clustered.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    probes = index.probes_for(queries, 10)
    got = {(r.query, r.id): r.score for r in index.search(queries, 10, probes).collect()}
    asked = queries.filter("vector is not null and size(vector) = 24")
    every = index.search(queries, 10, len(index.centres)).collect()
    exact = {(r.query, r.id): r.score for r in search.nearest(clustered.filter("id < 2000"), asked.filter("query < 2000"), 10).collect()}
    assert {(r.query, r.id): round(r.score, 4) for r in every} == {k: round(v, 4) for k, v in exact.items()}
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    compared = index.compared(queries, probes).agg(F.avg("compared")).first()[0]
    assert probes < len(index.centres) / 4 and compared < 2000 / 2  # a fifth is one vector


def test_index_of_nothing(clustered):
    index = vectors.VectorIndex(clustered.limit(0), 24)
    assert index.search(clustered.select(F.col("id").alias("query"), F.col("embedding").alias("vector")).limit(3), 5, 4).count() == 0


def test_close_pairs(spark, monkeypatch):
    """Equal links as all pairs: copies may be linked through the first of them, other pairs are all there."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(12, 8))
    x = heads[rng.integers(0, 12, 400)] + 0.2 * rng.normal(size=(400, 8))
    x[:120] = x[0]
    at = [AT + timedelta(minutes=int(m)) for m in rng.integers(0, 6 * 24 * 60, 400)]
    key = rng.integers(0, 2, 400)
    rows = [(int(i), int(key[i]), at[i], [float(v) for v in x[i]]) for i in rng.permutation(400)] + [(900, 0, AT, None), (901, 0, None, [1.0] * 8), (902, None, AT, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, k long, at timestamp, embedding array<double>")
    got = {(r.a, r.b) for r in vectors.close_pairs(df, 0.92, 86400, dims=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.92) & (np.abs(np.array([(a - AT).total_seconds() for a in at])[:, None] - np.array([(a - AT).total_seconds() for a in at])[None, :]) <= 86400) & (key[:, None] == key[None, :])
    every = {(i, j) for i in range(400) for j in range(i + 1, 400) if near[i, j]}
    assert got <= every and len(got) < len(every) / 2
    different = lambda p: p[0] >= 120 and p[1] >= 120
    assert {p for p in every if different(p)} == {p for p in got if different(p)}

    def parts(pairs):
        of = {i: i for i in range(400)}

        def root(i):
            while of[i] != i:
                i = of[i]
            return i

        for a, b in pairs:
            of[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(400)]

    assert parts(got) == parts(every)
    new, old = df.filter("id % 3 = 0"), df.filter("id % 3 > 0")
    across = {(r.a, r.b) for r in vectors.close_pairs(new, 0.92, 86400, dims=8, others=old).collect()}
    mixed = {(i, j) for i in range(0, 400, 3) for j in range(400) if j % 3 and near[i, j]}
    assert across <= mixed and {p for p in mixed if different(p)} == {p for p in across if different(p)}
    inside = {p for p in every if p[0] % 3 == p[1] % 3 == 0 or p[0] % 3 and p[1] % 3}
    assert parts(across | inside) == parts(every)


def test_vector_rule_of_copies(spark):
    """Notices of one vector an hour apart for three days: the chain is one cluster."""
    rows = [(i, "competition", "FR", None, None, None, AT + timedelta(hours=i), [("s", str(i))], [1.0, 2.0]) for i in range(72)]
    p = dedupe.prepared(spark.createDataFrame(rows, "id long, notice_type string, country string, title string, buyer_name string, buyer_siren string, deadline_at timestamp, source_refs array<struct<source:string,external_id:string>>, embedding array<float>"))
    pairs = dedupe.candidate_pairs(p)
    assert pairs.count() < 250
    assert {r.cluster_id for r in dedupe.cluster(p.select("id"), dedupe.verdicts(p, pairs)).collect()} == {0}


def test_exact_search_in_blocks(spark, monkeypatch):
    """Blocks of queries and of vectors against one matrix: copies, ties, other lengths, rows without a direction; no score is an
    expression over arrays, row by row."""
    monkeypatch.setattr(search, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 6)).round(1)
    x[100:180] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0]), (903, [1.0, 2.0]), (904, [1.0] * 5 + [None])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.filter("id % 5 = 0 or id > 899").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    f = np.float32(x).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    score = {(i, j): float(u[i] @ u[j]) for i in range(500) for j in range(500)} | {(902, 902): 1.0, (902, 903): 1.0, (903, 902): 1.0, (903, 903): 1.0}
    ids = [r[0] for r in rows]
    for blocks in (64, 1):
        monkeypatch.setattr(search, "VECTOR_BLOCKS", blocks)
        got = search.nearest(df, asked, 7)
        assert "aggregate(" not in got._jdf.queryExecution().toString()
        got = {(r.query, r["rank"]): (r.id, r.score) for r in got.collect()}
        for q in [i for i in ids if i % 5 == 0 or i > 899]:
            best = sorted((-np.floor(abs(s) * 1e5 + 0.5) / 1e5 * (1 if s >= 0 else -1), j) for j in ids for s in [score.get((q, j), 0.0)])[:7]
            assert [got[q, k + 1] for k in range(7)] == [(j, pytest.approx(-s, abs=1e-9)) for s, j in best], q
        near = {(r.query, r.id) for r in search.scored_vectors(df, asked, 0.5).collect()}
        assert near == {p for p, s in score.items() if s >= 0.499995 and (p[0] % 5 == 0 or p[0] > 899)}
    assert search.nearest(df.limit(0), asked, 3).count() == 0 and search.nearest(df, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("joined", [32, 1 << 14])
def test_few_blocks_move(spark, monkeypatch, joined):
    """Vectors without structure, several blocks a slot: all pairs, and blocks by size, not one for each cell."""
    monkeypatch.setattr(vectors, "JOINED", joined)
    made = []
    monkeypatch.setattr(vectors, "written", lambda df, name, kept=vectors.written: made.append((name, kept(df, name))) or made[-1][1])
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    at = [AT + timedelta(minutes=int(m)) for m in rng.integers(0, 2 * 24 * 60, 400)]
    df = spark.createDataFrame([(i, 0, at[i], [float(v) for v in x[i]]) for i in range(400)], "id long, k long, at timestamp, embedding array<float>")
    got = {(r.a, r.b) for r in vectors.close_pairs(df, 0.92, 86400, dims=3).collect()}
    f = np.float32(x).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if u[i] @ u[j] >= 0.92 and abs(at[i] - at[j]) <= timedelta(days=1)}
    slots = len({int(t.timestamp()) // 86400 for t in at})
    blocks = next(d for n, d in made if n == "blocks")
    assert blocks.count() == slots if joined > 400 else slots < blocks.count() <= 400 / joined + 2 * slots
    assert blocks.schema["held"].dataType.elementType["v"].dataType.elementType.simpleString() == "float"
