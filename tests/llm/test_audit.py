"""The audit against a count by hand, and its tries against dictionaries."""

import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderlake.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé字", max_size=9), max_size=40))
def test_trie(texts):
    trie, want = audit.Trie(), {}
    for i, t in enumerate(texts):
        trie.put(t.encode(), i)
        want.setdefault(t.encode(), []).append(i)
    assert {t: rows for t, rows in trie.terminals()} == want and trie.count == len(texts)
    assert trie.bytes <= sum(map(len, want))


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        first = least.get(t)
        e = first is not None and (i is None or i > first)
        own = {c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), e), strict=True) if x}
        fails.append((i, s or "", own))
    out = {}
    for part in {s for _, s, _ in fails}:
        here = [(i, own) for i, s, own in fails if s == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                out[part, "".join(order), k] = [f, len(left), len(gone), sum(f in x[1] for x in here) - len(gone), sum(x[1] == {f} for x in here), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key, x in out.items():
            if key[0] == part:
                x.append(removed[x[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def rows_made():
    rnd = random.Random(7)
    many = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randint(0, n)) for _ in range(230))
    texts = [many(500) for _ in range(25)] + [many(5) for _ in range(5)] + [many(300).upper() for _ in range(3)] + [many(300) + " # & |" for _ in range(3)] + ["", "short", " \n", "é字 short", LONG, LONG + "x", LONG[:-1]]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "b", "", None, "é"])) for i in range(240)]
    rows += [(i, None, "a") for i in range(300, 310)] + [(None, texts[0], "a"), (None, "only without id", "b"), (None, "only without id", "b"), (7, "twice", "b"), (7, "twice", "b"), (7, "twice", None), (9, "twice", "c")]
    return rows, [(i, i % 3 % 2, i % 5 // 4) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = rows_made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("part", "mask", "n", "bucket", "good", "_id")})
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("y"))


def run(docs, labels):
    got = audit.interactions(docs, labels, audit.text_filters(F.col("text"))).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def test_against_brute_force(made):
    rows, labels, docs, said = made
    want = brute(rows, labels)
    assert run(docs, said) == want
    assert run(docs.repartition(7), said) == want


def test_small_tries_and_heavy_prefixes(made, monkeypatch):
    """Tries that are emptied after a few rows, ranges that no prefix parts: the result is the same."""
    rows, labels, docs, said = made
    monkeypatch.setattr(audit, "TRIE_ROWS", 3)
    monkeypatch.setattr(audit, "LOOK", 2)
    cuts, salts, buckets = audit.prefix_ranges(docs.select(F.coalesce("text", F.lit("")).alias("text")), 4)
    assert max(salts) > 1 and cuts == sorted(cuts) and sum(salts) == buckets
    assert run(docs.repartition(3), said) == brute(rows, labels)


def test_empty(made):
    _, _, docs, said = made
    assert run(docs.limit(0), said) == {}
    assert all(x[4:6] == (0, 0) for x in run(docs, said.limit(0)).values())


def test_without_duplicates(made):
    _, _, docs, said = made
    got = audit.interactions(docs, said, {"A": F.length("text") > 5, "B": F.lit(None).cast("boolean")}, duplicates=None)
    assert {r.filter_order for r in got.collect()} == {"AB", "BA"} and got.where("filter_order = 'BA' AND step = 1").agg(F.sum("removed")).first()[0] == 0
