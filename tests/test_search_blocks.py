"""Queries come to the rows in blocks; rows of postings don't move."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tenderlake.functions.text import trigrams
from tenderlake.operators import search

WORDS = ["pont", "route", "école", "ring", "bolt", "gear", "widget", "plate", "ville", "eau"]


@pytest.fixture
def small(monkeypatch):
    for name, n in (("ASKED_QUERIES", 2), ("ASKED_TERMS", 8), ("SUMMED", 5)):
        monkeypatch.setattr(search, name, n)


def _texts(n, most, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_fulltext_in_blocks_is_exact(spark, small):
    docs = [*_texts(40, 12, 1), *["pont ring"] * 9, "", None]
    asked = _texts(7, 5, 2)
    rows = spark.createDataFrame([(i, d, "ville", d) for i, d in enumerate(docs)], "id long, title string, buyer_name string, description string")
    got = {(r.query, r.id): (r.score, r.rank) for r in search.fulltext_lists(search.term_lists(rows), spark.createDataFrame(list(enumerate(asked)), "query int, text string"), len(docs), 4).collect()}
    held = [set((d or "").replace("é", "e").split()) for d in docs]
    df = {w: sum(w in h or w == "ville" for h in held) for w in [w.replace("é", "e") for w in WORDS]}
    want = {}
    for q, text in enumerate(asked):
        score = {i: round(sum(((1.2 if w in h else 0.0) + (0.4 if w == "ville" else 0.0)) * math.log(1 + len(docs) / df[w]) for w in set(text.replace("é", "e").split()) if w in h or w == "ville"), 6) for i, h in enumerate(held)}
        best = sorted(((-s, i) for i, s in score.items() if s > 0))[:4]
        want |= {(q, i): (-s, k) for k, (s, i) in enumerate(best, 1)}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_trigram_search_in_blocks_is_exact(spark, small):
    titles, asked = [*_texts(30, 6, 3), *["pont ring"] * 5, "", None], ["pont rings", "", "école de la ville", "eau", "gear bolt"]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, text string")
    got = sorted(tuple(r) for r in search.trigram_search(rows, queries, 3, 0.1).select("query", "rank", "id", "score").collect())
    grams = lambda df, c: {r[0]: set(r[1]) for r in df.select(df.columns[0], trigrams(F.col(c))).collect()}
    held, want = grams(rows, "title"), []
    for q, g in grams(queries, "text").items():
        score = [(-round(len(g & h) / len(g | h), 6), i) for i, h in held.items() if g & h]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(x for x in score if -x[0] >= 0.1)[:3], 1)]
    assert got == sorted(want)


def test_postings_are_not_shuffled(spark, sf_dir):
    """Of both searches only what is found goes to the window: no join or grouping of a row for each trigram or term."""
    rows = spark.createDataFrame([(1, "pont")], "id long, title string")
    queries = spark.createDataFrame([(1, "pont")], "query int, text string")
    plan = search.trigram_search(rows, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan
