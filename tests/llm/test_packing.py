"""Ids against the tokenizers library, pieces and places against the contract, bins against the least number by enumeration."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderlake.llm import packing

TOKENIZER = Tokenizer.from_file(packing.default_path())
PARTS = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　ab'sZ\xe9字9\xbd_.!<|>́​", "\U0001d11e", "<|endoftext|>", "'ll"]
SPACED = st.lists(st.sampled_from(PARTS), max_size=50).map("".join)
LONG = "\n\n".join(f"  word{i} é{i % 97} 字" for i in range(9_000))
ROWS = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, LONG), (6, LONG + " more"), (None, "no id"), (7, "again"), (7, "again"), (8, "a<|endoftext|>  <|endoftext|> b"), (9, "x" * 30_000)]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=600, deadline=None)
@given(SPACED)
def test_ids(text):
    bpe = packing.vocabulary(open(packing.default_path()).read())
    assert bpe.encode(text).tolist() == ids_of(text)[:-1]


def least(items, capacity):
    """The least number of bins, by trying every bin for each item."""
    items = sorted(items, reverse=True)

    @lru_cache(None)
    def go(k, rooms):
        if k == len(items):
            return len(rooms)
        best = go(k + 1, tuple(sorted((*rooms, capacity - items[k]))))
        for i, r in enumerate(rooms):
            if r >= items[k] and (not i or rooms[i - 1] != r):
                best = min(best, go(k + 1, tuple(sorted((*rooms[:i], r - items[k], *rooms[i + 1 :])))))
        return best

    return go(0, ())


def held(counts, bins, capacity):
    out = np.zeros_like(counts)
    for filling, n in bins:
        assert n > 0 and sum(filling) <= capacity
        for size in filling:
            out[size] += n
    assert (out == counts).all()
    return sum(n for _, n in bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_least_number_of_bins(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
    want = least(items, capacity) if items else 0
    assert packing.least_bins(counts, capacity) <= want
    assert held(counts, packing.completed(counts, capacity), capacity) == want


def test_better_than_best_fit():
    """Best fit takes a bin more than are needed; the completion of bins finds the least number."""
    items = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    counts = np.bincount(items, minlength=61).astype(np.int64)
    assert held(counts, packing.best_fit(counts, 60), 60) == 4 and held(counts, packing.completed(counts, 60), 60) == 3


@pytest.mark.parametrize("times", [1, 100_000])
def test_many_items(times):
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 20_000), 1, 2048).astype(int), minlength=2049).astype(np.int64) * times
    counts[700] += 9_000 * times  # a length of nearly a third of all
    bins = packing.completed(counts, 2048, nodes=50)
    assert held(counts, bins, 2048) <= packing.least_bins(counts, 2048) * 1.001 + 1
    assert len(bins) <= 3 * 2048


@pytest.fixture(scope="module")
def docs(spark):
    more = [(i, f"text {i} of some words " * (i * 37 % 301)) for i in range(100, 400)]
    return spark.createDataFrame(ROWS + more, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "ids", "length", "_at", "count", "_text")})


def test_packed(docs):
    texts = docs.select("doc_id", "text").collect()
    want = []
    for r in texts:
        ids = ids_of(r.text)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = packing.pack(packing.pieces(docs.repartition(5), with_ids=True))
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    per: dict = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    whole = sum(x[3] for x in want)
    assert -(-whole // 2048) <= len(per) <= -(-whole // 2048) + 1
    sequences = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for k, parts in per.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1].tolist()] and sum(p[1] for p in parts) <= 2048
        assert sequences[k] == [x for p in parts for x in p[2]]


def test_empty_and_small(docs, spark):
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0
    tiny = spark.createDataFrame([(i, None) for i in range(5000)], "doc_id long, text string")
    got = packing.pack(packing.pieces(tiny))
    assert got.select("sequence_id").distinct().count() == 3 and got.select("sequence_id", "offset").distinct().count() == 5000


def test_another_capacity(docs):
    got = packing.pack(packing.pieces(docs.where("doc_id < 9"), capacity=64, end=50256), capacity=64).collect()
    assert max(r.length for r in got) == 64 and all(r.offset + r.length <= 64 for r in got)
