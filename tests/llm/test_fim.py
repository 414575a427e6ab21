"""Cuts against a regular expression, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderlake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "\n".join(f" mot{i} é字 {'x' * (i % 19)}\t" for i in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "  lead and trail  "), (6, "é字𝄞 \x1f\x85\xa0 x"), (7, "has <P> inside"), (8, "a <S"), (9, LONG), (None, "no id at all"), (None, None),
    (10, "twice the same row"), (10, "twice the same row"), (11, "<" * 30 + " <S <P <M"), (12, "\x00 \x00"),
]
TEXT = st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x0c\x08\x0e\x1f!aZ~\x7f\x80é  字𝄞<>PSM"), max_size=40)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=12))
def test_cuts(rows):
    raw = [t.encode() for t, _, _ in rows]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    n, p, m, pc, mc = fim.cut(np.frombuffer(b"".join(raw), np.uint8), starts, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    for i, (t, h1, h2) in enumerate(rows):
        units = UNIT.findall(t)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        prefix, middle = "".join(units[:a]), "".join(units[a:b])
        assert (n[i], pc[i], mc[i]) == (len(units), len(prefix), len(middle))
        assert (p[i] - starts[i], m[i] - p[i]) == (len(prefix.encode()), len(middle.encode()))


@pytest.fixture(scope="module")
def docs(spark):
    more = [(i, f"text {i} of some words \t and é marks\n" * (i % 7)) for i in range(100, 400)]
    return spark.createDataFrame(ROWS + more, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "h1", "h2", "form", "output", "prefix_chars")})


def test_rows(docs):
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((d, *brute(d, t), t or "") for d, t in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_groups_of_texts_and_slices(docs, monkeypatch):
    """Texts worked on one by one, in groups and in one go give the same."""
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(fim.fill_in_middle(docs.coalesce(1)))
    assert key(fim.fill_in_middle(docs.repartition(5))) == want
    monkeypatch.setattr(fim, "TOGETHER", 50)
    assert key(fim.fill_in_middle(docs.coalesce(1))) == want


def test_empty(docs):
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
