"""Formats learned from labelled credentials, on values that they haven't seen."""

import random
import string

import pytest

from tenderlake.llm import secrets
from tenderlake.llm.common import table

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


def made(rnd, prefix, alphabet, n):
    return prefix + "".join(rnd.choice(alphabet) for _ in range(n))


def words(rnd, n):
    return ["".join(rnd.choice(["ver", "ung", "keit", "schaft", "lich", "en", "heit"]) for _ in range(rnd.randint(5, 9)))[:40] for _ in range(n)]


@pytest.fixture(scope="module")
def formats():
    rnd = random.Random(1)
    labelled = {
        "hex": [made(rnd, "", "0123456789abcdef", 40) for _ in range(200)], "access": [made(rnd, "AKIA", UPPER + DIGITS, 16) for _ in range(200)],
        "assign": [made(rnd, "ghp_", UPPER + LOWER + DIGITS, 36) for _ in range(200)],
    }
    return secrets.Formats(labelled, words(rnd, 400))


def test_held_out_values(formats):
    """Recall of each format and precision among words."""
    rnd = random.Random(2)
    for prefix, alphabet, n in (("", "0123456789abcdef", 40), ("AKIA", UPPER + DIGITS, 16), ("ghp_", UPPER + LOWER + DIGITS, 36)):
        assert sum(formats.likely(made(rnd, prefix, alphabet, n)) for _ in range(300)) >= 290
    assert sum(map(formats.likely, words(rnd, 1000))) <= 2


def test_literal_places_tell_formats_apart(formats):
    """A value without the prefix of its format isn't one; a single other character is forgiven."""
    rnd = random.Random(3)
    keys = [made(rnd, "", UPPER + DIGITS, 16) for _ in range(200)]
    assert sum(formats.likely("QXZW" + k) for k in keys) <= 4
    assert sum(formats.likely("ASIA" + k) for k in keys) >= 190
    access, _ = formats.kinds["access"]
    assert all(access.score("AKIA" + k) > access.score("QXZW" + k) + 1 for k in keys)
    assert sum(formats.likely("zzz_" + made(rnd, "", UPPER + LOWER + DIGITS, 36)) for _ in keys) <= 20


def test_automaton_is_a_distribution():
    """Over all short values the probabilities add up to at most one, and nearly that much for what was sampled."""
    import itertools
    import math

    rnd = random.Random(4)
    a = secrets.Automaton([made(rnd, "x", "ab", rnd.randint(1, 3)) for _ in range(400)], smooth=1e-6)
    total = sum(math.exp(a.score("".join(v)) * (len(v) + 1)) for n in range(6) for v in itertools.product("abcdefx", repeat=n))
    assert 0.9 < total <= 1.0 + 1e-6


def test_on_documents(spark, sf_dir):
    """Labelled values of the documents that training left out are found by their format alone; other tokens are left."""
    docs = table(spark, sf_dir, "documents")
    formats = secrets.training_sample(docs)
    found = {k: [] for k in formats.kinds}
    others = []
    for (text,) in docs.select("text").collect():
        base = secrets.base_spans(text or "")
        for a, k, b in base:
            found[k].append(text[a:b])
        others += [text[a:b] for a, b in secrets.candidates(text or "") if not any(x < b and a < y for x, _, y in base)]
    held = [v for vs in found.values() for v in secrets._part(sorted(set(vs)))[1] if len(v) >= secrets.LEAST]
    assert sum(map(formats.likely, held)) >= 0.9 * len(held)
    assert sum(map(formats.likely, set(others))) <= 0.02 * len(set(others)) + 1


def test_long_values_train_nothing_and_are_scanned_whole(spark):
    blob = "token = " + "A1b2" * 5000
    rows = [(i, blob + str(i)) for i in range(3)] + [(9, None), (9, None), (None, "AKIA" + "Z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secrets.training_sample(docs)
    assert not formats.kinds
    got = {r.doc_id: r.spans for r in secrets.scan(docs, formats).collect()}
    assert got[0] == f"assign:8:{8 + 20_001}" and got[9] == "" and got[None] == "access:0:5004"


def test_query_gives_whole_matches(spark, tmp_path):
    """The contract's patterns, run as they stand: leftmost matches, those whose group is too short dropped, spans of the matches."""
    import hashlib
    import re

    patterns = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    )
    rnd = random.Random(5)
    pieces = ["password", "passwd", "Token", "api_key", "APIKEY", "ſecret", "secret", "=", ": ", "  ", '"', "'", "AKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef", "x/y+z-", "é", "𝔘", "\n", "12345", "a_long_token_of_words"]
    texts = [None, "", 'é my token : "Abcdef0123456789"'] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in secrets.op5_secret_scans(spark, str(tmp_path)).collect()}
    assert rows[2].spans.split(",")[0] == "assign:5:30"
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(patterns) for m in re.finditer(p, t or "", re.ASCII) if len(m[g]) >= least)
        spans = [f"{patterns[k][0]}:{a}:{b}" for a, k, b in want]
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert rows[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert [x for x in rows[i].spans.split(",") if x and not x.startswith("grammar")] == spans
