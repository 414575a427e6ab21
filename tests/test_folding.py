"""Folding over all code points, citations in other spellings, and matching blocks against the standard library."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tenderlake.functions import text
from tenderlake.operators import documents

ALL = [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]


def test_all_code_points(spark):
    """Decomposition without marks, and case folding, of every code point; Hangul syllables only in the normal form."""
    rows = [(f"a{chr(k)}b",) if k < 0x300 else ("".join(map(chr, ALL[i : i + 128])),) for i, k in list(enumerate(ALL))[:0x2FF] + [(i, ALL[i]) for i in range(0x2FF, len(ALL), 128)]]
    got = spark.createDataFrame(rows, "x string").repartition(8).select("x", text.strip_accents(F.col("x")).alias("plain"), text.normalize_text(F.col("x")).alias("norm"), text.casefolded(F.col("x")).alias("cased")).collect()
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    wrong = [r.x for r in got if bare(r.plain) != bare(r.x) or not any(0xAC00 <= ord(c) < 0xD7A4 for c in r.x) and r.plain != bare(r.x)]
    assert not wrong
    assert not [r.x for r in got if r.norm != re.sub("[^a-z0-9]+", " ", bare(r.x).lower()).strip()]
    assert not [r.x for r in got if r.cased != r.x.casefold()]


def test_square_metres(spark):
    x = "500 ㎡ de bureaux, 3 ㎞, \U0001f131 ⃒a"
    assert spark.range(1).select(text.normalize_text(F.lit(x))).first()[0] == "500 m2 de bureaux 3 km b a"


def test_citations(spark):
    pages = spark.createDataFrame([(1, 1, "hauptstraße : 12\n000 €"), (1, 2, "page deux"), (1, 4, None), (2, 1, "autre")], "doc_id int, page int, text string")
    quotes = [
        ("sharp", 1, 1, "HAUPTSTRASSE : 12 000"), ("near", 1, 3, "Page  DEUX"), ("far", 1, 4, "page deux"), ("blank", 1, 1, "   "), ("empty", 1, 1, ""), ("none", 1, 1, None), ("no page", 1, None, "page"),
        ("other", 2, 1, "page deux"), ("null text", 1, 5, "x"), ("first", 1, 0, "hauptstrasse"),
    ]
    q = spark.createDataFrame(quotes, "quote_id string, doc_id int, page int, quote string")
    found = lambda n: {r.quote_id: r.valid for r in documents.check_citations(q, pages, n).collect()}
    assert found(1) == {"sharp": True, "near": True, "far": False, "blank": False, "other": False, "null text": False, "first": True}
    assert found(0) == {"sharp": True, "near": False, "far": False, "blank": False, "other": False, "null text": False, "first": False}


def test_sharp_pairs_are_met(spark):
    rows = lambda x: spark.createDataFrame([("c", 0, x)], "case string, idx int, text string")
    (r,) = documents.scored_pairs(rows("ß" * 6), rows("s" * 12)).collect()
    assert r.score == 1.0


def test_matching_blocks():
    """10,000 pairs: short and long texts, characters so frequent that they start no block, copies, empty texts."""
    rnd = random.Random(9)
    words = "supply of bolts and rings for the town maintenance road network safety é 字".split()
    pairs = []
    for i in range(10_000):
        if i % 50 == 0:  # over 200 characters
            a = "".join(rnd.choice("ab cde" + chr(300 + i % 40)) for _ in range(rnd.randint(150, 320)))
        elif i % 3:
            a = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))
        else:
            a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 8)):
            if b and rnd.random() < 0.7:
                k = rnd.randrange(len(b))
                b[k : k + rnd.randint(1, 6)] = rnd.choice(["", "x", "ab", "town "])
        pairs.append((a, "".join(b) if i % 7 else "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30)))))
    got = documents.matching_ratio([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert documents.matching_ratio([], []).tolist() == []


def test_a_long_text_within_another_matches_whole(spark):
    """The only rare letter of the longer text comes first in the other one: its block splits the rest."""
    text = ("le la ne re " * 10 + "x " + "le la ne re " * 15).strip()
    rows = lambda t: spark.createDataFrame([("c", 1, t)], "case string, idx int, text string")
    assert SequenceMatcher(None, "x " + text, text).ratio() < 0.6
    (r,) = documents.scored_pairs(rows("x " + text.upper()), rows(text)).collect()
    assert r.score == 2 * len(text) / (2 * len(text) + 2)
