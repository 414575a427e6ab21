"""Licence scans: notices over lines, whole licence texts in longer texts, and all passages by brute force."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import licences

FILLER = " ".join(f"filler{i % 89} prose{i % 7}" for i in range(300))


def brute(text, templates, dice=licences.DICE):
    """Every run of words of a template's length, compared by the definition."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w, out = re.findall("[a-z0-9]+", low), []
    for name, ts in templates.items():
        for t in ts:
            v = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            b = set(zip(v, v[1:], strict=False))
            n = min(len(v), len(w))
            found = []
            for i in range(len(w) - n + 1):
                a = set(zip(w[i : i + n], w[i + 1 : i + n], strict=False))
                if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= dice:
                    found.append((-d, i))
            if found:
                d, i = min(found)
                out.append((name, -d, i))
    return sorted(out)


def test_against_all_passages():
    rnd = random.Random(8)
    templates = {"A": ["alpha beta gamma delta epsilon", "a b a b c"], "B": ["one two three four five six seven eight nine ten", "beta gamma"], "C": ["x"]}
    known = licences.Templates(templates, 0.8)
    words = sorted({w for ts in templates.values() for t in ts for w in t.split()})
    for _ in range(3000):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 2)):
            t = rnd.choice(rnd.choice(list(templates.values()))).split()
            if rnd.random() < 0.5:
                t[rnd.randrange(len(t))] = "z"
            at = rnd.randint(0, len(w))
            w[at:at] = t
        assert sorted(known.matches(" ".join(w))) == [(n, pytest.approx(d), i) for n, d, i in brute(" ".join(w), templates)], w


@pytest.mark.parametrize("name", sorted(licences.all_templates()))
def test_each_template_in_a_longer_text(name):
    """Wrapped anew, as comment lines, in the midst of other text, with some words changed."""
    known = licences.Templates(licences.all_templates(), licences.DICE)
    rnd = random.Random(name)
    for t in licences.all_templates()[name]:
        w = t.split()
        for _ in range(len(w) // 40):
            w[rnd.randrange(len(w))] = "changed"
        text = FILLER + "\n" + "\n".join(f"# {x}" for x in textwrap.wrap(" ".join(w), 40)) + "\n" + FILLER
        assert name in {m[0] for m in known.matches(text)}
    assert not list(known.matches(FILLER * 50))


def test_edges(spark):
    """Null, empty and long texts, ties, repeated rows, clashing names, an empty table."""
    notice = "Licensed under the MIT License."
    rows = [(1, None), (2, ""), (3, "MIT"), (4, FILLER * 40 + "\n" + notice), (4, FILLER * 40 + "\n" + notice), (None, notice + " and " + "Licensed under the ISC License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("licence", "dice", "templates", "_t")})
    got = [(r.doc_id, r.licence, r.dice, r.first_word, r.licences) for r in licences.licences(docs).collect()]
    at = len((FILLER * 40).split())
    assert got[:3] == [(i, None, None, None, "") for i in (1, 2, 3)] and got[3] == got[4] and got[3][:4] == (4, "MIT", 1.0, at)
    assert got[5] == (None, "ISC", 1.0, 6, "ISC,MIT")
    tie = licences.licences(docs, templates={"B": [notice], "A": [notice]}).filter("doc_id = 4").first()
    assert (tie.licence, tie.templates, tie.licences) == ("A", 2, "A,B")
    assert licences.licences(docs.limit(0)).count() == 0
