"""Golden values of the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import dates, ids, text
from tenderlake.operators import documents as d
from tenderlake.operators import normalise as n
from tenderlake.operators.landing import BUDGET_HOURS


def one(spark, expr, /, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("name", "core"), [("Commune de Nogent-sur-Oise", "nogent sur oise"), ("Dijon Métropole", "dijon"), ("Métropole", "metropole"), (None, ""), ("commune d hyeres", "hyeres")])
def test_buyer(spark, name, core):
    assert one(spark, text.normalize_buyer(F.col("c")), c=("string", name)) == core


def test_text(spark):
    assert one(spark, text.normalize_text(F.col("c")), c=("string", "  Cœur — ÉTÉ 2026!")) == "c ur ete 2026"
    grams = one(spark, text.trigrams(F.col("c")), c=("string", "ab"))
    assert grams == ["  a", " ab", "ab "]
    assert one(spark, text.trigrams(F.col("c")), c=("string", "")) == []


@pytest.mark.parametrize(("raw", "at"), [("2026-08-11+02:00", datetime(2026, 8, 10, 22)), ("2026-08-11T09:30:00Z", datetime(2026, 8, 11, 9, 30)), ("2026-08-11", datetime(2026, 8, 11)), ("garbage", None), (None, None)])
def test_offset_date(spark, raw, at):
    assert one(spark, dates.offset_date(F.col("c")), c=("string", raw)) == at


def test_split_deadline(spark):
    assert one(spark, dates.split_deadline(F.col("a"), F.col("b")), a=("string", "2026-09-16+02:00"), b=("string", "16:30:00+02:00")) == datetime(2026, 9, 16, 14, 30)


def test_working_days(spark):
    def loop(at, k):
        from datetime import timedelta

        while k:
            at -= timedelta(days=1)
            k -= at.weekday() < 5
        return at

    cases = [(datetime(2026, 11, day, 17, 5), k) for day in range(9, 23) for k in range(0, 16)]
    rows = spark.createDataFrame(cases, "at timestamp, k int").select("at", "k", dates.working_days_before(F.col("at"), F.col("k")).alias("x")).collect()
    for r in rows:
        # Zero days back stays put on a working day; at a weekend it is the Friday before.
        want = loop(r.at, r.k) if r.k or r.at.weekday() < 5 else None
        assert want is None or r.x == want, r


def test_content_hash_ignores_key_order(spark):
    h = spark.createDataFrame([('{"a": 1, "b": [2]}',), ('{"b":[2],"a":1}',), ('{"a": 2, "b": [2]}',)], "p string").select(ids.content_hash(F.col("p")).alias("h")).collect()
    assert h[0].h == h[1].h != h[2].h


def test_identifier(spark):
    rows = spark.createDataFrame([("552 100 554",), ("55210055400013",), ("12",)], "c string").select(ids.identifier(F.col("c")).alias("x")).collect()
    assert [r.x and (r.x.siren, r.x.siret) for r in rows] == [("552100554", None), ("552100554", "55210055400013"), None]


@pytest.mark.parametrize(("dept", "nuts"), [("75", "FR10"), ("2A", "FRM0"), ("974", "FRY4"), ("6", "FRL0"), ("99", None)])
def test_departments(spark, dept, nuts):
    assert one(spark, n.department_nuts(F.col("c")), c=("string", dept)) == nuts


def test_clean_text(spark):
    assert one(spark, d.clean_text(F.col("c")), c=("string", "Communaut&#233; d&#039;Agglom&#233;ration")) == "Communauté d'Agglomération"
    assert one(spark, d.clean_text(F.col("c")), c=("string", "l&amp;#039;eau  ")) == "l'eau"
    assert one(spark, d.clean_text(F.col("c")), c=("string", "  ")) is None


@pytest.mark.parametrize(("url", "known"), [
    ("https://ted.europa.eu/en/notice/-/detail/00512345-2026", ("eu-ted", "00512345-2026")), ("https://www.boamp.fr/pages/avis/?idweb=26-12345", ("fr-boamp", "26-12345")),
    ("https://notted.europa.eu/notice/00512345-2026", None), ("https://www.boamp.fr/avis/detail/26-1", ("fr-boamp", "26-1")),
])
def test_recognised(spark, url, known):
    got = one(spark, d.recognised(F.col("c")), c=("string", url))
    assert (got and (got.source, got.external_id)) == known


def test_links(spark):
    rows = spark.createDataFrame([(1, "see https://a.example/x. And https://b.example/y", '<a href="https://a.example/x">The name of the call</a> <a href="https://x.com/z">us</a>')], "message_id int, text string, html string")
    got = [r.url for r in d.message_links(rows).orderBy("pos").collect()]
    assert got == ["https://a.example/x", "https://b.example/y", "https://x.com/z"]
    assert [r.label for r in d.link_labels(rows).collect()] == ["The name of the call"]
    kept = {r.url: r.kept for r in d.capped(d.message_links(rows)).collect()}
    assert kept == {"https://a.example/x": True, "https://b.example/y": True, "https://x.com/z": False}


@pytest.mark.parametrize(("to", "org"), [("sources+org_01ABC@in.example", "org_01ABC"), ("Name <SOURCES+org_x@h>", "org_x"), ("sources@h", None), ("other+org_x@h", None)])
def test_org_tag(spark, to, org):
    assert one(spark, d.org_tag(F.col("c")), c=("string", to)) == org


def test_greedy_matches(spark):
    pairs = [("c", 0, 0, 0.9), ("c", 0, 1, 0.95), ("c", 1, 1, 0.93), ("c", 1, 0, 0.7), ("c", 2, 1, 0.95)]
    got = {(r.p, r.g) for r in d.greedy_matches(spark.createDataFrame(pairs, "case string, p int, g int, score double")).collect()}
    # (0.95, 2, 1) comes before (0.95, 0, 1); then (0, 0).
    assert got == {(2, 1), (0, 0)}


def test_pick_lang(spark):
    pick = lambda v, p: one(spark, n.pick_lang(F.col("c"), F.col("p")), c=("string", v), p=("string", p))
    assert pick('{"fra": [" ", "bon"], "eng": "good"}', "en") == "good"
    assert pick('{"fra": ["bon"], "eng": "good"}', "it") == "bon"
    assert pick('{"zzz": "any"}', None) == "any"
    assert pick("plain", None) == "plain"
    assert pick('["", "x"]', None) == "x"


def test_budgets():
    assert BUDGET_HOURS == {"official_api": 6, "platform": 24, "long_tail": 72, "signals": 72}
