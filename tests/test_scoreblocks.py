"""Scores in blocks against a row for each pair."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tenderlake.operators import scoreblocks, scoring
from tenderlake.sources import tables as t

NOW = datetime(1998, 6, 1)


def odd(spark, sf_dir):
    """Notices and profiles of the tables and odd ones: no codes, places, amounts; families of a star, blank keywords, no revenue."""
    n = t.notices(spark, sf_dir).limit(300)
    k = F.col("o_orderkey") if "o_orderkey" in n.columns else F.xxhash64("notice_id")
    late = F.lit(NOW) + F.make_dt_interval(F.pmod(k, F.lit(40)).cast("int") - 5)
    n = n.withColumns({"notice_type": F.when(k % 7 == 0, None).otherwise("competition"), "country": F.when(k % 5 == 0, "BE").when(k % 11 == 0, None).otherwise("FR"), "deadline_at": F.when(k % 6 == 0, None).otherwise(late), "title": F.concat_ws(" ", "title", F.when(k % 4 == 0, "iso 9001 RGE"))})
    n = n.withColumn("lots", F.when(k % 9 == 0, F.slice("lots", 1, 0)).otherwise(F.col("lots")))
    p = t.profiles(spark, sf_dir)
    s = F.xxhash64("profile_id")
    p = p.withColumns({"notice_types": F.when(s % 3 == 0, F.slice("notice_types", 1, 0)).otherwise(F.col("notice_types")), "cpv_families": F.when(s % 4 == 0, F.array(F.lit("*"), F.lit(""))).when(s % 4 == 1, F.slice("cpv_families", 1, 0)).otherwise(F.col("cpv_families")), "keywords": F.when(s % 5 == 0, F.array(F.lit(""), F.lit("Gear"), F.lit("gear"))).otherwise(F.col("keywords")), "annual_revenue": F.when(s % 6 == 0, 0.0).otherwise(F.col("annual_revenue"))})
    known = n.select("buyer_siren").limit(1).first()[0]
    return n, p.withColumn("known_buyer_sirens", F.when(s % 2 == 0, F.array(F.lit(known), F.lit(known))).otherwise(F.col("known_buyer_sirens")))


def test_blocks_give_the_scores_of_rows(spark, sf_dir, monkeypatch):
    """F4 to F8, F10, F14: counts, pairs from a limit on and breakdowns, without a row for each pair."""
    monkeypatch.setattr(scoreblocks, "PART", 5)
    monkeypatch.setattr(scoreblocks, "HELD", 16)
    monkeypatch.setattr(scoreblocks, "GIVEN", 50)
    n, p = odd(spark, sf_dir)
    n, p = n.localCheckpoint(), p.localCheckpoint()
    now = F.lit(NOW)
    rows = [tuple(r) for r in scoring.score_all(n, p, now).select("profile_id", "org_id", "notice_id", "national", "score", scoring.breakdown_ok(F.col("factors"), F.col("score"))).collect()]
    assert len(rows) > 300 and len({r[4] for r in rows}) > 20
    held = scoreblocks.coded_profiles(p)
    coded = scoreblocks.coded_notices(n, held, now)
    assert sorted(tuple(r) for r in scoreblocks.scored_pairs(coded, held, 30, 70).collect()) == sorted(r[:5] for r in rows if 30 <= r[4] <= 70)
    least = {r[0]: 50 for r in rows if r[0] != rows[0][0]}
    assert sorted(tuple(r) for r in scoreblocks.scored_pairs(coded, held, least).collect()) == sorted(r[:5] for r in rows if r[0] in least and r[4] >= 50)
    counts = {}
    for r in rows:
        counts[r[0], r[1], r[4]] = counts.get((r[0], r[1], r[4]), 0) + 1
    assert {(r.profile_id, r.org_id, r.score): r.n for r in scoreblocks.score_counts(coded, held).collect()} == counts
    oks = {}
    for r in rows:
        oks[r[5]] = oks.get(r[5], 0) + 1
    assert {r.ok: r.n for r in scoreblocks.score_counts(coded, held, points=True).collect()} == oks


def test_what_blocks_do_not_take(spark, sf_dir, monkeypatch):
    p = t.profiles(spark, sf_dir)
    assert scoreblocks.coded_profiles(p.unionByName(p)) is None
    assert scoreblocks.coded_profiles(p.withColumn("keywords", F.lit(None).cast("array<string>"))) is None
    monkeypatch.setattr(scoreblocks, "LISTS", 1)
    assert scoreblocks.coded_profiles(p) is None


def test_half_to_even():
    assert scoreblocks.rounded(np.array([0.5, 1.5, 2.5, 2.4999999999, 2.49999, 62.500000001, 62.5000000001])).tolist() == [0, 2, 2, 2, 2, 63, 62]
