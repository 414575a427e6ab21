"""Alerts, health and tenancy at their boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import landing, tenancy, worklists

NOW = datetime(2026, 6, 1, 12)


def due(spark, deadline, sent, now=NOW):
    t = spark.createDataFrame([(1, 1, "analysis", deadline)], "org_id int, tender_id int, stage string, deadline_at timestamp")
    s = spark.createDataFrame([(1, k) for k in sent], "tender_id int, kind string")
    return [r.offset for r in worklists.due_alerts(t, s, F.lit(now)).collect()]


def test_largest_unsent_offset(spark):
    soon = NOW + timedelta(days=2)
    assert due(spark, soon, []) == [14]
    assert due(spark, soon, ["deadline.j14", "deadline.j7"]) == [3]
    assert due(spark, NOW - timedelta(days=1), []) == []
    assert due(spark, NOW + timedelta(days=60), []) == []


def health(spark, *, tier="official_api", last=50, prev=50, hours=1.0, enabled=True, schedule="x"):
    s = spark.createDataFrame([("s", tier, schedule, "open-license", enabled, "green")], "source string, tier string, schedule string, legal_basis string, enabled boolean, health string")
    at = None if hours is None else NOW - timedelta(hours=hours)
    v = spark.createDataFrame([("s", last, prev, at)], "source string, last long, previous long, last_success_at timestamp")
    r = landing.health(s, v, F.lit(NOW)).first()
    return r.verdict, r.should_page


@pytest.mark.parametrize(("given", "want"), [
    ({"hours": 6.0}, ("green", False)), ({"hours": 6.1}, ("silent", True)), ({"hours": 6.1, "tier": "long_tail"}, ("green", False)), ({"hours": 73.0, "tier": "long_tail"}, ("silent", False)),
    ({"hours": None}, ("silent", True)), ({"last": 5, "prev": 50}, ("degraded", False)), ({"last": 1, "prev": 19}, ("green", False)), ({"last": 12, "prev": 20}, ("green", False)), ({"enabled": False, "hours": None}, ("green", False)), ({"schedule": None, "hours": None}, ("green", False)),
])
def test_health(spark, given, want):
    assert health(spark, **given) == want


def test_scoping(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "org_id int, x string")
    assert [r.x for r in tenancy.scoped(df, 1).collect()] == ["a"]
    assert tenancy.scoped(df, None).count() == 0
    with pytest.raises(ValueError):
        tenancy.scoped(df, "")
    assert tenancy.foreign_rows(df, 1).count() == 1


def test_inbox_bounds(spark):
    with pytest.raises(ValueError):
        worklists.inbox_page(spark.range(1), limit=101)
