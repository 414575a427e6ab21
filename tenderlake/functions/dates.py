"""Instants and days as columns. Sessions are in UTC; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_date(c: Column) -> Column:
    """N-10. ISO instant or date, with or without offset, as an instant; a date is its local midnight; else null."""
    dated = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1T00:00:00$2")
    whole = dated.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$")
    return F.when(whole, F.try_to_timestamp(dated))


def split_deadline(date: Column, time: Column) -> Column:
    """N-11. The day of one value at the time of another, whose offset governs."""
    joined = F.concat(F.substring(F.trim(date), 1, 10), F.lit("T"), F.trim(time))
    return F.when(joined.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(joined))


def plain_instant(c: Column) -> Column:
    """N-12. ISO instant or ten-character date; without an offset it is UTC; else null."""
    return offset_date(c)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def is_working_day(c: Column) -> Column:
    """A-01. Monday to Friday."""
    return F.weekday(c) < 5


def working_days_before(ts: Column, n: Column) -> Column:
    """A-02. The instant n working days earlier at the same time of day, in closed form."""
    w = F.weekday(ts)
    ready = F.when(w >= 5, F.lit(5)).otherwise(w)
    rest = n - ready
    back = F.when(n <= ready, n + F.greatest(w - 5, F.lit(0))).otherwise(w + 2 + 7 * F.floor((rest - 1) / 5) + F.pmod(rest - 1, F.lit(5)) + 1)
    return F.timestamp_micros((F.unix_micros(ts) - back.cast("long") * F.lit(86_400_000_000)).cast("long"))


def time_bucket(ts: Column, every: str) -> Column:
    """S-04. Start of the tumbling window that an instant falls in."""
    return F.window(ts, every)["start"]


def urgency(deadline: Column, now: Column) -> Column:
    """Q-09. none, passed, critical (1 day), urgent (3), soon (7) or comfortable."""
    d = days_between(deadline, now)
    return F.when(deadline.isNull(), "none").when(d < 0, "passed").when(d <= 1, "critical").when(d <= 3, "urgent").when(d <= 7, "soon").otherwise("comfortable")


def days_until(deadline: Column, now: Column) -> Column:
    """Q-10. Whole days to a deadline, rounded up."""
    return F.ceil(days_between(deadline, now))
