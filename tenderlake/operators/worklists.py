"""Inboxes, worklists, evidence, alerts, digests, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_until, urgency, working_days_before

OFFSETS = (14, 7, 3, 1)
CLOSED = ("submitted", "closed")
DISMISS_REASONS = ("too_big", "too_small", "wrong_activity", "no_time", "bad_buyer", "other")
PAGE_DEFAULT, PAGE_MOST, LIST_MOST, SEND_MOST, DIGEST_TOP, DIGEST_HOUR = 25, 100, 200, 100, 10, 7
EXPIRING_DAYS = 30


def micros_before(now: Column, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(hours * 3_600_000_000))


def inbox_page(matches: DataFrame, *, state: str | None = None, least: int = 0, after: tuple[int, str] | None = None, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Q-01. A page by (score desc, id), after a cursor's (score, id); one row more than the limit tells of a next page."""
    if not 0 <= least <= 100 or not 1 <= limit <= PAGE_MOST:
        raise ValueError("least must be 0 to 100 and limit 1 to 100")
    out = matches.filter(F.col("score") >= least)
    if state:
        out = out.filter(F.col("state") == state)
    if after:
        out = out.filter((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("match_id") > after[1])))
    return out.orderBy(F.desc("score"), "match_id").limit(limit + 1)


def states_after(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Q-02. Each match's state after its last valid transition."""
    ok = (F.col("to") != "dismissed") | F.coalesce(F.col("reason").isin(*DISMISS_REASONS), F.lit(False))
    last = events.filter(ok).groupBy("match_id").agg(F.max_by("to", F.struct("at", "event_id")).alias("_to"))
    return matches.join(last, "match_id", "left").withColumn("state", F.coalesce("_to", "state")).drop("_to")


def rejected_events(events: DataFrame) -> DataFrame:
    return events.filter((F.col("to") == "dismissed") & ~F.coalesce(F.col("reason").isin(*DISMISS_REASONS), F.lit(False)))


def pursued(matches: DataFrame, tenders: DataFrame) -> DataFrame:
    """Q-03. Tenders to open: pursued matches without one, once for each org and notice."""
    wanted = matches.filter("state = 'pursued'").dropDuplicates(["org_id", "notice_id"])
    return wanted.join(tenders.select("org_id", "notice_id"), ["org_id", "notice_id"], "left_anti").withColumn("stage", F.lit("analysis"))


def worklist(tenders: DataFrame, *, limit: int = LIST_MOST) -> DataFrame:
    """Q-05. By deadline (null last), then newest, then id."""
    return tenders.orderBy(F.asc_nulls_last("deadline_at"), F.desc("created_at"), "tender_id").limit(limit)


def deadline_bands(tenders: DataFrame, now: Column) -> DataFrame:
    """Q-09, Q-10."""
    d = days_until(F.col("deadline_at"), now)
    return tenders.groupBy("org_id", urgency(F.col("deadline_at"), now).alias("band")).agg(F.count("*").alias("n"), F.count_if(d.between(0, 7)).alias("due_this_week"))


def org_counters(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q-07. New matches, and evidence expiring or expired, of each org that has either."""
    m = matches.groupBy("org_id").agg(F.count_if(F.col("state") == "new").alias("new_matches"))
    e = evidence.groupBy("org_id").agg(F.count_if(F.col("status").isin("expiring", "expired")).alias("expiring"))
    return m.join(e, "org_id", "full").select("org_id", F.coalesce("new_matches", F.lit(0)).alias("new_matches"), F.coalesce("expiring", F.lit(0)).alias("expiring"))


EVIDENCE_KINDS = ("admin", "certification", "reference", "people", "content", "template")
EVIDENCE_STATUSES = ("valid", "expiring", "expired")


def evidence_list(evidence: DataFrame, *, kind: str | None = None, status: str | None = None, limit: int = LIST_MOST) -> DataFrame:
    """V-01. An org's evidence, soonest expiry first (null last), then newest, then id; an unknown filter is an error."""
    for value, known, name in ((kind, EVIDENCE_KINDS, "kind"), (status, EVIDENCE_STATUSES, "status")):
        if value is not None and value not in known:
            raise ValueError(f"{name} must be one of {', '.join(known)}")
        if value is not None:
            evidence = evidence.filter(F.col(name) == value)
    return evidence.orderBy(F.asc_nulls_last("expires_at"), F.desc("created_at"), "evidence_id").limit(limit)


def freshness(evidence: DataFrame, today: Column) -> DataFrame:
    """V-04. new_status of each piece: expired before today, expiring within 30 days, else valid."""
    e = F.col("expires_at")
    return evidence.withColumn("new_status", F.when(e.isNull(), "valid").when(e < today, "expired").when(e <= F.date_add(today, EXPIRING_DAYS), "expiring").otherwise("valid"))


def reclassified(evidence: DataFrame, today: Column) -> DataFrame:
    """The rows whose status changes."""
    return freshness(evidence, today).filter(~F.col("status").eqNullSafe(F.col("new_status")))


def vault_cube(evidence: DataFrame) -> DataFrame:
    """V-02, V-05. Counts by org, status and kind with all margins of the last two."""
    g = evidence.groupBy("org_id", F.expr("status"), F.expr("kind")).agg(F.count("*").alias("_n"))
    return g.cube("org_id", "status", "kind").agg(F.sum("_n").alias("n")).filter("org_id is not null")


#: Tenders that are broadcast at most.
BROADCAST_TENDERS = 1_000_000


def suggestions(references: DataFrame, tenders: DataFrame) -> DataFrame:
    """V-06. References whose codes lie under a tender's families, with the codes as the reason; an equi-join on prefixes.

    Tenders of the same families are one class: references are found and their codes gathered once for a class, and only then
    given to its tenders. A million tenders at most are broadcast, so that the rows of the result aren't shuffled.
    """
    fam = tenders.select("tender_id", F.explode("families").alias("f")).filter(F.length("f").between(2, 8)).groupBy("tender_id").agg(F.array_sort(F.collect_set("f")).alias("_fs"))
    codes = references.select("reference_id", F.explode("cpv").alias("c")).distinct()
    asked = fam.select("_fs").distinct().select("_fs", F.explode("_fs").alias("f"))
    keys = codes.withColumn("f", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(8), F.length("c"))), lambda n: F.substring("c", F.lit(1), n))))
    found = keys.join(asked, "f").groupBy("_fs", "reference_id").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("codes"))
    return found.join(F.broadcast(fam) if tenders.count() <= BROADCAST_TENDERS else fam, "_fs").select("tender_id", "reference_id", "codes")


def due_alerts(tenders: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """A-03, A-04. For each open tender with a deadline ahead the largest offset that is due and not sent yet."""
    live = tenders.filter(~F.col("stage").isin(*CLOSED) & (F.col("deadline_at") > now))
    rows = live.withColumn("offset", F.explode(F.array(*[F.lit(n) for n in OFFSETS]))).withColumn("kind", F.concat(F.lit("deadline.j"), F.col("offset").cast("string")))
    due = rows.filter(working_days_before(F.col("deadline_at"), F.col("offset")) <= now)
    due = due.join(sent.select("tender_id", "kind").distinct(), ["tender_id", "kind"], "left_anti")
    return due.groupBy("org_id", "tender_id").agg(F.max("offset").alias("offset")).withColumn("kind", F.concat(F.lit("deadline.j"), F.col("offset").cast("string")))


def escalations(notifications: DataFrame, now: Column) -> DataFrame:
    """A-05. Three-day alerts sent over 24 hours ago, unacknowledged, whose tender wasn't escalated before."""
    late = notifications.filter((F.col("kind") == "deadline.j3") & F.col("acknowledged_at").isNull() & (F.col("sent_at") < micros_before(now, 24)))
    done = notifications.filter("kind = 'deadline.escalated'").select("org_id", "tender_id").distinct()
    return late.join(done, ["org_id", "tender_id"], "left_anti").groupBy("org_id", "tender_id").agg(F.min("notification_id").alias("notification_id"))


def pending(notifications: DataFrame, *, most: int = SEND_MOST) -> DataFrame:
    """A-06. The first unsent notifications of each org."""
    w = Window.partitionBy("org_id").orderBy("created_at", "notification_id")
    return notifications.filter("sent_at is null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)


def recipients(members: DataFrame, users: DataFrame) -> DataFrame:
    """A-07. Members but viewers, with their locale (fr if none). Orgs without any hold their alerts (``left_anti``)."""
    return members.filter("role <> 'viewer'").join(users, "user_id").select("org_id", "user_id", F.coalesce("locale", F.lit("fr")).alias("locale"))


def digest_orgs(orgs: DataFrame, digests: DataFrame, now: Column) -> DataFrame:
    """A-10. Orgs whose clock reads seven, without a digest in the last 20 hours."""
    recent = digests.filter(F.col("created_at") > micros_before(now, 20)).select("org_id").distinct()
    return orgs.filter(F.hour(F.from_utc_timestamp(now, F.col("tz"))) == DIGEST_HOUR).join(recent, "org_id", "left_anti")


def best_matches(matches: DataFrame) -> DataFrame:
    """The best new matches of each org, with their place as ``_k``."""
    w = Window.partitionBy("org_id").orderBy(F.desc("score"), "match_id")
    return matches.filter("state = 'new'").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= DIGEST_TOP)


def digests(matches: DataFrame, counters: DataFrame) -> DataFrame:
    """A-11. The best new matches of each org as lines, with its counts; orgs with nothing new are left out."""
    top = best_matches(matches)
    line = F.format_string("  [%3d] %s", "score", F.substring("title", 1, 80))
    lines = top.groupBy("org_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    return counters.filter("new_matches > 0 or expiring > 0").join(lines, "org_id", "left")


def monthly_usage(usage: DataFrame) -> DataFrame:
    """U-01."""
    return usage.groupBy("org_id", F.date_format("at", "yyyy-MM").alias("month"), "feature").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def reuse(requests: DataFrame, answers: DataFrame, hours: int = 24) -> DataFrame:
    """U-03. Whether a request finds an answer to its key that is younger than ``hours``."""
    last = answers.groupBy("key").agg(F.max("answered_at").alias("answered_at"))
    age = (F.unix_micros("at") - F.unix_micros("answered_at")) < hours * 3_600_000_000
    return requests.join(last, "key", "left").withColumn("hit", F.coalesce(age, F.lit(False)))
