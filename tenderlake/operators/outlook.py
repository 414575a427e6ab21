"""Renewals, thresholds, missing documents, diffs, profiles, funnels, planned dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import working_days_before


def renewals(awards: DataFrame, today: Column, least: int = 3, most: int = 18) -> DataFrame:
    """O-01. Awards that end in the next months; an unknown duration has no end."""
    end = F.add_months("signed_at", F.col("duration_months"))
    return awards.withColumn("ends_at", end).filter(F.col("ends_at").between(F.add_months(today, least), F.add_months(today, most)))


def threshold_in_force(rows: DataFrame, thresholds: DataFrame, at: str = "at") -> DataFrame:
    """O-02. The amount of the last threshold that began by then, of the row's code and country; as-of by equi-join. Legal
    thresholds are some dozens a decade."""
    t = thresholds.select("code", "country", F.col("amount").alias("_amount"), "valid_from", "valid_to")
    held = rows.join(t, ["code", "country"]).filter((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))
    best = held.groupBy("row_id").agg(F.max_by("_amount", "valid_from").alias("threshold"))
    return rows.join(best, "row_id", "left").withColumn("above", F.col("value") >= F.col("threshold"))


def missing_documents(required: DataFrame, evidence: DataFrame, lead_times: DataFrame) -> DataFrame:
    """O-03. Required kinds that an org holds no evidence for at the deadline, and whether there is time to get them."""
    valid = evidence.select(F.col("org_id").alias("_o"), F.col("kind").alias("_k"), F.col("expires_at").alias("_e"))
    gone = required.join(valid, (F.col("org_id") == F.col("_o")) & (F.col("kind") == F.col("_k")) & (F.col("_e") >= F.col("deadline")), "left_anti")
    return gone.join(lead_times, "kind", "left").withColumn("feasible", F.col("typical_days") <= F.col("runway_days"))


def compliance(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """O-04. Share covered, and whether an eliminatory requirement is still open."""
    rows = requirements.join(items.select("ref", F.lit(True).alias("_c")).distinct(), "ref", "left")
    covered = F.coalesce("_c", F.lit(False))
    return rows.groupBy("tender_id").agg(F.round(F.avg(covered.cast("double")), 4).alias("coverage"), F.bool_or((F.col("type") == "eliminatory") & ~covered).alias("blocked"))


def requirement_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """O-05. added, removed or modified of each key whose row differs."""
    a = old.select(key, F.struct(*columns).alias("_a"))
    b = new.select(key, F.struct(*columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def supplier_profiles(awards: DataFrame) -> DataFrame:
    """O-06. Awards, amounts and buyers of each supplier, and the buyer that it won from most often."""
    per = awards.groupBy("supplier", "buyer").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return per.groupBy("supplier").agg(F.sum("n").alias("awards"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.sum("amount") / F.sum("n"), 2).alias("mean"), F.count("*").alias("buyers"), F.max_by("buyer", F.struct("n", "buyer")).alias("top_buyer"), F.count_if(F.col("n") > 1).alias("repeat_buyers"))


def funnel(events: DataFrame, stages: list[str]) -> DataFrame:
    """O-07. Counts per stage and the rate from each stage to the next."""
    wide = events.groupBy("org_id").pivot("stage", stages).agg(F.count(F.lit(1))).na.fill(0)
    rates = [F.round(F.when(F.col(a) > 0, F.col(b) / F.col(a)), 4).alias(f"{a}_to_{b}") for a, b in zip(stages, stages[1:], strict=False)]
    return wide.select("org_id", *stages, *rates)


def planned_dates(tasks: DataFrame) -> DataFrame:
    """O-08. Due dates: so many working days before the deadline."""
    return tasks.withColumn("due_at", working_days_before(F.col("deadline_at"), F.col("buffer_days")))
