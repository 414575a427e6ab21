"""Org scoping, write checks and append-only rules as operators on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, org) -> DataFrame:
    """T-01. Rows of an org; no org gives no rows, an empty one is an error. The filter reaches the scan."""
    if org == "":
        raise ValueError("empty org")
    return df.filter(F.col("org_id") == F.lit(org).cast(df.schema["org_id"].dataType))


def memberships(df: DataFrame, org, user) -> DataFrame:
    """T-02. The org's rows and the user's own."""
    return df.filter((F.col("org_id") == F.lit(org)) | (F.col("user_id") == F.lit(user)))


def visible_users(users: DataFrame, members: DataFrame, org, user) -> DataFrame:
    """T-03. Oneself and those who share the org."""
    mates = members.filter(F.col("org_id") == F.lit(org)).select("user_id").distinct()
    return users.join(mates, "user_id", "left_semi").unionByName(users.filter(F.col("user_id") == F.lit(user))).distinct()


def scoped_events(df: DataFrame, org) -> DataFrame:
    """T-04. An org's events; without an org those of the platform only."""
    return df.filter(F.col("org_id").isNull() if org is None else F.col("org_id") == F.lit(org))


def foreign_rows(batch: DataFrame, org) -> DataFrame:
    """T-05. Rows of other orgs; a batch with any must be refused."""
    return batch.filter(~F.col("org_id").eqNullSafe(F.lit(org).cast(batch.schema["org_id"].dataType)))


def append_only_violations(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """T-06. Ids of old rows that are gone or changed."""
    columns = sorted(set(old.columns) & set(new.columns) - {key})
    a = old.select(key, F.xxhash64(*columns).alias("_a"))
    b = new.select(key, F.xxhash64(*columns).alias("_b"))
    return a.join(b, key, "left").filter("_b is null or _a <> _b").select(key, F.when(F.col("_b").isNull(), "deleted").otherwise("updated").alias("violation"))
