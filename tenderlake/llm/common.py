"""What the corpus operators share: word patterns, tables that survive lost executors, global running sums."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import new_folder

#: White space of the word rule: blank and the control characters 9 to 13. Words are runs of anything else.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs no rerun."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    for held in _scratch:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at the end the tables that ``durable`` wrote within. Nothing made within may be read after; what is to stay
    is written by ``kept``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``durable``, but not deleted with the tables of ``scratch``."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Words of a text as an array column (null: empty)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """Exclusive running sums (and a rank from 0) of each group, in the order given, without a task per group.

    Rows are dealt by ranges of (group, order), so that a group of any size is cut over many partitions. Each partition's
    totals per group are summed over the partitions before it; a window within (partition, group) does the rest. The dealt
    rows are written first: both readings then see the same cut. ``sums``: new column -> column of longs. Order the rows
    by columns that settle all ties but those between equal rows.
    """
    spark = df.sparkSession
    n = partitions_for(spark)
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    dealt = durable(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "running")
    one = F.lit(1).cast("long")
    parts = dealt.groupBy("_part", *group).agg(F.count(one).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.col(c).alias(f"_g_{c}") for c in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s0_{k}") for k in sums])
    within = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumns({f"_r_{k}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()} | ({"_rank": F.row_number().over(within) - 1} if rank else {}))
    on = rows["_part"] == parts["_part"]
    for c in group:
        on = on & rows[c].eqNullSafe(parts[f"_g_{c}"])
    out = rows.join(parts, on).drop(parts["_part"])
    out = out.withColumns({k: F.col(f"_r_{k}") + F.col(f"_s0_{k}") for k in sums} | ({rank: (F.col("_rank") + F.col("_n0")).cast("long")} if rank else {}))
    return out.select(*df.columns, *sums, *([rank] if rank else []))
