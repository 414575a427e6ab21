"""Clusters that grow batch by batch: new notices are placed among themselves and among stored ones at once.

The clusters are the connected components of all verdicts, whatever the batches were. A stored cluster keeps its id; where a
new notice bridges several, the one of smallest id stays and the others go on as names of it (``merges``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import exists, scratch, written
from . import dedupe

#: What a stored notice needs to meet later ones.
KEYS = ("id", "notice_type", "country", "deadline_at", "embedding", "pubs", "xrefs", "buyer", "grams")


def _through(new: DataFrame, old: DataFrame, key: str, reason: str) -> DataFrame:
    """(a, b, reason, confidence): new notices and the stored notice of smallest id under a publication or reference of theirs.
    All notices of such a key are of one cluster, so that one stands for them."""
    keys = lambda rows: rows.select("notice_type", F.explode(F.array_distinct(key)).alias("k"), "id")
    asked = keys(new)
    held = keys(old).join(asked.select("notice_type", "k").distinct(), ["notice_type", "k"], "left_semi").groupBy("notice_type", "k").agg(F.min("id").alias("b"))
    return asked.withColumnRenamed("id", "a").join(held, ["notice_type", "k"]).select("a", "b", F.lit(reason).alias("reason"), F.lit(1.0).alias("confidence"))


def _close(new: DataFrame, old: DataFrame) -> DataFrame:
    """Stored notices of a buyer and type that new ones have deadlines within the hour of, and some more."""
    slot = F.floor(F.unix_seconds("deadline_at") / dedupe.NEAR_S)
    keyed = lambda rows: rows.filter("buyer is not null and deadline_at is not null").withColumns({"_k": F.xxhash64(*dedupe.BUYER_KEY), "_slot": slot})
    asked = keyed(new).select("_k", F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)).alias("_slot")).distinct()
    return keyed(old).join(asked, ["_k", "_slot"], "left_semi").select(*old.columns)


def met(new: DataFrame, old: DataFrame, *, vectors: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of all verdicts among new notices, and of new with stored ones (both frames ``dedupe.prepared``; stored ones are never
    compared with each other): links (a, b) of new notices and links of new (a) with stored ones (b) that connect what all
    verdicts do, the best verdicts (id, partner, reason, confidence) of new notices and those of stored ones, a few rows each.

    A class of copies meets other classes, not a copy other copies. Its new members are linked to the first, its stored ones to
    one new notice that meets the class; that one stands for all.
    """
    both = new.select(*KEYS, F.lit(False).alias("stored")).unionByName(_close(new, old).select(*KEYS, F.lit(True).alias("stored")))
    members, classes = dedupe.classed(both, "stored")
    firsts = written(members.groupBy("c").agg(F.min(F.when(~F.col("stored"), F.col("id"))).alias("new"), F.min(F.when(F.col("stored"), F.col("id"))).alias("old")), "firsts")
    fresh = classes.join(firsts.filter("new is not null").select(F.col("c").alias("id")), "id", "left_semi").select(*classes.columns)
    side = lambda n: firsts.select(F.col("c").alias(n), F.col("new").alias(f"{n}_new"), F.col("old").alias(f"{n}_old"))
    of = written(dedupe.class_verdicts(fresh, classes).join(side("a"), "a").join(side("b"), "b"), "met")
    itself = of.filter("a = b")

    refs = dedupe.stars(new)
    through = _through(new, old, "pubs", dedupe.RULES[0]).unionByName(_through(new, old, "xrefs", dedupe.RULES[1]))
    if vectors:
        verdicts = lambda pairs, *others: dedupe.verdicts(new, pairs, *others).select("a", "b", "reason", "confidence")
        refs = refs.unionByName(verdicts(dedupe._alike(new)))
        through = through.unionByName(verdicts(dedupe._alike(new, old), old))
    refs, through = written(refs, "refs"), written(through, "through")

    mine, theirs = members.filter("not stored").select("id", "c"), members.filter("stored").select("id", "c")
    copies = mine.join(itself.select(F.col("a").alias("c"), F.col("a_new").alias("a")), "c").filter("id > a").select("a", F.col("id").alias("b"))
    inside = refs.select("a", "b").unionByName(copies).unionByName(of.filter("a < b and b_new is not null").select(F.col("a_new").alias("a"), F.col("b_new").alias("b")))
    least = of.filter("b_old is not null").groupBy("b").agg(F.min("a_new").alias("a"), F.min(dedupe.best("a_new")).alias("_m"))
    held = theirs.join(least.withColumnRenamed("b", "c"), "c")
    across = through.select("a", "b").unionByName(held.select("a", F.col("id").alias("b"))).unionByName(of.filter("b_old is not null").select(F.col("a_new").alias("a"), F.col("b_old").alias("b")))

    ways = lambda rows, a, b: rows.select(F.col(a).alias("id"), F.col(b).alias("partner"), "reason", "confidence")
    others = of.filter("a <> b").groupBy(F.col("a").alias("c")).agg(F.min(dedupe.best("b")).alias("_m")).select("c", F.col("_m._with").alias("partner"), "_m.reason", "_m.confidence")
    second = members.filter("id > c").groupBy("c").agg(F.min("id").alias("second"))
    own = itself.select(F.col("a").alias("c"), "reason", "confidence").join(second, "c")
    own = mine.join(own, "c").withColumn("partner", F.when(F.col("id") == F.col("c"), F.col("second")).otherwise(F.col("c")))
    news = ways(refs, "a", "b").unionByName(ways(refs, "b", "a")).unionByName(ways(through, "a", "b")).unionByName(ways(mine.join(others, "c"), "id", "partner")).unionByName(ways(own, "id", "partner"))
    olds = ways(through, "b", "a").unionByName(held.select("id", F.col("_m._with").alias("partner"), "_m.reason", "_m.confidence"))
    return inside, across, news, olds


def solved(new: DataFrame, old: DataFrame, *, vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """D-12, D-13. Of ``new`` and ``old`` (prepared, old with cluster_id): the new members (id, cluster_id, reason, confidence)
    and the merges (cluster_id, into, reason, confidence) of stored clusters that new notices bridge.

    The graph has new notices and stored clusters as nodes and verdicts as links; its components are the clusters. A
    component is named by its smallest stored cluster, or, without one, by its smallest notice, which then has no reason
    and confidence 1. Any other member has the reason and confidence of its best verdict (ties: smallest partner).
    """
    inside, across, news, olds = met(new, old.select(*KEYS), vectors=vectors)
    of = old.select(F.col("id").alias("_id"), "cluster_id")
    node = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    across = across.join(of, F.col("b") == F.col("_id")).select("a", "cluster_id")
    links = written(inside.select(node(1, "a").alias("a"), node(1, "b").alias("b")).unionByName(across.select(node(0, "cluster_id").alias("a"), node(1, "a").alias("b"))).distinct(), "links")
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    label = written(dedupe.cluster(nodes, links), "labels")
    best = news.groupBy(F.col("id").alias("_n")).agg(F.min(dedupe.best("partner")).alias("_m"))
    placed = label.filter("id.kind = 1").select(F.col("id.key").alias("_l"), F.col("cluster_id.key").alias("_c"), (F.col("id") == F.col("cluster_id")).alias("_first"))
    members = new.select("id").join(placed, F.col("id") == F.col("_l"), "left").join(best, F.col("id") == F.col("_n"), "left")
    named = F.coalesce("_first", F.lit(True))
    members = members.select("id", F.coalesce("_c", "id").alias("cluster_id"), F.when(~named, F.col("_m.reason")).alias("reason"), F.when(named, F.lit(1.0)).otherwise(F.col("_m.confidence")).alias("confidence"))
    touched = olds.join(of, F.col("id") == F.col("_id")).groupBy(F.col("cluster_id").alias("_n")).agg(F.min(dedupe.best("partner")).alias("_m"))
    bridged = label.filter("id.kind = 0 and id <> cluster_id").select(F.col("id.key").alias("cluster_id"), F.col("cluster_id.key").alias("into"))
    merges = bridged.join(touched, F.col("cluster_id") == F.col("_n")).select("cluster_id", "into", "_m.reason", "_m.confidence")
    return members, merges


def place(new: DataFrame, stored: DataFrame, *, vectors: bool = True) -> DataFrame:
    """D-12. (id, cluster_id, reason, confidence) of new notices beside stored ones, which have a cluster_id."""
    new_p = written(dedupe.prepared(new), "new")
    old_p = written(dedupe.prepared(stored).join(stored.select(F.col("id").alias("_id"), "cluster_id"), F.col("id") == F.col("_id")).drop("_id"), "stored")
    return solved(new_p, old_p, vectors=vectors)[0]


class Store:
    """Members and merges of each batch under a folder: ``members/batch=N`` and ``merges/batch=N``.

    A batch reads the batches before it and writes its own folders anew, so that a batch that is run again, whole or
    after a failure between its writes, leaves what it left the first time.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.path = spark, path
        kind = T._parse_datatype_string(id_type)
        text = T.StringType()
        self.members_schema = T.StructType([
            T.StructField("id", kind), T.StructField("cluster_id", kind), T.StructField("reason", text), T.StructField("confidence", T.DoubleType()), T.StructField("notice_type", text), T.StructField("country", text),
            T.StructField("deadline_at", T.TimestampType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *[T.StructField(c, T.ArrayType(text)) for c in ("pubs", "xrefs", "grams")], T.StructField("buyer", text), T.StructField("batch", T.LongType()),
        ])
        self.merges_schema = T.StructType([T.StructField("cluster_id", kind), T.StructField("into", kind), T.StructField("reason", text), T.StructField("confidence", T.DoubleType()), T.StructField("bridge", T.BooleanType()), T.StructField("batch", T.LongType())])

    def _read(self, table: str, schema: T.StructType, before: int | None) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def merges(self, before: int | None = None) -> DataFrame:
        """Each cluster that was merged and the one it is now: later batches overrule earlier ones."""
        return self._read("merges", self.merges_schema, before).groupBy("cluster_id").agg(F.max_by("into", "batch").alias("into"))

    def members(self, before: int | None = None) -> DataFrame:
        """Every placed notice with its cluster of today, and its keys."""
        now = self.merges(before).select(F.col("cluster_id").alias("_c"), "into")
        rows = self._read("members", self.members_schema, before).join(now, F.col("cluster_id") == F.col("_c"), "left")
        return rows.withColumn("cluster_id", F.coalesce("into", "cluster_id")).drop("_c", "into")

    def merged_from(self) -> DataFrame:
        """(cluster_id, notice_id, reason, confidence, batch): a row for each notice that its cluster absorbed."""
        return self.members().filter("reason is not null").select("cluster_id", F.col("id").alias("notice_id"), "reason", "confidence", "batch")

    def clusters(self) -> DataFrame:
        """(cluster_id, confidence, notices): the least confidence of what was absorbed, clusters and notices."""
        now = self.merges()
        bridges = self._read("merges", self.merges_schema, None).filter("bridge").select("cluster_id", "confidence")
        bridges = bridges.join(now, "cluster_id").select(F.col("into").alias("cluster_id"), "confidence", F.lit(0).cast("long").alias("n"))
        rows = self.members().select("cluster_id", "confidence", F.lit(1).cast("long").alias("n")).unionByName(bridges)
        return rows.groupBy("cluster_id").agg(F.min("confidence").alias("confidence"), F.sum("n").alias("notices"))

    def add(self, notices: DataFrame, batch: int, *, vectors: bool = True) -> None:
        """Place a batch of notices and store it. Ids that an earlier batch placed stay where they are; of rows of one id
        within a batch one is taken."""
        with scratch(self.spark):
            self._add(notices, batch, vectors)

    def _add(self, notices: DataFrame, batch: int, vectors: bool) -> None:
        before = self.members(batch)
        new = dedupe.prepared(notices).dropDuplicates(["id"]).join(before.select("id"), "id", "left_anti")
        new = written(new, "new")
        if new.isEmpty():
            return
        members, merges = solved(new, before, vectors=vectors)
        merges = written(merges.withColumn("bridge", F.lit(True)), "merges")
        # Clusters that were merged into one that is merged now go to the same place, so that one look finds the cluster.
        moved = merges.select(F.col("cluster_id").alias("_via"), F.col("into").alias("_to"), "reason", "confidence")
        earlier = self.merges(batch).join(moved, F.col("into") == F.col("_via")).select("cluster_id", F.col("_to").alias("into"), "reason", "confidence", F.lit(False).alias("bridge"))
        merges.unionByName(earlier).write.mode("overwrite").parquet(f"{self.path}/merges/batch={batch}")
        members.join(new, "id").select(*[f.name for f in self.members_schema if f.name != "batch"]).write.mode("overwrite").parquet(f"{self.path}/members/batch={batch}")
