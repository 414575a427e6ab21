"""L-14. A table of latest states in buckets: a batch rewrites the buckets that it touches, and a manifest names the files of each."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class UpsertTable:
    """Rows of ``schema`` by ``keys``, with created_at and updated_at, under a folder that all executors share.

    ``data`` holds a folder for each batch with its buckets, ``manifests`` a file for each batch: which folder has which bucket.
    A reader takes the last manifest. It appears by a rename, after all data of its batch is written: a batch that fails
    before leaves the table as it was, and a batch that is in already is passed over. Files of untouched buckets stay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.columns = [f.name for f in schema]
        stamps = [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
        self.schema = T.StructType([*schema.fields, *stamps])

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifest(self) -> dict:
        """{"batch": the last batch, "buckets": bucket -> folder}."""
        fs, where = self._fs(f"{self.path}/manifests")
        names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"batch": -1, "buckets": {}}
        lines = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()
        return json.loads(lines[0])

    def _of(self, folders: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folders[str(b)]}/bucket={b}" for b in (range(self.buckets) if buckets is None else buckets) if str(b) in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._of(self.manifest()["buckets"])

    def upsert(self, rows: DataFrame, batch: int, now: Column, order: Column) -> None:
        """Batch ``batch`` (numbers rise): a row replaces the stored one of its keys; of several, the last by ``order``.

        created_at stays that of the first time, updated_at is now for every key of the batch. Null keys are equal. The
        buckets that the batch names, at most ``buckets``, are all that is read and written.
        """
        state = self.manifest()
        if batch <= state["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = rows.select(*self.columns, order.alias("_order")).withColumn("bucket", bucket)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        values = [c for c in self.columns if c not in self.keys]
        fresh = new.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*values), "_order").alias("_v")).select("bucket", *self.keys, "_v", now.alias("created_at"), now.alias("updated_at"), F.lit(1).alias("_new"))
        old = self._of(state["buckets"], touched).withColumn("bucket", bucket).select("bucket", *self.keys, F.struct(*values).alias("_v"), "created_at", "updated_at", F.lit(0).alias("_new"))
        both = old.unionByName(fresh).groupBy("bucket", *self.keys).agg(F.max_by("_v", "_new").alias("_v"), F.min_by("created_at", "_new").alias("created_at"), F.max_by("updated_at", "_new").alias("updated_at"))
        folder = f"{batch:012}-{uuid.uuid4().hex}"
        both.select(*self.keys, "_v.*", "created_at", "updated_at", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._swap({"batch": batch, "buckets": state["buckets"] | {str(b): folder for b in touched}})

    def _swap(self, state: dict) -> None:
        name = f"{self.path}/manifests/{state['batch']:012}"
        fs, draft = self._fs(f"{name}-{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, final = self._fs(f"{name}.json")
        if not fs.rename(draft, final):
            raise OSError(f"another writer has batch {state['batch']}")

    def vacuum(self) -> list[str]:
        """Delete folders of data that no bucket of the last manifest is in; their names. For when no older reader is left."""
        held = set(self.manifest()["buckets"].values())
        fs, where = self._fs(f"{self.path}/data")
        gone = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName() not in held] if fs.exists(where) else []
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)
