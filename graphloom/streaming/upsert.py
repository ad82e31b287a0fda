"""Incremental upkeep of a keyed table: changes arrive as a stream, batches are kept beside the table and merged by order."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Folders that keys are dealt into by hash.
BUCKETS = 16
#: Batches after which a stream merges what it has kept into the table.
COMPACT = 50


class KeptTable:
    """A table by key, as a base and the batches of changes since, all in folders by a hash of the key.

    Every row carries the order of the change that it comes from, so that an older change that comes late is told as such
    whenever it comes. A batch writes itself and reads nothing: its cost follows the batch, not the table. Readers merge;
    compact() merges for good. A batch number that is applied again writes the same files anew. Rows of the table itself are
    older than any change. Of changes of equal order that of the later batch counts, within a batch the greater by hash.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        about = spark.read.text(f"{folder}/about").first().value
        told = json.loads(about)
        self.key, self.order, self.buckets = told["key"], told["order"], told["buckets"]
        self.rows, self.sets = T.StructType.fromJson(told["rows"]), T.StructType.fromJson(told["changes"])

    @classmethod
    def create(cls, rows: DataFrame, changes: T.StructType, folder: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> KeptTable:
        """Write rows as the base of a table that changes of the given schema will be applied to."""
        spark = rows.sparkSession
        told = {"key": key, "order": order, "buckets": buckets, "rows": rows.schema.jsonValue(), "changes": changes.jsonValue()}
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
        self = cls(spark, folder)
        self._write_base(rows.withColumn("__at", F.lit(None).cast(self._at)), -1)
        return self

    @property
    def _at(self) -> T.StructType:
        """The order of a change: its order columns, its batch and a hash."""
        return T.StructType([T.StructField(c, self.sets[c].dataType) for c in self.order] + [T.StructField("__batch", T.LongType()), T.StructField("__hash", T.LongType())])

    @property
    def columns(self) -> list[T.StructField]:
        """Those of the table, then those that only changes have; columns of order are kept only if the table has them."""
        known = {f.name for f in self.rows}
        return [*self.rows, *[f for f in self.sets if f.name not in known and f.name not in self.order]]

    def _bucket(self) -> Column:
        loose = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.key])
        return F.when(loose, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).alias("bucket")

    def _write_base(self, rows: DataFrame, upto: int) -> None:
        rows.select("*", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/upto={upto}")
        # a base counts once this row is there
        self.spark.createDataFrame([(upto,)], "done long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bases/upto={upto}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Keep a batch of changes: of each key the last by order; each change with a null key."""
        at = F.struct(*self.order, F.lit(number).cast("long").alias("__batch"), F.xxhash64(*batch.columns).alias("__hash"))
        rows = batch.select(*self.key, F.struct(*self.sets.names).alias("__new"), at.alias("__at"), self._bucket())
        known = rows.where("bucket >= 0").groupBy(*self.key, "bucket").agg(F.max_by("__new", "__at").alias("__new"), F.max("__at").alias("__at"))
        loose = rows.where("bucket < 0").select(*known.columns)
        known.unionByName(loose).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/changes/batch={number}")

    def _newest(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/bases").agg(F.max("done")).first()[0]

    def _merged(self, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """All columns and __at, from the newest base and the batches after it (up to a number)."""
        since = self._newest()
        base_schema = T.StructType([*[f for f in self.columns], T.StructField("__at", self._at), T.StructField("bucket", T.IntegerType())])
        base = self.spark.read.schema(base_schema).parquet(f"{self.folder}/base/upto={since}")
        new_schema = T.StructType([*[f for f in self.rows if f.name in self.key], T.StructField("__new", self.sets), T.StructField("__at", self._at), T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
        new = self._changes(new_schema).where(F.col("batch") > since)
        if upto is not None:
            new = new.where(F.col("batch") <= upto)
        if buckets is not None:
            base, new = base.where(F.col("bucket").isin(buckets)), new.where(F.col("bucket").isin(buckets))
        names = [f.name for f in self.columns]
        sets = [c for c in self.sets.names if c in names and c not in self.key]
        old = base.select(*self.key, F.struct(*names, "__at").alias("__old"), F.lit(None).cast(self.sets).alias("__new"), F.lit(None).cast(self._at).alias("__at"), "bucket")
        both = old.unionByName(new.select(*self.key, F.lit(None).cast(old.schema["__old"].dataType).alias("__old"), "__new", "__at", "bucket"))
        one = both.where("bucket >= 0").groupBy(*self.key).agg(F.max("__old").alias("__old"), F.max_by("__new", "__at").alias("__new"), F.max("__at").alias("__at"))
        one = one.unionByName(both.where("bucket < 0").select(*one.columns))
        was = F.col("__old").getField("__at")
        later = F.col("__new").isNotNull() & (was.isNull() | (F.col("__at") > was))

        def value(c: str) -> Column:
            before = F.col("__old").getField(c)
            return F.when(later, F.col("__new").getField(c)).otherwise(before) if c in sets else before

        return one.select(*[(F.col(c) if c in self.key else value(c)).alias(c) for c in names], F.when(later, F.col("__at")).otherwise(was).alias("__at"))

    def _changes(self, schema: T.StructType) -> DataFrame:
        """The kept batches; none before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/changes")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/changes") if there else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as it is now."""
        return self._merged().drop("__at")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows of keys, reading only the folders that these are in."""
        buckets = [r.bucket for r in keys.select(self._bucket()).distinct().collect()]  # as many as there are folders at most
        return self._merged(buckets).drop("__at").join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def compact(self, upto: int) -> None:
        """Merge the batches up to a number into a new base; what it was made of is not read any more."""
        if upto > self._newest():
            self._write_base(self._merged(upto=upto), upto)


def upsert_stream(changes: DataFrame, kept: KeptTable, marks: str, compact_every: int = COMPACT) -> StreamingQuery:
    """Apply a stream of changes to a kept table, batch by batch, and merge it now and then."""

    def merge(batch: DataFrame, number: int) -> None:
        table = KeptTable(batch.sparkSession, kept.folder)
        table.apply(batch, number)
        if (number + 1) % compact_every == 0:
            table.compact(number)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", marks).trigger(availableNow=True).start()
