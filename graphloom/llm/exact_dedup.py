"""Exact deduplication as a stateful stream.

Texts are normalised into a content table; a stream reads its identifiers and keeps, for each digest, the smallest
identifier, the locator of that content and the number of rows, in a disk-backed (RocksDB) state store that never
expires. Every row that hits a digest seen before is then checked against the kept content byte by byte; rows that share
a digest but not the bytes are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.base import join_counted, materialise, meet_by_number, scratch, sized_broadcast

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: All stores of an executor share this memory; buffers and files are small, since an executor holds many stores.
MEMORY = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    # else every store sets 4 MB of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows for each state store, and stores at least. Their number is fixed when a stream begins.
STORE_ROWS, STORES = 1_000_000, 12
#: Rows of a group whose bytes one task compares, on average at most.
SALTED = 1000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(content: str, schema: StructType, files_per_batch: int, stores: int) -> DataFrame:
    """(digest, keep_id, at, group_size) after the stream has read the whole content table, in batches of its files.

    The stream runs in a session of its own, so that its settings are seen by no other query.
    """
    spark = SparkSession.active()
    own = spark.newSession()
    updates, marks = scratch(spark, "dedup-updates"), scratch(spark, "dedup-stream")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure writes its own folder anew
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    for k, v in {STORE: ROCKSDB, **MEMORY, "spark.sql.shuffle.partitions": str(stores)}.items():
        own.conf.set(k, v)
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(content)
    rows = rows.select("digest", "id", F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("first"), "rid").alias("at"))
    state = rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.min("at").alias("at"), F.count("*").alias("group_size"))
    stream = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    stream.awaitTermination()
    empty = "digest string, keep_id long, at struct<first: long, rid: long>, group_size long"
    if not stream.lastProgress and not stream.recentProgress:
        return spark.createDataFrame([], empty)
    seen = spark.read.schema(f"{empty}, batch int").parquet(updates)
    return seen.groupBy("digest").agg(F.max_by(F.struct("keep_id", "at", "group_size"), "batch").alias("s")).select("digest", "s.*")


class Groups:
    """Rows of docs in a content table, the state of their digests, and the digests that different texts share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int, carry: list[str]) -> None:
        spark = docs.sparkSession
        path = scratch(spark, "dedup-content")
        text = F.col(text_col)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), digest(normalised(text)).alias("digest"), F.struct(*carry, F.lit(0).alias("__")).alias("carried"), F.monotonically_increasing_id().alias("rid"))
        rows.write.option("compression", "zstd").parquet(path)
        schema = rows.schema
        self.content = spark.read.schema(schema).parquet(path)
        self.rows = self.content.count()
        stores = max(STORES, -(-self.rows // STORE_ROWS))
        self.state = materialise(digest_state(path, schema, files_per_batch, stores), "dedup-state")
        # hits: rows of a digest that more than one row has. Keys are joined; only the hits' own texts move after that
        repeated = self.state.where("group_size > 1").select("digest", "group_size", F.col("at.rid").alias("first"), F.ceil(F.col("group_size") / SALTED).alias("salts"))
        found = join_counted(self.content.select("rid", "digest"), repeated, "digest", "group_size", self.rows).select("rid", "first", "salts")
        self.hits = materialise(found, "dedup-hits")
        hits = meet_by_number(self.content.select("rid", "digest", "text"), self.hits, "dedup-verdicts").withColumn("norm", normalised(F.col("text")))
        # a kept text meets its hits in as many tasks as the group has thousands of rows
        keeper = hits.where("rid = first").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
        later = hits.where("rid <> first")
        wrong = later.select("digest", F.pmod("rid", "salts").alias("salt"), "norm").join(keeper, ["digest", "salt"]).where("norm <> kept_norm").select("digest").distinct()
        self.wrong = materialise(wrong, "dedup-collisions")
        self.collisions = self.wrong.count()

    def without_collisions(self, rows: DataFrame) -> DataFrame:
        return rows.join(sized_broadcast(self.wrong, self.collisions), "digest", "left_anti") if self.collisions else rows

    def collided(self) -> DataFrame:
        """Rows of shared digests with what their own text's group keeps."""
        counted = self.state.join(sized_broadcast(self.wrong, self.collisions), "digest").select("digest", "group_size")
        found = join_counted(self.content.select("rid", "digest"), counted, "digest", "group_size", self.rows, self.collisions).select("rid")
        rows = meet_by_number(self.content.select("rid", "id", "digest", "text"), found, "dedup-shared").withColumn("norm", normalised(F.col("text"))).drop("text")
        at = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("first"), "rid")
        sizes = rows.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"), F.min(at).alias("at"))
        return rows.join(sizes, ["digest", "norm"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 32) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) of every row.

    Equal texts (after normalised()) are one group; its smallest id stays. Null texts count as empty. A null id never
    stays while its group has another; in a group of null ids only, keep_id is null and all are kept, as they cannot be
    told apart. Rows that repeat an id and text are all kept or all dropped, and each counts in group_size. digest may be
    any function of the text; equal digests of different texts are told apart by their bytes.
    """
    found = Groups(docs, id_col, text_col, digest, files_per_batch, [])
    columns = ["id", "digest", "keep_id", "group_size"]
    state = found.state.select("digest", "keep_id", "group_size", F.col("group_size").alias("n"))
    out = join_counted(found.content.select("id", "digest"), state, "digest", "n", found.rows)
    out = found.without_collisions(out).select(*columns)
    if found.collisions:
        out = out.unionByName(found.collided().select(*columns))
    return out.select(*columns, F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 32) -> DataFrame:
    """docs with one row of each group of equal texts: that of the smallest id, of rows that repeat it just one.

    Nulls are as in exact_groups(), but of a group of null ids only, one row stays too.
    """
    found = Groups(docs, id_col, text_col, digest, files_per_batch, docs.columns)
    # state tells the row that stays of each group; rows of shared digests are told by their texts
    stays = found.without_collisions(found.state.select("digest", F.col("at.rid").alias("rid"))).select("rid")
    if found.collisions:
        stays = stays.unionByName(found.collided().where("rid = at.rid").select("rid"))
    kept = meet_by_number(found.content, stays, "dedup-stays")
    return kept.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])
