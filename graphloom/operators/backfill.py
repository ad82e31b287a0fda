"""Embeddings kept up to date: only texts that are new or have changed go to the embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ports import Embedder
from graphloom.operators.search import embed
from graphloom.sources.bundle import embedding_text
from graphloom.sources.scratch import materialise

STORED = "hash string, embedding array<float>, run int"


class EmbeddingStore:
    """Vectors by content hash under a folder, a folder for each run. A vector belongs to a text, so that equal texts share
    one, a text that comes back finds its own again, and a node whose text has changed finds none."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _before(self, run: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(STORED).parquet(self.folder).where(F.col("run") < run) if there else self.spark.createDataFrame([], STORED)

    def update(self, nodes: DataFrame, embedder: Embedder, run: int) -> DataFrame:
        """nodes with embedding and embedded, the run that made it, of their name and description.

        Runs are numbered upwards; one that is done again reads only those before it and writes the same vectors anew, so
        that each text's vector is there once. A node without a name and description has no vector.
        """
        rows = materialise(nodes.drop("embedding", "embedded").withColumn("__text", embedding_text(F.col("name"), F.col("description"))).withColumn("__hash", F.sha2("__text", 256)), "backfill-nodes")
        stored = self._before(run)
        new = rows.where("__text is not null").groupBy(F.col("__hash").alias("hash")).agg(F.min("__text").alias("text")).join(stored.select("hash"), "hash", "left_anti")
        made = embed(new, embedder, "text").select("hash", "embedding")
        made.write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        all_ = self.spark.read.schema(STORED).parquet(self.folder).where(F.col("run") <= run)
        return rows.join(all_.select(F.col("hash").alias("__hash"), "embedding", F.col("run").alias("embedded")), "__hash", "left").drop("__hash", "__text")
