"""Questions as a stream: each batch is answered against one version of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.ask import Models, ask


def publish(nodes: DataFrame, edges: DataFrame, folder: str, version: int) -> None:
    """Write a version of the graph; it counts once its row is there."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/nodes/version={version}")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges/version={version}")
    nodes.sparkSession.createDataFrame([(version,)], "done long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/version={version}")


def newest(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/versions").agg(F.max("done")).first()[0]


def graph(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes/version={version}"), spark.read.parquet(f"{folder}/edges/version={version}")


def answer_stream(questions: DataFrame, folder: str, out: str, marks: str, models: Models | None = None, top_k: int | None = None, shown: int | None = None) -> StreamingQuery:
    """Answer a stream of questions(query_id, query) into out/answers, a folder for each batch, with the graph's version.

    A batch takes the newest version there is when it first runs and notes it before it answers; if it runs again after a
    failure, it takes the noted one, so that every question has one answer of one version.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        note = f"{out}/versions/batch={number}"
        try:
            version = spark.read.schema("version long").parquet(note).first().version
        except Exception as error:  # noqa: BLE001  a path that is not there is an analysis error without a type of its own
            if "PATH_NOT_FOUND" not in str(error):
                raise
            version = newest(spark, folder)
            spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(note)
        told = ask(batch.select("query_id", "query"), *graph(spark, folder, version), models, top_k, shown)
        told.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/answers/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", marks).trigger(availableNow=True).start()
