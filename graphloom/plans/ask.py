"""From bundles to nodes and edges, and from questions to answers: the operators in a row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.operators import context, entities, guard, rerank, search, traverse
from graphloom.operators.ports import Embedder, Expander, Extractor, Generator, HashEmbedder, Judge, Scorer
from graphloom.sources import bundle
from graphloom.sources.scratch import materialise


@dataclass
class Models:
    """What is plugged in; without a model the defaults decide. Vectors are as long as the settings say."""

    embedder: Embedder = field(default_factory=lambda: HashEmbedder(Settings.from_env().vector_size))
    expander: Expander | None = None
    judge: Judge | None = None
    extractor: Extractor | None = None
    scorer: Scorer | None = None
    generator: Generator | None = None


def ingest(spark: SparkSession, path: str, folder: str | None = None, models: Models | None = None) -> tuple[DataFrame, DataFrame]:
    """Read bundles, and write nodes (by type, with embeddings) and edges as Parquet under folder, or else under that of the
    settings; both as tables."""
    folder = folder or Settings.from_env().folder
    objects = bundle.read_bundle(spark, path)
    parsed = bundle.require_unique(bundle.upsert(bundle.parse_nodes(objects).limit(0), bundle.parse_nodes(objects), ["id"], ["external_id", "name"]))
    embedded = search.embed_missing(parsed.withColumn("embedding", F.lit(None).cast("array<float>")), (models or Models()).embedder)
    embedded.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    bundle.edges(nodes, bundle.parse_relationships(objects)).write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")
    return nodes, spark.read.parquet(f"{folder}/edges")


def ask(queries: DataFrame, nodes: DataFrame, edges: DataFrame, models: Models | None = None, top_k: int | None = None, shown: int | None = None) -> DataFrame:
    """(query_id, answer, context) of queries(query_id, query): guarded, filtered, searched, traversed, reranked, answered.

    A query that the guard stops is answered by its message. top_k nodes are searched for and shown of them are shown; both
    are as the settings say unless given.
    """
    m, given = models or Models(), Settings.from_env()
    top_k, shown = top_k or given.top_k, shown or given.shown
    guarded = guard.guard(queries.select("query_id", "query"), m.judge)
    live = guarded.where("allowed").select("query_id", "query")
    lists = materialise(entities.filter_lists(entities.filters(live, nodes, m.extractor)), "filters")
    hits = search.search(live, nodes, m.embedder, top_k, m.expander)
    rows = traverse.traverse(hits, nodes, edges).join(live, "query_id").join(lists, "query_id", "left")
    rows = rows.withColumn("filters", F.coalesce("filters", F.create_map().cast("map<string, array<string>>")))
    best = rerank.rerank(materialise(rows, "traversed"), shown, scorer=m.scorer).drop("pos", "filters").withColumnRenamed("rank", "pos")
    told = context.answers(live, materialise(best, "ranked"), lists, m.generator)
    stopped = guarded.where("not allowed").select("query_id", F.col("message").alias("answer"), F.lit(None).cast("string").alias("context"))
    return told.unionByName(stopped)
