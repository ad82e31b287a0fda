"""A persisted vector index: vectors in folders by their nearest centroid, read by search as far as it needs them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.search import DIGITS, norm, top
from graphloom.sources.scratch import materialise

#: Vectors that centroids are learned from, at most, drawn by hash over all rows, and rounds of learning.
SAMPLE, ROUNDS = 8192, 8
#: Lists at most, and vectors in a list's shard and queries in a block, on average at most: what one task multiplies.
LISTS, SHARD, BLOCK = 4096, 4096, 2048
#: Queries whose recall is audited at most.
AUDITED = 64
#: How far a bound is trusted.
SLACK = 1e-9


def learn(vectors: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors: assignment by greatest cosine, means, empty ones drawn anew."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(vectors))
    centres = vectors[rng.choice(len(vectors), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = size[:, 0] < 1e-12
        centres = np.where(empty[:, None], vectors[rng.choice(len(vectors), lists)], sums / np.maximum(size, 1e-12))
    return centres


def _unit(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of rows with a vector that is sound and not zero, as unit vectors in double precision."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = rows.withColumn("n", norm(F.col("v"))).where("n > 0 and n < double('infinity')")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"), F.size("v").alias("dim"))


class VectorIndex:
    """Under a folder: vectors(id, v, list, shard) in folders by list, lists(list, dim, centre, least cosine, rows, shards)
    and about(id_type). A list holds vectors of one length; lengths that the sample has not met have a list without a centroid."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.lists = spark.read.parquet(f"{folder}/lists")
        kind = spark.read.parquet(f"{folder}/about").first().id_type
        self.vectors = spark.read.schema(f"id {kind}, v array<double>, shard int, list int").parquet(f"{folder}/vectors")
        #: a row for each list, LISTS for each length at most
        self.held = self.lists.orderBy("list").collect()

    @classmethod
    def build(cls, rows: DataFrame, folder: str, id_col: str = "id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Write the index of rows; lists defaults to the square root of their number. Vectors that are null, zero or hold
        nulls or non-finite numbers are left out; ids that repeat are vectors of their own."""
        spark = rows.sparkSession
        unit = materialise(_unit(rows, id_col, vector_col), "index-rows")
        total = unit.count()
        lists = min(lists or math.isqrt(total) + 1, LISTS)
        mark = F.xxhash64("id", "v")
        drawn = unit.groupBy(F.pmod(mark, F.lit(sample))).agg(F.min_by(F.struct("v", "dim"), mark).alias("s")).select("s.*").collect()
        by_dim: dict[int, list] = {}
        for r in drawn:
            by_dim.setdefault(r.dim, []).append(r.v)
        centres, first, tables = [], 0, {}
        for dim, vectors in sorted(by_dim.items()):
            found = learn(np.array(vectors), lists)
            tables[dim] = (first, found)
            centres += [(first + i, c.tolist()) for i, c in enumerate(found)]
            first += len(found)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at, near = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
                for dim, some in pdf.groupby("dim").indices.items():
                    if dim not in tables:
                        at[some], near[some] = -dim - 1, -1
                        continue
                    begin, table = tables[dim]
                    cosines = np.stack(pdf.v.iloc[some].to_numpy()) @ table.T
                    best = cosines.argmax(axis=1)
                    at[some], near[some] = begin + best, cosines[np.arange(len(some)), best]
                pdf["list"], pdf["near"] = at, near
                yield pdf

        kind = unit.schema["id"].dataType.simpleString()
        dealt = materialise(unit.mapInPandas(assign, f"id {kind}, v array<double>, dim int, list int, near double"), "index-lists")
        sizes = dealt.groupBy("list", "dim").agg(F.min("near").alias("least"), F.count("*").alias("rows")).withColumn("shards", F.ceil(F.col("rows") / SHARD).cast("int"))
        known = spark.createDataFrame(centres, "list int, centre array<double>")
        sizes.join(F.broadcast(known), "list", "left").write.mode("overwrite").parquet(f"{folder}/lists")  # known: LISTS rows for each length
        shards = F.broadcast(spark.read.parquet(f"{folder}/lists").select("list", "shards"))
        out = dealt.join(shards, "list").withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")).select("id", "v", "list", "shard")
        spark.createDataFrame([(kind,)], "id_type string").write.mode("overwrite").parquet(f"{folder}/about")
        out.repartition("list", "shard").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/vectors")
        return cls(spark, folder)

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, v, list, rank, bound) of every list that has vectors of the query's length: rank by the cosine of the
        centroid, bound on the cosine of any vector in it."""
        kind = queries.schema["query_id"].dataType.simpleString()
        by_dim: dict[int, list] = {}
        for r in self.held:
            by_dim.setdefault(r.dim, []).append(r)
        tables = {d: (np.array([r.list for r in rs]), np.array([r.centre or [0.0] * d for r in rs]), np.arccos(np.clip([r.least for r in rs], -1, 1))) for d, rs in by_dim.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, v in enumerate(batch.column("v")):
                    if len(v) not in tables:
                        continue
                    lists, centres, wide = tables[len(v)]
                    cosine = np.clip(centres @ v.values.to_numpy(zero_copy_only=False), -1, 1)
                    bound = np.cos(np.maximum(np.arccos(cosine) - wide - SLACK, 0))
                    rank = np.empty(len(lists), np.int32)
                    rank[np.argsort(-cosine, kind="stable")] = np.arange(len(lists))
                    mine = batch.column("query_id").take(pa.array(np.full(len(lists), i)))
                    yield pa.RecordBatch.from_arrays([mine, pa.array(lists, pa.int32()), pa.array(rank), pa.array(bound)], ["query_id", "list", "rank", "bound"])

        return queries.select("query_id", "v").mapInArrow(run, f"query_id {kind}, list int, rank int, bound double")

    def _probe(self, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): of each shard of the lists asked(query_id, list) the first k of each query."""
        blocks = max(1, math.ceil(queries.count() / BLOCK))
        split = self.spark.createDataFrame([(r.list, r.shards) for r in self.held], "list int, shards int")
        q = asked.join(queries, "query_id").join(F.broadcast(split), "list")  # split: LISTS rows for each length
        q = q.select("query_id", "v", "list", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        n = self.vectors.join(asked.select("list").distinct(), "list", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        ids, kind = self.vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

        def matrix(rows: pa.Table) -> np.ndarray:
            v = rows["v"].combine_chunks()
            return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

        def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
            asked, found, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if len(left) and len(right):
                scores = np.round(matrix(left) @ matrix(right).T, DIGITS)
                # ties by id, in the order that the ids' own type has
                order = np.argsort(pc.rank(right["id"].combine_chunks(), tiebreaker="dense").to_numpy(), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                low = np.partition(scores, -k, axis=1)[:, -k] if len(right) > k else np.full(len(left), -np.inf)
                for i, (row, least) in enumerate(zip(scores, low, strict=True)):
                    near = np.flatnonzero(row >= least)
                    near = near[np.lexsort((place[near], -row[near]))[:k]]
                    asked.append(np.full(len(near), i))
                    found.append(near)
                    best.append(row[near])
            columns = [left["query_id"].take(pa.array(np.concatenate(asked))), right["id"].take(pa.array(np.concatenate(found))), pa.array(np.concatenate(best))]
            return pa.table(columns, ["query_id", "id", "score"])

        key = ["list", "shard", "block"]
        return q.groupBy(*key).cogroup(n.groupBy(*key)).applyInArrow(multiply, f"query_id {kind}, id {ids}, score double")

    def _queries(self, queries: DataFrame) -> DataFrame:
        unit = _unit(queries, "query_id", "embedding")
        return materialise(unit.select(F.col("id").alias("query_id"), "v"), "index-queries")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
        """The k nodes of greatest cosine of queries(query_id, embedding), exactly as a scan finds them; ties by id.

        The nearest lists of each query are read first; then all others whose bound says that they might hold a vector as
        near as the k-th found. What no bound rules out is read: no result is missed.
        """
        queries = self._queries(queries)
        order = [F.desc("score"), F.asc("id")]
        bounds = materialise(self._bounds(queries), "index-bounds")
        first = materialise(self._probe(bounds.where(F.col("rank") < probes).select("query_id", "list"), queries, k), "index-first")
        last = top(first, k, order).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        left = bounds.where(F.col("rank") >= probes).join(last, "query_id", "left")
        more = left.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("bound") >= F.col("last") - SLACK)).select("query_id", "list")
        return top(first.unionByName(self._probe(more, queries, k)), k, order).select("query_id", "id", "score", "pos")

    def nearest(self, queries: DataFrame, k: int = 10, recall: float = 0.95, probes: int = 2, audited: int = AUDITED) -> DataFrame:
        """The k nodes found in the nearest lists only, with the audited recall as a column.

        Lists are doubled until queries of the audit, drawn by hash, have this share of their true first k, or all lists are
        read. Without a query that finds anything, the recall is 1.
        """
        queries = self._queries(queries)
        order = [F.desc("score"), F.asc("id")]
        bounds = materialise(self._bounds(queries), "index-bounds")
        most = max((len([r for r in self.held if r.dim == d]) for d in {r.dim for r in self.held}), default=0)
        drawn = materialise(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(audited), "index-audited")
        truth = materialise(self.search(drawn.select("query_id", F.col("v").alias("embedding")), k).select("query_id", "id"), "index-truth")
        wanted = truth.count()
        while True:
            near = bounds.where(F.col("rank") < probes).select("query_id", "list")
            mine = near.join(drawn.select("query_id"), "query_id", "left_semi")
            hits = top(self._probe(mine, drawn, k), k, order).join(truth, ["query_id", "id"]).count()
            share = hits / wanted if wanted else 1.0
            if share >= recall or probes >= most:
                break
            probes *= 2
        return top(self._probe(near, queries, k), k, order).select("query_id", "id", "score", "pos", F.lit(share).alias("recall"), F.lit(min(probes, most)).alias("probes"))
