"""Hybrid search over nodes: vector, full-text and exact legs, fused by reciprocal ranks.

Every leg answers a batch of queries (query_id, query) at once and returns (query_id, id, score, pos), pos from 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as X
from graphloom.functions import values as V
from graphloom.operators.ports import Embedder, Expander
from graphloom.operators.substrings import containing
from graphloom.sources.scratch import materialise

#: Queries in a batch are broadcast up to so many rows; a larger batch is cut by the caller or shuffled.
QUERIES = 10_000  # checked by a count before the hint is given
#: Shares that nodes are dealt into for a larger batch of vectors, at most; nodes in a share, about; those that are multiplied at a time.
SHARES, SHARE, PART = 512, 1 << 15, 1 << 13
#: Queries that are multiplied with a batch of nodes at a time, and digits of a score that count when scores are compared.
BLOCK, DIGITS = 512, 12
#: Folders that a written full-text index deals its terms into.
TERM_BUCKETS = 64


def few(queries: DataFrame) -> bool:
    return queries.limit(QUERIES + 1).count() <= QUERIES


def sized(queries: DataFrame) -> DataFrame:
    """Rows of a batch, with a broadcast hint if a count finds them few enough."""
    return F.broadcast(queries) if few(queries) else queries


def top(rows: DataFrame, k: int | None, order: list[Column], by: str = "query_id") -> DataFrame:
    """Rows with pos from 0 in the given order within by, the first k of them."""
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    # a bound on the row number itself is one that each task can apply before the shuffle
    rows = rows if k is None else rows.where(F.col("pos") <= k)
    return rows.withColumn("pos", F.col("pos") - 1)


# --- vectors ----------------------------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_norm(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("__norm", norm(F.col(vector)))


class _Best:
    """The k best (score, id) of each query that a task has seen."""

    def __init__(self, vectors: np.ndarray, k: int) -> None:
        self.q, self.k = vectors, k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * len(vectors)

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(self.q), BLOCK):
            scores = np.round(self.q[at : at + BLOCK] @ rows.T, DIGITS)
            last = np.partition(scores, -self.k, axis=1)[:, -self.k] if scores.shape[1] > self.k else np.full(len(scores), -np.inf)
            for j, (row, low) in enumerate(zip(scores, last, strict=True), at):
                near = np.flatnonzero(row >= low)
                score, of = np.concatenate([self.held[j][0], row[near]]), np.concatenate([self.held[j][1], ids[near]])
                order = np.lexsort((of, -score))[: self.k]
                self.held[j] = score[order], of[order]


def _matrix(vectors: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """The vectors of these numbers, all of that size, as rows."""
    return vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)


def _nearest(tables: dict[int, np.ndarray], numbers: dict[int, Sequence[int]], batches: Iterable[pa.RecordBatch], k: int) -> tuple[np.ndarray, tuple[pa.Array, pa.Array]]:
    """The k best of batches(id, vector, norm) for each query: its number, and (id, score). tables has a matrix of unit
    vectors for each size, numbers which queries these are."""
    best, ids_type = {d: _Best(t, k) for d, t in tables.items()}, pa.null()
    for batch in batches:
        ids_type = batch.column(0).type
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for d in set(sizes.tolist()) & set(best):
            at = np.flatnonzero(sizes == d)
            best[d].add(_matrix(vectors, at, d) / batch.column(2).to_numpy()[at][:, None], ids[at])
    out = [(numbers[d][j], score, of) for d, b in best.items() for j, (score, of) in enumerate(b.held)]
    which = np.concatenate([np.zeros(0, np.int32), *[np.full(len(s), j, np.int32) for j, s, _ in out]])
    return which, (pa.array([x for *_, o in out for x in o.tolist()], ids_type), pa.array(np.concatenate([np.zeros(0), *[s for _, s, _ in out]])))


def vector_search(queries: DataFrame, nodes: DataFrame, k: int = 10, normalized: bool = False, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k nodes of greatest cosine for each query(query_id, embedding): an exact scan, ties (to DIGITS digits) by id.

    Nodes without an embedding, or with a zero one or one of another length, are not found. normalized gives
    (1 + cosine) / 2. Nodes are read once: a batch of them is multiplied with all queries of their length, and each task
    keeps its own first k for a query. A batch of more than QUERIES queries is dealt into blocks, nodes into shares, and
    each block meets each share in the same way.
    """
    q = with_norm(queries.select("query_id", F.col("embedding").alias("__q")), "__q").withColumnRenamed("__norm", "__qn")
    n = with_norm(nodes.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v")), "__v")
    n, q = n.where("__norm > 0 and not isnan(__norm)"), q.where("__qn > 0 and not isnan(__qn)")
    asked = q.limit(QUERIES + 1).collect()
    schema = nodes.schema[id_col].dataType.simpleString()
    if len(asked) <= QUERIES:
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            by_size.setdefault(len(r["__q"]), []).append(i)
        tables = {d: np.array([asked[i]["__q"] for i in at], np.float64) / np.array([[asked[i]["__qn"]] for i in at]) for d, at in by_size.items()}
        spark = nodes.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            which, found = _nearest(tables, by_size, batches, k)
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(which), *found], ["query", "id", "score"])

        found = n.select("id", "__v", "__norm").mapInArrow(run, f"query int, id {schema}, score double")
        named = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
        scored = found.join(F.broadcast(named), "query").select("query_id", "id", "score")  # named: at most QUERIES rows
    else:  # each block of queries meets each share of nodes in a task, so that no pair becomes a row
        shares, blocks = max(1, min(SHARES, -(-nodes.count() // SHARE))), -(-q.count() // QUERIES)
        every, dealt = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))), lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        there = n.select(dealt("id", shares).alias("__share"), every(blocks).alias("__block"), "id", "__v", "__norm").groupBy("__share", "__block")
        each = q.select(every(shares).alias("__share"), dealt("query_id", blocks).alias("__block"), "query_id", "__q", "__qn").groupBy("__share", "__block")

        def meet(there: pa.Table, each: pa.Table) -> pa.Table:
            sizes, q = pa.compute.list_value_length(each["__q"]).to_numpy(), each["__q"].combine_chunks()
            at = {d: np.flatnonzero(sizes == d) for d in set(sizes.tolist())}
            tables = {d: _matrix(q, of, d) / each["__qn"].to_numpy()[of][:, None] for d, of in at.items()}
            which, found = _nearest(tables, at, there.select(["id", "__v", "__norm"]).combine_chunks().to_batches(PART), k)
            return pa.table([each["query_id"].take(pa.array(which)), *found], ["query_id", "id", "score"])

        scored = there.cogroup(each).applyInArrow(meet, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {schema}, score double")
    found = top(scored, k, [F.desc("score"), F.asc("id")])
    return found.withColumn("score", (1 + F.col("score")) / 2) if normalized else found


def embed(rows: DataFrame, embedder: Embedder, text_col: str, out: str = "embedding") -> DataFrame:
    """rows with a vector of the text in each, a batch at a time; null texts have none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields if f.name != out)}, {out} array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            there = pdf[text_col].notna()
            vectors = iter(embedder.embed(pdf.loc[there, text_col].tolist()))
            pdf[out] = [next(vectors) if x else None for x in there]
            yield pdf

    return rows.drop(out).mapInPandas(run, schema)


def embed_missing(nodes: DataFrame, embedder: Embedder) -> DataFrame:
    """nodes in which every row without an embedding gets one, of its name and description."""
    from graphloom.sources.bundle import embedding_text

    new = nodes.where("embedding is null").withColumn("__text", embedding_text(F.col("name"), F.col("description")))
    return nodes.where("embedding is not null").unionByName(embed(new, embedder, "__text").select(*nodes.columns))


# --- full text --------------------------------------------------------------------------------------------------------
TERM = "[a-z0-9]+"


def terms(text: Column) -> Column:
    return X.find_all(F.lower(X.blank(text)), TERM)


class FullText:
    """An index over fields of rows: postings(id, field, term, tf, dl) and totals(field, n, avgdl).

    It is worked out of the rows in each search, or written once and read by searches after that: postings lie in folders
    by a hash of their term, so that a search reads the folders of its own terms.
    """

    def __init__(self, rows: DataFrame, fields: list[str], id_col: str = "id") -> None:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("terms")) for f in fields])).alias("x")
        docs = rows.select(F.col(id_col).alias("id"), each).select("id", "x.field", "x.terms").where("size(terms) > 0")
        docs = docs.withColumn("dl", F.size("terms"))
        self.totals = docs.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        self.words = docs.select("id", "field", "dl", F.explode("terms").alias("term")).withColumn("bucket", _bucket("term"))
        self.counted = False

    def write(self, folder: str) -> FullText:
        """Write the index under folder; the written one."""
        spark = self.words.sparkSession
        counted = self.words.groupBy("bucket", "id", "field", "dl", "term").agg(F.count("*").alias("tf"))
        counted.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        self.totals.write.mode("overwrite").parquet(f"{folder}/totals")
        return FullText.read(spark, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> FullText:
        """An index that write() has left under folder."""
        self = cls.__new__(cls)
        self.words, self.totals, self.counted = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/totals"), True
        return self

    def search(self, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 of query(query_id, query), summed over fields and the query's distinct terms; the k best, ties by id. AND, OR
        and NOT in capitals say what must be there and what must not.

        Only the terms of the batch leave the rows, which are read once for them; what they leave is kept. Queries that ask
        for the same are searched for once.
        """
        asked, alike = asked_once(queries)
        only = sized(asked.select("term", _bucket("term").alias("bucket")).distinct())
        hit = self.words.join(only, ["bucket", "term"])
        if not self.counted:
            hit = hit.groupBy("id", "field", "dl", "term").agg(F.count("*").alias("tf"))
        hit = materialise(hit.select("id", "field", "dl", "term", F.col("tf").cast("long").alias("tf")), "postings")
        df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
        found = ranked(hit, df, self.totals, asked, k, k1, b).withColumnRenamed("query_id", "of")
        return found.join(sized(alike), "of").select("query_id", "id", "score", "pos")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, must, banned, need) of each distinct term of queries(query_id, query); need counts what must be there."""
    each = queries.select("query_id", F.explode(X.clauses(F.col("query"))).alias("c")).select("query_id", F.explode(terms(F.col("c.word"))).alias("term"), "c.occur")
    each = each.groupBy("query_id", "term").agg((F.max("occur") == 1).alias("must"), (F.min("occur") == -1).alias("banned"))
    return each.withColumn("need", F.sum(F.col("must").cast("int")).over(Window.partitionBy("query_id")).cast("int"))


def asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked_terms() of one query of all that ask for the same terms in the same way, and (query_id, of): whose terms each has."""
    each = asked_terms(queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "must", "banned", "need"))).alias("all"))
    each = materialise(each, "asked")
    first = materialise(each.groupBy("all").agg(F.min("query_id").alias("of")), "asked-once")
    return first.select(F.col("of").alias("query_id"), F.inline("all")), each.join(first, "all").select("query_id", "of")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What a term's frequency counts in a text of a length: more with tf, less with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def scored(hit: DataFrame, df: DataFrame, totals: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of hit(id, field, term, tf, dl) with df(field, term, df), totals(field, n, avgdl) and asked_terms()."""
    part = idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    weighed = hit.join(F.broadcast(totals), "field").join(sized(df), ["field", "term"]).select("id", "term", part.alias("part"))  # totals: a row for each field
    # dealt by node once: what a query meets in a node is summed, and its first nodes are ranked, where the node is
    weighed = weighed.repartition("id").groupBy("id", "term").agg(F.sum("part").alias("part"))
    must = F.coalesce(F.col("must").cast("int"), F.lit(0))
    met = weighed.join(sized(asked), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.sum(must).alias("held"), F.max("need").alias("need"), F.max("banned").alias("banned"))
    return met.where("held = need and not banned").select("query_id", "id", "score")


def ranked(hit: DataFrame, df: DataFrame, totals: DataFrame, asked: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """scored(), the k best of each query."""
    # sums in another order differ in their last digits, which must not decide between equal texts
    return top(scored(hit, df, totals, asked, k1, b), k, [F.desc(F.round("score", 9)), F.asc("id")])


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


# --- exact ------------------------------------------------------------------------------------------------------------
def exact_ids(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose external identifier a query names, by identifier; no limit."""
    asked = queries.select("query_id", F.explode(X.external_ids(F.col("query"))).alias("key"))
    found = nodes.select("id", F.upper("external_id").alias("key")).join(sized(asked), "key")
    return top(found.select("query_id", "id", "key", F.lit(1.0).alias("score")), None, [F.asc("key"), F.asc("id")]).drop("key")


def exact_names(queries: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Nodes whose name (3 characters or more) is part of a query, or one of whose aliases is a word of it; the first k by
    id. The words are an equi-join; names, which may begin inside a word, are joined by their rarest trigram."""
    asked = materialise(queries.select("query_id", "query"), "asked")
    texts = asked.select("query").distinct()
    # of the nodes that share a name, an alias or a text only the first k can be among the first k of a query
    first = lambda rows, by: top(rows.distinct(), k, [F.asc("id")], by).drop("pos")
    lower = texts.select("query", F.lower("query").alias("text"))
    names = materialise(first(nodes.where("length(name) >= 3").select("id", F.lower("name").alias("needle")), "needle"), "names")
    named = names.join(containing(names, lower), "needle").join(lower, "text")
    word = texts.select("query", F.explode(F.array_distinct(F.transform(X.find_all(F.col("query"), "[A-Za-z0-9_.-]+"), F.lower))).alias("key"))
    alias = nodes.select("id", F.explode(X.or_empty(F.col("aliases"))).alias("alias")).where("length(alias) >= 3")
    called = first(alias.select("id", F.lower("alias").alias("key")), "key").join(sized(word), "key")
    both = materialise(first(named.select("query", "id").unionByName(called.select("query", "id")), "query"), "named")
    return top(asked.join(both, "query").select("query_id", "id").distinct().withColumn("score", F.lit(1.0)), k, [F.asc("id")])


# --- fusion -----------------------------------------------------------------------------------------------------------
def fuse(legs: list[tuple[str, DataFrame]], types: DataFrame | None = None, requested: DataFrame | None = None, k: int = V.RRF_K, bonus: float = V.TYPE_BONUS) -> DataFrame:
    """(query_id, id, source_score, rrf_score, pos) over legs of kind vector, text or exact, in this order.

    A vector or text rank adds 1 / (k + pos + 1), an exact one 1 / (pos + 1). The source score is that of the first leg
    that found the node. types(id, node_type) with requested(query_id, types) adds the bonus to nodes of a type asked
    for. Order is by rrf_score, and of equals by leg and position of the first find.
    """
    rank = {"vector": 0, "text": 1, "exact": 2}
    each = [d.select("query_id", "id", "score", F.lit(rank[kind]).alias("leg"), "pos", (F.lit(1.0) / (F.col("pos") + (1 if kind == "exact" else k + 1))).alias("part")) for kind, d in legs]
    rows = each[0]
    for d in each[1:]:
        rows = rows.unionByName(d)
    fused = rows.groupBy("query_id", "id").agg(F.sum("part").alias("rrf_score"), F.min_by(F.struct(F.col("score").alias("s")), F.struct("leg", "pos")).getField("s").alias("source_score"), F.min(F.struct("leg", "pos")).alias("__first"))
    if types is not None and requested is not None:
        fused = fused.join(types.select("id", "node_type"), "id", "left").join(sized(requested.select("query_id", F.col("types").alias("__types"))), "query_id", "left")
        fused = fused.withColumn("rrf_score", F.col("rrf_score") + F.when(F.array_contains("__types", F.col("node_type")), F.lit(bonus)).otherwise(F.lit(0.0))).drop("__types", "node_type")
    return top(fused, None, [F.desc("rrf_score"), F.asc("__first"), F.asc("id")]).drop("__first")


def named_in_query(query: Column, name: Column, external_id: Column) -> Column:
    """Whether the compacted name or external identifier is part of the compacted query."""
    q = X.compact(query)
    part = lambda v: (X.compact(v) != "") & F.contains(q, X.compact(v))
    return part(name) | part(external_id)


def partial_match(query: Column, name: Column, external_id: Column) -> Column:
    """Whether a node only resembles an entity that the query names: another numbered group, or a name that shares four
    leading characters with a named one but is much longer or shorter. Never so if the query names the node."""
    n, named = X.compact(name), X.reference_tokens(query)
    numbered = n.rlike(r"^apt\d+$") & ~F.array_contains(named, n) & F.exists(named, lambda t: t.rlike(r"^apt\d+$"))
    near = lambda t: (t != "") & (t != n) & (X.common_prefix(t, n) >= 4) & (F.least(F.length(t), F.length(n)) / F.greatest(F.length(t), F.length(n)) < 0.8)
    return (n != "") & ~named_in_query(query, name, external_id) & (numbered | F.exists(named, near))


def expansions(queries: DataFrame, expander: Expander | None = None, most: int = V.EXPANSIONS) -> DataFrame:
    """(query_id, part, query): each query itself (part 0) and other wordings, at most so many in all.

    A wording that names identifiers which the query does not is left out, as are empty and repeated ones. An expander
    that fails adds nothing.
    """
    first = queries.select("query_id", F.lit(0).alias("part"), "query")
    if expander is None:
        return first

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for q, text in zip(pdf.query_id, pdf["query"], strict=True):
                try:
                    lines = expander.expand(text).strip().split("\n")
                except Exception:  # noqa: BLE001  whatever a plugged-in model raises
                    lines = []
                out += [(q, i, text, line) for i, line in enumerate(lines, 1)]
            yield pd.DataFrame(out, columns=["query_id", "part", "original", "query"])

    kind = queries.schema["query_id"].dataType.simpleString()
    new = queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, part int, original string, query string")
    new = new.withColumn("query", X.clean_expansion(F.col("query")))
    new = new.where((F.col("query") != "") & (F.lower("query") != F.lower("original")) & (F.size(F.array_except(X.referenced_ids(F.col("query")), X.referenced_ids(F.col("original")))) == 0))
    new = new.groupBy("query_id", F.lower("query").alias("__low")).agg(F.min_by("query", "part").alias("query"), F.min("part").alias("part"))
    new = top(new, most - 1, [F.asc("part")]).select("query_id", (F.col("pos") + 1).alias("part"), "query")
    return first.unionByName(new)


def _joined(found: DataFrame) -> DataFrame:
    """A leg over expanded queries as one list a query: the parts' lists one after another, repeats included."""
    rows = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.part").alias("part"), F.col("pos").alias("__pos"), "id", "score")
    return top(rows, None, [F.asc("part"), F.asc("__pos")]).drop("part", "__pos")


def search(queries: DataFrame, nodes: DataFrame, embedder: Embedder, top_k: int = 10, expander: Expander | None = None, index: FullText | None = None) -> DataFrame:
    """(query_id, id, name, external_id, node_type, source_score, rrf_score, pos) of the top_k nodes for each query.

    Blank and low-signal queries find nothing. Each wording searches by vector and full text for max(3 top_k, 20) nodes;
    the query itself by identifiers and names. Partial matches are dropped before the cut.
    """
    live = queries.where((F.trim(X.blank(F.col("query"))) != "") & ~X.low_signal(F.col("query")))
    each = max(3 * top_k, 20)
    parts = materialise(expansions(live, expander).select(F.struct("query_id", "part").alias("query_id"), "query"), "wordings")
    index = index or FullText(nodes, ["name", "description", "external_id"])
    vector = materialise(_joined(vector_search(materialise(embed(parts, embedder, "query"), "vectors"), nodes, each)), "vector-leg")
    text = materialise(_joined(index.search(parts, each)), "text-leg")
    ids, names = exact_ids(live, nodes), exact_names(live, nodes)
    exact = top(ids.withColumn("__leg", F.lit(0)).unionByName(names.withColumn("__leg", F.lit(1))).withColumnRenamed("pos", "__pos"), None, [F.asc("__leg"), F.asc("__pos")]).drop("__leg", "__pos")
    requested = live.select("query_id", X.node_types(F.col("query"), in_search=True).alias("types"))
    fused = fuse([("vector", vector), ("text", text), ("exact", exact)], nodes, requested).withColumnRenamed("pos", "__pos")
    found = fused.join(nodes.select("id", "name", "external_id", "node_type"), "id").join(sized(live.select("query_id", "query")), "query_id")
    found = found.where(~partial_match(F.col("query"), F.col("name"), F.col("external_id")))
    return top(found, top_k, [F.asc("__pos")]).select("query_id", "id", "name", "external_id", "node_type", "source_score", "rrf_score", "pos")
