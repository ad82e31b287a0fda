"""Embedding near-duplicates over hierarchical navigable small-world graphs.

Vectors of a label are dealt into shards of bounded size, each with a graph of its own, kept as a table. Every vector
queries the graph of every shard of its label. Equal vectors of a shard are one node with a weight. The beam of a meeting's
searches widens until an audit passes: queries that are also compared with all vectors of the shard find enough of their
true neighbours and all of their true links. Every link is verified by its cosine in double precision.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import Links, components, materialise

#: Vectors in a shard, on average at most.
SHARD = 4096
#: Neighbours a node chooses in a layer (twice as many in the lowest), and the beam that finds them.
CHOSEN, BUILD_BEAM = 16, 64
#: The first beam of a search; queries that an audit draws from all, and as many of the heaviest at most; how many true
#: neighbours of each it asks for, and the recall of these that it asks for. Of links it asks for all.
BEAM, AUDITED, NEIGHBOURS, RECALL = 24, 48, 10, 0.95
#: Tasks at most in a stage that builds or asks.
TASKS = 20_000
#: How far below the threshold a search still follows neighbours.
SLACK = 0.06


class Graph:
    """A navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 7) -> None:
        self.v, n = np.ascontiguousarray(vectors, np.float32), len(vectors)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(CHOSEN)).astype(int), 8)
        self.near = [np.full((n, 2 * CHOSEN if k == 0 else CHOSEN), -1, np.int32) for k in range(self.level.max(initial=0) + 1)]
        self.count = [np.zeros(n, np.int32) for _ in self.near]
        self.seen, self.mark = np.zeros(n, np.int32), 0
        self.entry, self.top = 0, int(self.level[0]) if n else 0
        for i in range(1, n):
            self._insert(i)

    def dump(self) -> bytes:
        """The graph without its vectors."""
        out = io.BytesIO()
        np.savez(out, top=[self.entry, self.top], **{f"near{k}": x for k, x in enumerate(self.near)}, **{f"count{k}": x for k, x in enumerate(self.count)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Graph:
        held, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.v, (self.entry, self.top) = np.ascontiguousarray(vectors, np.float32), held["top"].tolist()
        layers = sum(k.startswith("near") for k in held.files)
        self.near, self.count = [held[f"near{k}"] for k in range(layers)], [held[f"count{k}"] for k in range(layers)]
        self.seen, self.mark = np.zeros(len(self.v), np.int32), 0
        return self

    def _fresh(self, node: int, layer: int) -> np.ndarray:
        near = self.near[layer][node, : self.count[layer][node]]
        near = near[self.seen[near] != self.mark]
        self.seen[near] = self.mark
        return near

    def search(self, q: np.ndarray, entries: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The beam best (similarity, node) found in a layer, best first; self.seen holds what was reached."""
        self.mark += 1
        self.seen[entries] = self.mark
        best = [(s, e) for s, e in zip((self.v[entries] @ q).tolist(), entries, strict=True)]
        open_ = [(-s, e) for s, e in best]
        heapq.heapify(best)
        heapq.heapify(open_)
        while open_:
            s, node = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = self._fresh(node, layer)
            if not len(near):
                continue
            for s, e in zip((self.v[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (s, e))
                    heapq.heappush(open_, (-s, e))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, e))
                    heapq.heappush(open_, (-s, e))
        return sorted(best, reverse=True)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the new node than to one chosen before; then the nearest of the rest."""
        nodes = [e for _, e in found]
        among = self.v[nodes] @ self.v[nodes].T
        kept, rest = [], []
        for k, (s, _) in enumerate(found):
            if len(kept) == most:
                break
            (kept if not kept or s > among[k, kept].max() else rest).append(k)
        return [nodes[k] for k in (kept + rest)[:most]]

    def _insert(self, i: int) -> None:
        q, level, entries = self.v[i], int(self.level[i]), [self.entry]
        for layer in range(self.top, level, -1):
            entries = [self.search(q, entries, 1, layer)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            found = self.search(q, entries, BUILD_BEAM, layer)
            entries = [e for _, e in found]
            near, count = self.near[layer], self.count[layer]
            chosen = self._diverse(found, CHOSEN)
            near[i, : len(chosen)], count[i] = chosen, len(chosen)
            for e in chosen:
                if count[e] < near.shape[1]:
                    near[e, count[e]] = i
                    count[e] += 1
                else:
                    others = np.append(near[e], i)
                    sims = (self.v[others] @ self.v[e]).tolist()
                    near[e] = self._diverse(sorted(zip(sims, others.tolist(), strict=True), reverse=True), near.shape[1])
        if level > self.top:
            self.entry, self.top = i, level

    def _beam(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        entries = [self.entry]
        for layer in range(self.top, 0, -1):
            entries = [self.search(q, entries, 1, layer)[0][1]]
        return self.search(q, entries, beam, 0)

    def nearest(self, q: np.ndarray, beam: int, k: int) -> np.ndarray:
        """The k nearest nodes that a beam search finds."""
        return np.array([e for _, e in self._beam(q, beam)[:k]], np.int64)

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Nodes of similarity least or more: a beam search, then all that neighbours of near nodes lead to."""
        found = self._beam(q, beam)
        edge = np.array([e for s, e in found if s >= least - SLACK], np.int64)
        hits = [np.array([e for s, e in found if s >= least], np.int64)]
        # what a search has seen and left behind is looked at once more
        self.mark += 1
        self.seen[edge] = self.mark
        while len(edge):
            near = self.near[0][edge].ravel()
            near = np.unique(near[near >= 0])
            near = near[self.seen[near] != self.mark]
            self.seen[near] = self.mark
            sims = self.v[near] @ q
            hits.append(near[sims >= least])
            edge = near[sims >= least - SLACK]
        return np.unique(np.concatenate(hits))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def exact(vectors: np.ndarray, queries: np.ndarray, least: float, block: int = 256) -> list[np.ndarray]:
    """For each query the nodes of cosine least or more, by products of blocks."""
    out = []
    for k in range(0, len(queries), block):
        x, y = np.nonzero(queries[k : k + block] @ vectors.T >= least)
        out += np.split(y, np.searchsorted(x, np.arange(1, len(queries[k : k + block]))))
    return out


def links_between(graph: Graph, vectors: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of cosine least or more, vectors and queries being double unit vectors. See audited_links()."""
    return audited_links(graph, vectors, queries, least, beam, recall)[:2]


def audited_links(graph: Graph, vectors: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, recall: float = RECALL, weights: np.ndarray | None = None, compare_all: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query, node) of cosine least or more; how many true neighbours and links the audit asked for, and how many of these
    the search found.

    The audit compares AUDITED queries spread over all, and as many of the heaviest nodes of copies, with all vectors: the
    first NEIGHBOURS of each always exist, so that no audit is empty. The beam doubles until the searches of these queries
    find the share recall of their neighbours and every link; then all queries search with it. Only if a beam of the whole
    shard does not do, or with compare_all, all queries are compared instead.
    """
    slack = 1e-5  # of single against double precision
    n, k = len(queries), min(NEIGHBOURS, len(vectors))
    heavy = np.zeros(0, int) if weights is None else np.argsort(-weights, kind="stable")[:AUDITED]
    asked = np.unique(np.concatenate([np.linspace(0, n - 1, AUDITED).astype(int), heavy[weights[heavy] > 1] if len(heavy) else heavy]))
    cosines = queries[asked] @ vectors.T
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    true = [np.flatnonzero(c >= least - 1e-9) for c in cosines]
    want = near.size + sum(map(len, true))
    single, found = queries.astype(np.float32), None
    while not compare_all and beam < len(vectors):
        neighbours = sum(len(np.intersect1d(a, graph.nearest(single[q], beam, k))) for q, a in zip(asked, near, strict=True))
        links = sum(len(np.intersect1d(a, graph.within(single[q], least - slack, beam))) for q, a in zip(asked, true, strict=True))
        if neighbours >= recall * near.size and links == sum(map(len, true)):
            hits, found = neighbours + links, [graph.within(q, least - slack, beam) for q in single]
            break
        beam *= 2
    if found is None:
        hits, found = want, exact(vectors, queries, least - 1e-9)
    x = np.repeat(np.arange(len(queries)), [len(f) for f in found])
    y = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    ok = np.zeros(len(x), bool)
    for k in range(0, len(x), 1 << 18):
        part = slice(k, k + (1 << 18))
        ok[part] = np.einsum("ij,ij->i", queries[x[part]], vectors[y[part]]) >= least
    return x[ok], y[ok], want, hits


def near_duplicates(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, report: dict | None = None, compare_all: bool = False) -> DataFrame:
    """(id, n_links, component) of every row: how many other rows of its label have a cosine of least or more to it, and
    the smallest id that links reach, its own included.

    Vectors that are null, empty, zero or hold null or non-finite components, vectors under a null label, and vectors of
    different lengths link with nothing. Rows that repeat an id are vectors of their own. A row with a null id links like
    others but names no component; the component is null if no row of it has an id. A report is given the number of true
    links that the audits knew of as "wanted", how many of them the searches found as "found", and their ratio as "recall".
    """
    x = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), x.alias("vector"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "hnsw-rows")
    big = float(np.finfo(np.float64).max)
    sound = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) <= big) & ~F.isnan(c)) & F.exists("vector", lambda c: c != 0)
    good = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound).withColumn("dim", F.size("vector"))
    sizes = materialise(good.groupBy("label", "dim").count().withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("count") / shard)).cast("int")), "hnsw-sizes")
    shards, meetings = sizes.agg(F.sum("shards"), F.sum(F.col("shards") * (F.col("shards") + 1) / 2)).first()
    # work, not bytes, is to be spread: numbers given to repartition() are kept, where keys alone would be coalesced
    tasks = lambda n: int(min(max(1, 4 * (n or 0)), TASKS))
    good = good.join(sizes.select("label", "dim", "shards"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        v = np.stack(pdf.vector.to_numpy())
        v = unit(v / np.abs(v).max(axis=1, keepdims=True))
        # equal vectors are one node; rows stand in the order of their nodes
        _, first, node, weights = np.unique(v, axis=0, return_index=True, return_inverse=True, return_counts=True)
        rids = pdf.rid.to_numpy(np.int64)[np.argsort(node.ravel(), kind="stable")]
        v = v[first]
        return pd.DataFrame({"group": [pdf.group.iloc[0]], "shard": [pdf.shard.iloc[0]], "shards": [pdf.shards.iloc[0]], "rids": [rids.tobytes()], "weights": [weights.astype(np.int64).tobytes()], "dim": [v.shape[1]], "vectors": [v.tobytes()], "graph": [Graph(v).dump()]})

    group = F.concat_ws("\x00", F.col("label").cast("string"), F.col("dim").cast("string")).alias("group")
    index = good.select(group, "rid", "vector", "shard", "shards").repartition(tasks(shards), "group", "shard").groupBy("group", "shard").applyInPandas(build, "group string, shard int, shards int, rids binary, weights binary, dim int, vectors binary, graph binary")
    index = materialise(index, "hnsw-index")

    # a meeting is of the queries of one shard and the graph of another or the same; each pair of shards meets once
    graphs = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("shard")))).select("group", "q", F.col("shard").alias("x"), "rids", "weights", "dim", "vectors", "graph")
    asks = index.where("shard < shards - 1").withColumn("x", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)))
    asks = asks.select("group", F.col("shard").alias("q"), "x", "rids", "weights", "dim", "vectors", F.lit(None).cast("binary").alias("graph"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {r.graph is not None: r for r in pdf.itertuples()}
        mine = held[True]
        opened = lambda r: (np.frombuffer(r.vectors).reshape(-1, r.dim), np.frombuffer(r.rids, np.int64), np.frombuffer(r.weights, np.int64))
        v, rids, weights = opened(mine)
        asked = held.get(False)
        qv, qr, qw = (v, rids, weights) if asked is None else opened(asked)
        a, b, want, hits = audited_links(Graph.load(mine.graph, v), v, qv, least, weights=qw, compare_all=compare_all)
        first, q_first = np.cumsum(weights) - weights, np.cumsum(qw) - qw
        links = Links()
        if asked is None:  # one shard: a link found from either end counts once for each end
            pairs = np.unique(np.minimum(a, b) * len(v) + np.maximum(a, b))
            a, b = pairs // len(v), pairs % len(v)
            a, b = a[a != b], b[a != b]
            counts = np.bincount(a, weights[b], len(v)) + np.bincount(b, weights[a], len(v))
            if least <= 1:  # rows of a node link with each other
                counts += weights - 1
                links.add(np.repeat(rids[first], weights), rids)
            counts = np.repeat(counts.astype(np.int64), weights)
            ends, counts = rids[counts > 0], counts[counts > 0]
        else:
            n, m = np.bincount(a, weights[b], len(qv)), np.bincount(b, qw[a], len(v))
            n, m = np.repeat(n.astype(np.int64), qw), np.repeat(m.astype(np.int64), weights)
            ends, counts = np.concatenate([qr[n > 0], rids[m > 0]]), np.concatenate([n[n > 0], m[m > 0]])
        links.add(qr[q_first[a]], rids[first[b]])
        x, y = links.folded()
        # -1 marks counts of links, -2 an audit
        return pd.DataFrame({"a": np.concatenate([ends, x, [want]]), "b": np.concatenate([np.full(len(ends), -1), y, [-2]]), "n": np.concatenate([counts, np.zeros(len(x), np.int64), [hits]])})

    met = graphs.unionByName(asks).repartition(tasks(meetings), "group", "q", "x").groupBy("group", "q", "x").applyInPandas(meet, "a long, b long, n long")
    met = materialise(met, "hnsw-links")
    counts = met.where("b = -1").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    roots = components(met.where("b >= 0").select("a", "b"))
    if report is not None:
        wanted, found = met.where("b = -2").agg(F.sum("a"), F.sum("n")).first()
        report |= {"wanted": wanted or 0, "found": found or 0, "recall": found / wanted if wanted else None}
    named = rows.select("rid", "id").join(roots, F.col("rid") == F.col("node"), "left").select("rid", "id", F.coalesce("root", "rid").alias("root"))
    least_id = named.groupBy("root").agg(F.min("id").alias("component"))
    out = named.join(least_id, "root").join(counts, "rid", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component")
