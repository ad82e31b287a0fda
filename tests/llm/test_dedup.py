"""Near and exact duplicates against brute force, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import base, exact_dedup, hnsw, simhash, warc


class Roots:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def words(n, seed, pool=400):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def corpus():
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One word"), (4, "one WORD"), (5, "É one"), (6, "é one")]
    for k in range(12):
        text = words(150, k)
        rows.append((10 + 10 * k, " ".join(text)))
        rows.append((11 + 10 * k, "\n ".join(text)))
        for j in range(1, 5):
            other = list(text)
            for c in range(j):
                other[(37 * c + 11 * j) % 150] = f"changed{k}{j}{c}"
            rows.append((11 + 10 * k + j, " ".join(other)))
    rows.append((900, " ".join(words(30_000, 99))))
    rows.append((901, " ".join(words(30_000, 99)) + " end"))
    return rows


def plain_fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("tile", [7, simhash.TILE])
def test_simhash_equals_brute_force(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    prints = base.materialise(simhash.fingerprints(docs), "t")
    got = {r.id: (int.from_bytes(r.fp), r.component) for r in simhash.link_components(prints, 4, tile=tile).collect()}
    want = {i: plain_fingerprint(t) for i, t in rows}
    roots = Roots(want)
    for a in want:
        for b in want:
            if a < b and (want[a] ^ want[b]).bit_count() <= 4:
                roots.join(a, b)
    assert got == {i: (f, roots.find(i)) for i, f in want.items()}


def test_spark_hash_is_the_same(spark):
    text = "été a b c"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_near_duplicates(spark):
    rows = corpus()
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().decode().split()) else set() for i, t in rows}
    for a in got:
        for b in got:
            j = len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
            if j >= 0.8:
                assert got[a] == got[b], (a, b, j)
            if j < 0.2 and shingles[a] and shingles[b]:
                assert got[a] != got[b], (a, b, j)
    assert got[900] == got[901] == 900


def near_pairs():
    """Texts in pairs on both sides of a similarity of 0.8, and a chain of which only neighbours are near."""
    rows, r = [], random.Random(8)
    for k in range(150):
        text = words(200, 1000 + k, 100_000)
        other = list(text)
        for at in r.sample(range(0, 195, 6), k % 9 + 1):
            other[at] = f"other{k}x{at}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    chain = words(200, 77, 100_000)
    for k in range(8):
        rows.append((500 + k, " ".join(chain)))
        chain[20 * k + 7], chain[20 * k + 17] = f"one{k}", f"two{k}"
    return rows + [(600, "a b c d e f g h"), (601, "a b c d e f g h i"), (602, None), (603, " ")]


def brute_components(rows):
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    roots = Roots(sets)
    for a in sets:
        for b in sets:
            if a < b and (sets[a] | sets[b] == set() or sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                roots.join(a, b)
    return {i: roots.find(i) for i in sets}


@pytest.mark.parametrize("chunk", [4, simhash.CHUNK])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = near_pairs()
    want = brute_components(rows)
    assert 40 < sum(want[2 * k] == want[2 * k + 1] for k in range(150)) < 110 and want[507] == 500 and want[601] == 600
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1 and {r.id: r.component for r in got} == want | {None: None}


def test_confirmed_on_either_side():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    sets += [np.arange(100, 135, dtype=np.uint64), np.arange(107, 135, dtype=np.uint64)]  # 28 of 35: 0.8 itself
    for least in (0.5, 0.6, 0.8):
        for first in (0, 30):
            n, pairs = len(sets), []
            for a in range(n):
                for b in range(a + 1, n):
                    union = len(np.union1d(sets[a], sets[b]))
                    if (not first or a < first <= b) and (not union or len(np.intersect1d(sets[a], sets[b])) / union >= least):
                        pairs.append((a, b))
            want, got = Roots(range(n)), Roots(range(n))
            for a, b in pairs:
                want.join(a, b)
            for a, b in zip(*simhash.confirmed(sets, least, first), strict=True):
                assert (a, b) in pairs
                got.join(int(a), int(b))
            assert [got.find(x) for x in range(n)] == [want.find(x) for x in range(n)]


def test_a_repeated_line_does_not_link(spark):
    line = "the very same line that is everywhere in these texts "
    rows = [(i, line * 60 + " ".join(words(200, 500 + i, 100_000))) for i in range(6)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.id == r.component for r in got)


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (7, None)], "doc_id long, text string")
    rows = simhash.simhash(docs).collect()
    assert len(rows) == 4 and {(r.id, r.component) for r in rows} == {(None, 4), (4, 4), (7, 7)}
    assert simhash.simhash(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest_and_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(60)]
    roots = Roots({x for p in pairs for x in p})
    for a, b in pairs:
        roots.join(a, b)
    want = {x: roots.find(x) for x in roots.up}
    node, root = base.forest(*map(np.array, zip(*pairs, strict=True)))
    assert {x: x for x in want} | dict(zip(node.tolist(), root.tolist(), strict=True)) == want
    links = base.Links(fold_at=10)
    for a, b in pairs:
        links.add(np.array([a]), np.array([b]))
    node, root = base.forest(*links.folded())
    assert {x: x for x in want} | dict(zip(node.tolist(), root.tolist(), strict=True)) == want
    got = {x.node: x.root for x in base.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: x for x in want} | got == want
    assert base.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# --- exact ------------------------------------------------------------------------------------------------------------
def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


EXACT = [(9, "a  b"), (3, "a\n\tb"), (5, " a b"), (7, None), (2, ""), (8, " "), (11, "x" * 200_000), (12, "x" * 200_000), (13, "a b"), (13, "a b"), (None, "a b"), (None, "only null"), (21, "\u00a0a")]


def weak(text):
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 0)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_equals_brute_force(spark, digest):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(EXACT)], "doc_id long, text string, digest int").repartition(3)
    groups = {}
    for i, t in EXACT:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in EXACT:
        ids = [x for x in groups[norm(t)] if x is not None]
        want.append((i, min(ids, default=None), len(groups[norm(t)]), i == min(ids, default=None)))
    rows = exact_dedup.exact_groups(docs, digest=digest, files_per_batch=1).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in rows), key=key) == sorted(want, key=key)
    if digest is exact_dedup.sha256:
        assert {r.digest for r in rows if r.id in (3, 9)} == {hashlib.sha256(b"a b").hexdigest()}
    kept = exact_dedup.deduplicate(docs, digest=digest, files_per_batch=1).collect()
    assert len(kept) == len(groups) and sorted(norm(r.text) for r in kept) == sorted(groups)
    for r in kept:
        ids = [x for x in groups[norm(r.text)] if x is not None]
        assert r.doc_id == min(ids, default=None) and EXACT[r.digest] == (r.doc_id, r.text)


def test_exact_hot_group_and_empty(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.exact_groups(hot)
    assert rows.where("group_size = 1000 and keep_id = 0").count() == 1000 and rows.where("kept").count() == 2001
    assert exact_dedup.exact_groups(hot.limit(0)).count() == 0 and exact_dedup.deduplicate(hot.limit(0)).count() == 0


# --- embeddings -------------------------------------------------------------------------------------------------------
def vectors():
    rng = np.random.default_rng(2)
    out, near = [], []
    for k in range(260):
        v = rng.standard_normal(24)
        if k % 3 == 0 and near:
            v = near[k % len(near)] + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.3])
        else:
            near.append(v)
        out.append((k, (v * rng.uniform(0.1, 50)).tolist(), int(k % 7 == 0)))
    hot = rng.standard_normal(24)
    out += [(300 + k, (hot + rng.standard_normal(24) * 0.05).tolist(), 5) for k in range(90)]
    nan, inf = float("nan"), float("inf")
    out += [(400, None, 1), (401, [0.0] * 24, 1), (402, [nan] + [1.0] * 23, 1), (403, [inf] + [1.0] * 23, 1), (404, [1.0] * 24, None), (405, [1.0] * 24, None), (406, [1.0, 0.0], 1), (407, [2.0, 0.1], 1), (408, [None, 1.0], 1), (409, [], 1), (410, [3.0, 0.0], 1), (410, [3.0, 0.0], 1), (None, [3.0, 0.1], 1)]
    return out


@pytest.mark.parametrize("shard", [40, hnsw.SHARD])
def test_embeddings_equal_brute_force(spark, shard):
    rows = vectors()
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93, shard=shard).collect()
    links = [0] * len(rows)
    roots = Roots(range(len(rows)))
    sound = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)
    for a, (_, v, x) in enumerate(rows):
        for b, (_, w, y) in enumerate(rows[:a]):
            if x is not None and x == y and sound(v) and sound(w) and len(v) == len(w):
                v_, w_ = np.array(v), np.array(w)
                if v_ @ w_ / np.linalg.norm(v_) / np.linalg.norm(w_) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    roots.join(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[roots.find(k)] = min(i, least.get(roots.find(k), 10**9))
    want = sorted((str(i), links[k], str(least.get(roots.find(k)))) for k, (i, _, _) in enumerate(rows))
    assert sorted((str(r.id), r.n_links, str(r.component)) for r in got) == want
    assert max(links) == 89


def test_embeddings_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_narrow_beam_widens():
    rng = np.random.default_rng(4)
    v = hnsw.unit(np.repeat(rng.standard_normal((30, 16)), 20, axis=0) + rng.standard_normal((600, 16)) * 0.15)
    graph = hnsw.Graph.load(hnsw.Graph(v).dump(), v)
    a, b = hnsw.links_between(graph, v, v, 0.9, beam=1)
    x, y = np.nonzero(v @ v.T >= 0.9)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True)) & set(zip(x.tolist(), y.tolist(), strict=True))) >= 0.99 * len(x)
    assert (np.einsum("ij,ij->i", v[a], v[b]) >= 0.9).all()
    # a graph without edges finds nothing by itself; the audit leads to the comparison with all
    graph.count[0][:] = 0
    graph.near[0][:] = -1
    a, b = hnsw.links_between(graph, v, v, 0.9)
    assert len(a) == len(x)


def test_an_audit_is_never_empty():
    # two shards that share one pair of vectors, which no few queries meet; the graph finds nothing by itself, and so fails
    rng = np.random.default_rng(9)
    v, q = hnsw.unit(rng.standard_normal((400, 32))), hnsw.unit(rng.standard_normal((400, 32)))
    q[211] = v[97]
    graph = hnsw.Graph(v)
    graph.count[0][:] = 0
    graph.near[0][:] = -1
    a, b, want, hits = hnsw.audited_links(graph, v, q, 0.93)
    assert (211, 97) in set(zip(a.tolist(), b.tolist(), strict=True)) and want == hits >= 10 * hnsw.AUDITED


def test_equal_vectors_over_shards(spark):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((3, 16))
    rows = [(k, rng.standard_normal(16).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, groups[k % 3].tolist(), 1) for k in range(330)]
    report = {}
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93, shard=160, report=report).collect()
    v = hnsw.unit(np.array([r[1] for r in rows]))
    near = v @ v.T >= 0.93
    at = {r[0]: k for k, r in enumerate(rows)}
    assert all(r.n_links == near[at[r.id]].sum() - 1 for r in got)
    assert all(r.component == min(rows[k][0] for k in np.flatnonzero(near[at[r.id]])) for r in got)
    assert report["recall"] == 1.0 and report["wanted"] > 0


def test_links_of_a_full_shard_come_from_the_graph(monkeypatch):
    # as many vectors as a shard has, with few links between two shards
    rng = np.random.default_rng(12)
    v, q = hnsw.unit(rng.standard_normal((hnsw.SHARD, 24))), hnsw.unit(rng.standard_normal((hnsw.SHARD, 24)))
    for k in range(90):
        noise = rng.standard_normal(24)
        q[37 * k] = hnsw.unit((v[41 * k] + 0.078 * noise)[None])[0]
    x, y = np.nonzero(q @ v.T >= 0.93)
    searched, within = [], hnsw.Graph.within
    monkeypatch.setattr(hnsw.Graph, "within", lambda self, *a: searched.append(1) or within(self, *a))
    monkeypatch.setattr(hnsw, "exact", None)  # nothing is compared but the audit
    a, b, want, hits = hnsw.audited_links(hnsw.Graph(v), v, q, 0.93)
    assert len(searched) >= hnsw.SHARD + hnsw.AUDITED and hits >= hnsw.RECALL * want > 0
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(x.tolist(), y.tolist(), strict=True)) and len(x) > 50


def test_meeting_by_number(spark, monkeypatch):
    """Long rows stay where they are: the plan has no exchange of them, and the result is that of a join."""
    monkeypatch.setattr(base, "OPEN", 1)
    rows = base.materialise(spark.range(0, 5000, 1, 7).select(F.monotonically_increasing_id().alias("rid"), "id", F.repeat(F.lit("x"), 50).alias("text")), "t")
    twice = rows.unionByName(rows.where("id % 9 = 0"))
    told = rows.where("id % 3 = 0 and id < 4000").select("rid", (F.col("id") * 2).alias("twice"), F.when(F.col("id") % 2 == 0, F.struct("id")).alias("s")).orderBy(F.rand(1))
    got = base.meet_by_number(twice, told, "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = twice.join(told, "rid")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 1300
    assert base.meet_by_number(rows, told.limit(0), "t").count() == 0 and base.meet_by_number(rows.limit(0), told, "t").count() == 0


def test_texts_do_not_move_whatever_the_number_of_copies(spark, monkeypatch):
    """With no side small enough for a broadcast, only texts that hit a digest are shuffled, and no payload of one chunk."""
    monkeypatch.setattr(base, "BROADCAST_ROWS", 1)
    rng = random.Random(3)
    body = lambda: "".join(rng.choice("abcdefghij ") for _ in range(4000))
    rows = [(i, body()) for i in range(300)] + [(1000 + i, f"copy {i // 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = sum(len(t) for _, t in rows)

    def written(run):
        seen = {s.stageId() for s in _stages(spark)}
        run()
        return sum(s.shuffleWriteBytes() for s in _stages(spark) if s.stageId() not in seen)

    docs = base.materialise(docs, "t")
    assert written(lambda: exact_dedup.deduplicate(docs).write.format("noop").mode("overwrite").save()) < 0.15 * texts
    assert written(lambda: exact_dedup.exact_groups(docs).write.format("noop").mode("overwrite").save()) < 0.2 * texts
    pages = base.materialise(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), "t")
    assert written(lambda: warc.round_trip(pages).count()) < 0.3 * texts
    assert written(lambda: simhash.deduplicate(docs).write.format("noop").mode("overwrite").save()) < 0.5 * texts
    assert exact_dedup.deduplicate(docs).count() == 330


def _stages(spark):
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


def test_components_with_heavy_hubs(spark, monkeypatch):
    from graphloom.llm import base

    rng = np.random.default_rng(2)
    edges = [(7, int(k)) for k in range(100, 180)] + [(900, int(k)) for k in range(200, 280)] + [(179, 200), (5, 6), (6, 4), (3, 3), (None, 1)]
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    roots = Roots({x for e in edges if None not in e for x in e})
    for a, b in edges:
        if a is not None:
            roots.join(a, b)
    least = {}
    for a, b in edges:
        for x in (a, b) if a is not None and a != b else ():
            least[roots.find(x)] = min(x, least.get(roots.find(x), 10**9))
    want = {x: least[roots.find(x)] for a, b in edges if a is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for heavy in (base.HEAVY, 10):
        monkeypatch.setattr(base, "HEAVY", heavy)
        got = {r.node: r.root for r in base.components(df).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_groups_of_many_copies(spark, monkeypatch):
    from graphloom.llm import base

    monkeypatch.setattr(base, "HEAVY", 20)
    rows = [(i, "hot  text") for i in range(60)] + [(100 + i, f"other {i // 2}") for i in range(40)] + [(None, "hot text"), (7, "hot text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((str(r.id), r.keep_id, r.group_size) for r in got) == sorted((str(i), 0 if t.startswith("hot") else i - i % 2, 62 if t.startswith("hot") else 2) for i, t in rows)
    # all digests equal: groups are of the bytes
    got = exact_dedup.exact_groups(docs, digest=lambda t: F.lit("x")).collect()
    assert sorted((str(r.id), r.keep_id, r.group_size) for r in got) == sorted((str(i), 0 if t.startswith("hot") else i - i % 2, 62 if t.startswith("hot") else 2) for i, t in rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
