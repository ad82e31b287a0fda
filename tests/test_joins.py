"""Substring join, similarity join and vector index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import fuzzy
from graphloom.operators import entities, fuzzy_join, search, substrings, vector_index


def plan(df):
    return df._jdf.queryExecution().toString()


def made(seed, n, letters="abcdé ", most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(n)]


def test_containing_equals_brute_force(spark):
    needles = [*made(1, 120, most=6), "a", "é", "zz", "abc", "%", None, "a.b"]
    texts = [*made(2, 150, most=40), "a.b", "aXb", "ABC", "abc" * 4000, "", None]
    got = substrings.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts + texts[:9]], "text string"))
    want = {(n, t) for n in needles for t in texts if n and t and n in t}
    rows = [(r.needle, r.text) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000
    assert not any(x in plan(got) for x in ("CartesianProduct", "NestedLoop"))
    empty = spark.createDataFrame([], "needle string")
    assert substrings.containing(empty, got).count() == 0 and substrings.containing(got, empty.withColumnRenamed("needle", "text")).count() == 0


@pytest.mark.parametrize("piece", [1, 40, 1 << 22])
def test_held_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    needles = [*made(1, 120, most=6), "a", "é", "zz", "abc", "%", None, "", "a.b", "\u20ac", "\U0001f600b"]
    texts = [*made(2, 150, most=40), "a.b", "aXb", "ABC", "abc" * 4000, "", None, "ab\u20ac\U0001f600b", "b\U0001f600"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, body string")
    frame = spark.createDataFrame([(n,) for n in needles * 2], "needle string")
    got = substrings.held(frame, rows, "doc", "body")
    want = sorted((i, n) for i, t in enumerate(texts) for n in set(needles) if n and t and n in t)
    assert sorted((r.id, r.needle) for r in got.collect()) == want and len(want) > 1000
    assert not any(x in plan(got) for x in ("Exchange", "Join"))  # no text moves
    assert substrings.held(frame.limit(0), rows, "doc", "body").count() == 0 and substrings.held(frame, rows.limit(0), "doc", "body").count() == 0
    if piece == 40:
        monkeypatch.setattr(substrings, "NEEDLES", 5)
        assert sorted((r.id, r.needle) for r in substrings.held(frame, rows, "doc", "body").collect()) == want


@pytest.mark.parametrize("least", [50, 65, 76, 82, 85, 100])
def test_ratio_join_loses_no_pair(spark, monkeypatch, least):
    monkeypatch.setattr(fuzzy_join, "TOLD", 9)
    left, right = [*made(3, 90, "abé ", 13), "blue bolt", None, "", "x"], [*made(4, 90, "abé ", 13), "blue bolts", "blue bolt", "x", None, "", "bolt blue " * 20, "bolt blue " * 19]
    left.append("bolt blue " * 20 + "x")
    df = lambda rows: spark.createDataFrame([(t, 1) for t in rows], "text string, id int")
    got = fuzzy_join.ratio_join(df(left), df(right), least)
    want = {(a, b): round(fuzzy.ratio_of(a, b), 9) for a in left for b in right if a and b and fuzzy.ratio_of(a, b) >= least}
    rows = [((r.a, r.b), round(r.score, 9)) for r in got.collect()]
    assert dict(rows) == want and len(rows) == len(want) and want
    assert not any(x in plan(got) for x in ("CartesianProduct", "NestedLoop"))


def test_few_candidates(spark):
    """Names of two words: the join looks at few of all pairs."""
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(300)]
    names = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(600)]
    wrong = [n[: i % len(n)] + n[i % len(n) + 1 :] for i, n in enumerate(names[:300])]
    df = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    report = {}
    found = {(r.a, r.b) for r in fuzzy_join.ratio_join(df(wrong), df(names), 82, report).collect()}
    assert found == {(a, b) for a in set(wrong) for b in set(names) if fuzzy.ratio_of(a, b) >= 82}
    assert report["compared"] < 0.05 * report["pairs"] and report["compared"] <= report["joined"] < 0.2 * report["pairs"]


def test_best_match_is_that_of_all_pairs(spark):
    keys, asked = sorted({k for k in made(8, 80, "abcd ", 12) if k.strip()}), sorted({k for k in made(9, 60, "abcd ", 12) if k.strip()})
    got = entities.best_matches(spark.createDataFrame([(a,) for a in asked], "candidate string"), spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "key string, pos int"), 60)
    place = {k: i % 3 for i, k in enumerate(keys)}
    pairs = [(a, k, fuzzy.ratio_of(a, k), place[k]) for a in asked for k in keys]
    rows = spark.createDataFrame([p for p in pairs if p[2] >= 60], "candidate string, key string, score double, pos int")
    ten = search.top(rows, 10, [F.desc("score"), F.asc("pos"), F.asc("key")], "candidate")
    good = ten.where(entities.confident(F.col("candidate"), F.col("key"), F.col("score")))
    want = {(r.candidate, r.key, round(r.score, 9)) for r in search.top(good.withColumnRenamed("pos", "p"), 1, [F.asc("p")], "candidate").collect()}
    assert {(r.candidate, r.key, round(r.score, 9)) for r in got.collect()} == want and want


# --- vector index -----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.5 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)]  # copies: ties by id
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [1.0, 2.0]), (3004, [2.0, 1.0]), (3005, [1.0, None]), (3003, [1.0, 2.0])]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def test_vector_index_equals_scan(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "index"), lists=20, sample=300)
    asked = vectors.where("id % 25 = 0 or id in (3003, 3005)").dropDuplicates(["id"]).select(F.col("id").cast("string").alias("query_id"), "embedding")
    want = {(r.query_id, r.id, r.pos, round(r.score, 9)) for r in search.vector_search(asked, vectors, 10).collect()}
    got = {(r.query_id, r.id, r.pos, round(r.score, 9)) for r in vector_index.VectorIndex(spark, index.folder).search(asked, 10, probes=1).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and got == want and len(want) > 600


def test_recall_is_audited(spark, vectors, tmp_path):
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "index"), lists=30)
    asked = vectors.where("id % 25 = 0 and id < 2000").select(F.col("id").alias("query_id"), "embedding")
    truth = {(r.query_id, r.id) for r in search.vector_search(asked, vectors, 10).collect()}
    for least in (0.95, 1.0):
        rows = index.nearest(asked, 10, recall=least, probes=1, audited=1000).collect()
        hits = len(truth & {(r.query_id, r.id) for r in rows})
        assert {round(r.recall, 9) for r in rows} == {round(hits / len(truth), 9)} and hits >= least * len(truth)
    assert index.nearest(asked, 10, probes=1, audited=5).count() == 600


def test_index_of_nothing(spark, vectors, tmp_path):
    index = vector_index.VectorIndex.build(vectors.limit(0), str(tmp_path / "index"))
    asked = vectors.select(F.col("id").alias("query_id"), "embedding")
    assert index.search(asked).count() == 0 and index.nearest(asked).count() == 0
