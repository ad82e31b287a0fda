"""The pipeline's stages one by one and as a whole, and the queries over the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "123 !!", "en", "s", 6), (9003, None, "en", None, None)], docs.schema)
    now = docs.unionByName(extra).unionByName(docs.limit(3))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, SF), "test")
        ids[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
        if name != "packing":
            assert now.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(ids["language_id"]) == set(texts)
    first = {}
    for i in sorted(texts):
        first.setdefault(norm(texts[i]), i)
    assert ids["exact_dedup"] == sorted(first.values())
    # of near copies one stays, and what is like nothing else stays
    shingles = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids["exact_dedup"] if (w := texts[i].lower().split())}
    kept = set(ids["simhash_near_dedup"])
    for a in shingles:
        like = [len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for b in shingles if b != a]
        assert a in kept or max(like) >= 0.5
    for a in kept:
        for b in kept:
            assert a >= b or len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) < 0.8
    assert set(ids["mixing"]) == kept and set(ids["packing"]) == kept
    assert now.agg(F.max("n_tokens")).first()[0] <= 2048


def test_texts_of_no_language_go_whatever_their_length(spark):
    rows = [(i, " ".join(["the of and"] * 9 if i % 2 else ["der und ist"] * 9), "en" if i % 2 else "de", "s", 1, "own") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __lang string")
    model = corpus_pipeline.langid.fit(docs)
    odd = [(100, "x"), (101, "of und"), (102, "?!"), (103, None), (104, "der und ist the of and " * 40), (105, "")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "s", 1, "own") for i, t in odd], docs.schema))
    out = corpus_pipeline.language(spark, docs, "")
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and kept >= {*range(40)} and not kept & {102, 103, 105}
    # the rule by hand
    for i, t in odd:
        lang, p, error = corpus_pipeline.langid.predict(model, [t])[0]
        assert (i in kept) == (lang != "und" and p + corpus_pipeline.SURE * error >= 0.5 + corpus_pipeline.LEAST * 0.5)
    # without a language to learn from, letters decide
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.where("lang is null"), "").collect()} == {100, 101, 104}


@needs_tables
def test_queries(spark):
    for name, run in queries.QUERIES.items():
        rows = run(spark, SF)
        assert rows.count() > 0, name


EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}


def test_empty_tables(spark, tmp_path):
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        docs = out if name != "packing" else docs
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
