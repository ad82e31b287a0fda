"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(rows):
    text = lambda x: "NULL" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = tables.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = plain(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == plain(tuple(r[i] for i in at) for r in want.fetchall()) and rows


def test_recall_of_the_vector_index(spark):
    """The query without SQL: its rows are nearly those of the scan, and the recall is what was measured."""
    rows = queries.QUERIES["vector_index_recall"](spark, SF).collect()
    truth = {(r.query_id, r.vec_id) for r in queries.QUERIES["vector_topk"](spark, SF).collect()}
    hits = len(truth & {(r.query_id, r.vec_id) for r in rows})
    assert hits >= 0.95 * len(truth) and {r.recall for r in rows} == {round(hits / len(truth), 6)}
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"vector_index_recall"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_exact_id_searches_all_parts(spark, tmp_path):
    keys = [7, 9999, 10_000, 123_456]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = queries._named_parts(spark, str(tmp_path)).collect()
    assert {(r.id, r.external_id) for r in got} == {(7, "T0007"), (9999, "T9999"), (10_000, "T10000"), (123_456, "T123456")}
