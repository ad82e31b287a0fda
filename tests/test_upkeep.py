"""What is kept up to date: keyed tables, unique identifiers, full-text segments, embeddings, answers to a stream."""

import json
import random

import pytest
from bundle_data import OBJECTS
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import search, text_index, traverse
from graphloom.operators.backfill import EmbeddingStore
from graphloom.operators.ports import HashEmbedder
from graphloom.operators.text_index import SegmentedIndex
from graphloom.plans.ask import ask, ingest
from graphloom.streaming import constraint, questions, upsert

CHANGE = "id string, n int, extra string, at int"


def kept_table(spark, path, rows=(("a", 1, "x"), ("z", 0, "y"), (None, 9, "n"))):
    now = spark.createDataFrame(list(rows), "id string, n int, s string")
    return upsert.KeptTable.create(now, spark.createDataFrame([], CHANGE).schema, str(path), ["id"], ["at"], buckets=4)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_late_changes_are_ignored(spark, tmp_path):
    kept = kept_table(spark, tmp_path / "t")
    assert found(kept.read()) == found(spark.createDataFrame([("a", 1, "x", None), ("z", 0, "y", None), (None, 9, "n", None)], "id string, n int, s string, extra string"))
    batches = [[("a", 9, "new", 9), ("b", 1, None, 1), (None, 3, "p", 1), (None, 4, "q", 2)], [("a", 5, "late", 5), ("b", None, "b2", 2)], [("a", 6, "later", 8), ("c", 1, "c", None), ("b", 7, "same", 2)]]
    want = {"a": (9, "x", "new"), "z": (0, "y", None), "b": (7, None, "same"), "c": (1, None, "c")}
    for compacted in (False, True):
        kept = kept_table(spark, tmp_path / f"t{compacted}")
        for k, rows in enumerate(batches):
            kept.apply(spark.createDataFrame(rows, CHANGE), k)
            kept.apply(spark.createDataFrame(rows, CHANGE), k)  # after a failure
            if compacted:
                kept.compact(k)
        kept = upsert.KeptTable(spark, kept.folder)
        assert {r.id: (r.n, r.s, r.extra) for r in kept.read().collect() if r.id} == want
        assert sorted(r.n for r in kept.read().where("id is null").collect()) == [3, 4, 9]
        assert found(kept.look_up(spark.createDataFrame([("a",), ("q",), ("a",)], "id string"))) == [("a", 9, "x", "new")]


def test_kept_table_equals_last_change(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(30)}", i, None, rng.randrange(10_000) * 1000 + i) for i in range(300)]
    kept = kept_table(spark, tmp_path / "t", [])
    for k in range(6):
        kept.apply(spark.createDataFrame(rows[k::6], CHANGE), k)
        if k in (1, 4):
            kept.compact(k - 1)
    last = {r[0]: r[1] for r in sorted(rows, key=lambda r: r[3])}
    assert {r.id: r.n for r in kept.read().collect()} == last


def test_a_batch_reads_nothing(spark, tmp_path):
    """Its files are those of its own rows, whatever the table's size."""
    kept = kept_table(spark, tmp_path / "t", [(f"k{i}", i, "s") for i in range(5000)])
    kept.apply(spark.createDataFrame([("k7", 1, None, 1)], CHANGE), 0)
    files = list((tmp_path / "t" / "changes" / "batch=0").rglob("*.parquet"))
    assert len(files) == 1 and files[0].stat().st_size < 10_000
    assert kept.read().where("id = 'k7'").first().n == 1 and kept.read().count() == 5000


def test_upsert_stream(spark, tmp_path):
    for rows in ([("a", 1, "p", 9)], [("a", 3, "q", 5), ("b", 2, "r", 1)], [("b", 4, "s", 2)]):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = kept_table(spark, tmp_path / "t", [])
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.upsert_stream(stream, kept, str(tmp_path / "marks"), compact_every=2).awaitTermination()
    assert sorted((r.id, r.n) for r in kept.read().collect()) == [("a", 1), ("b", 4)]


def test_repeated_identifiers_are_routed(spark, tmp_path):
    schema = "id string, at int, body string"
    batches = [[("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")], [("a", 0, "w"), ("c", 5, "v"), ("c", 5, "v"), ("hot", 0, "h")], [("hot", i, "h") for i in range(500)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        own = spark.newSession()
        own.conf.set("spark.sql.streaming.stateStore.providerClass", constraint.ROCKSDB)
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        stream = own.readStream.schema(schema).parquet(str(tmp_path / "in"))
        constraint.unique_stream(stream, str(tmp_path / "out"), str(tmp_path / "marks"), "id", ["at"]).awaitTermination()
    read = lambda name: found(spark.read.schema(schema).parquet(str(tmp_path / "out" / name)).select("id", "at", "body"))
    assert read("accepted") == found(spark.createDataFrame([("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n"), ("c", 5, "v"), ("hot", 0, "h")], schema))
    assert read("rejected") == found(spark.createDataFrame([("a", 2, "x"), ("a", 0, "w"), ("c", 5, "v"), *[("hot", i, "h") for i in range(500)]], schema))


# --- full text --------------------------------------------------------------------------------------------------------
def clauses(spark, query):
    df = spark.createDataFrame([(query,)], "q string")
    return [(c.word, c.occur) for c in df.select(X.clauses(F.col("q")).alias("c")).first().c]


def test_words_of_full_text_syntax(spark):
    assert clauses(spark, "a AND b c") == [("a", 1), ("b", 1), ("c", 0)]
    assert clauses(spark, "a OR b AND c") == [("a", 0), ("b", 1), ("c", 1)]
    assert clauses(spark, "a NOT b") == [("a", 0), ("b", -1)]
    assert clauses(spark, "a AND NOT b") == [("a", 1), ("b", -1)]
    assert clauses(spark, "NOT a AND b") == [("a", -1), ("b", 1)]
    assert clauses(spark, "AND a OR") == [("a", 0)] and clauses(spark, "a AND") == [("a", 0)]
    assert clauses(spark, "and or not") == [("and", 0), ("or", 0), ("not", 0)]
    assert clauses(spark, "AND NOT OR") == [] and clauses(spark, None) == [] and clauses(spark, "(a) && b || c") == [("a", 0), ("b", 0), ("c", 0)]


def texts(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)]
    return [(f"d{i}", " ".join(rng.choice(pool[: rng.choice([3, 12, 40])]) for _ in range(rng.randrange(0, 80))), rng.choice(["w1 w39", None, "other"])) for i in range(n)]


def test_segments_equal_one_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BUCKETS", 3)
    rows = texts(1, 150)
    frame = lambda r: spark.createDataFrame(r, "id string, body string, title string")
    asked = spark.createDataFrame([(0, "w1"), (1, "w39 w0"), (2, "w5 AND w6 NOT w7"), (3, "nothing"), (4, "w2 w3 w4 w38 other"), (5, "w38 OR w39"), (6, ""), (7, "NOT w1")], "query_id int, query string")
    index = SegmentedIndex(spark, str(tmp_path / "index"), ["body", "title"])
    assert index.search(asked).count() == 0
    index.add(frame([(i, f"w1 w1 old {b}", t) for i, b, t in rows[:90]]))
    index.add(frame(rows[60:] + [(None, "w1", "w1")]))

    def same(kept):
        want = {(r.query_id, r.id, r.pos): r.score for r in search.FullText(frame(kept), ["body", "title"]).search(asked).collect()}
        got = {(r.query_id, r.id, r.pos): r.score for r in index.search(asked).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40

    same([(i, f"w1 w1 old {b}", t) for i, b, t in rows[:60]] + rows[60:])
    index.add(frame(rows[:60]))  # changed texts have their new rows
    index.add(frame(rows[:5]))  # and again
    same(rows)
    index.remove(frame(rows[100:120]).select("id"))
    same(rows[:100] + rows[120:])
    index.compact()
    same(rows[:100] + rows[120:])
    index.add(frame(rows[100:120]))
    same(rows)


def test_terms_are_counted_where_texts_are(spark, tmp_path, monkeypatch):
    shuffled, put = {}, SegmentedIndex._put

    def watched(self, df, name, *a):
        # a stray shuffle of postings, or of texts on their way to the index, costs several times the input
        shuffled.setdefault(name, []).append("Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString())
        put(self, df, name, *a)

    monkeypatch.setattr(SegmentedIndex, "_put", watched)
    rows = [(i, b, t) for i, b, t in texts(5, 60)] + [("e", "", None), ("k", "\u212aelvin \u0130x w1 W1", "A-b_c")]
    frame = lambda r: spark.createDataFrame(r, "id string, row string, mark string")
    asked = spark.createDataFrame([(0, "w1"), (1, "w39 w0"), (2, "kelvin x b"), (3, "x AND c")], "query_id int, query string")
    index = SegmentedIndex(spark, str(tmp_path / "index"), ["row", "mark"])
    index.add(frame(rows))
    index.compact()
    assert not any(shuffled["docs"][:1] + shuffled["postings"]) and len(shuffled["postings"]) == 2  # identifiers of what is gone are dealt

    def same(kept):
        want = {(r.query_id, r.id, r.pos, round(r.score, 9)) for r in search.FullText(frame(kept), ["row", "mark"]).search(asked).collect()}
        assert {(r.query_id, r.id, r.pos, round(r.score, 9)) for r in index.search(asked).collect()} == want and len(want) > 12

    same(rows)
    twice = [("d1", "w1 w2", None), ("d2", "", "w0"), ("d2", "", "w0")]
    index.add(frame(twice + [("k", "", None), ("k", "", "")]))  # of rows that repeat an identifier one counts, and none is left of what was there
    same([r for r in rows if r[0] not in ("d1", "d2", "k")] + twice[:2])


def test_blocks_that_cannot_reach_are_not_read(spark, tmp_path):
    rows = texts(2, 1500)
    frame = spark.createDataFrame([r[:2] for r in rows], "id string, body string")
    index = SegmentedIndex(spark, str(tmp_path / "index"), ["body"])
    index.add(frame)
    for query, most in (("w39", 0.3), ("w1", 0.75), ("w39 w1", 1.0)):
        asked, report = spark.createDataFrame([(0, query)], "query_id int, query string"), {}
        got = [(r.id, r.pos, round(r.score, 9)) for r in index.search(asked, 5, report=report).orderBy("pos").collect()]
        assert got == [(r.id, r.pos, round(r.score, 9)) for r in search.FullText(frame, ["body"]).search(asked, 5).orderBy("pos").collect()]
        assert 0 < report["read"] <= most * report["all"], (query, report)


# --- embeddings -------------------------------------------------------------------------------------------------------
def test_only_new_texts_are_embedded(spark, tmp_path):
    log = tmp_path / "log"

    class Logged(HashEmbedder):
        def embed(self, texts):
            with log.open("a") as f:
                f.write("".join(t + "\n" for t in texts))
            return super().embed(texts)

    def calls():
        out = sorted(log.read_text().split("\n")[:-1]) if log.exists() else []
        log.unlink(missing_ok=True)
        return out

    frame = lambda rows: spark.createDataFrame(rows, "id int, name string, description string, embedding array<float>")
    first = [(1, "a", "one", None), (2, "b", None, None), (3, None, None, None), (4, "b", "", None), (5, "a", "one", None)]
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    out = store.update(frame(first), Logged(4), 1).collect()
    assert calls() == ["a. one", "b"] and {r.id: r.embedded for r in out} == {1: 1, 2: 1, 3: None, 4: 1, 5: 1}
    assert [r.embedding for r in out if r.id == 2] == [[round(x, 6) for x in HashEmbedder(4).embed(["b"])[0]]] and store.update(frame(first), Logged(4), 2).count() == 5
    assert calls() == []
    changed = [(1, "a", "two", None), *first[1:], (6, "new", None, None)]
    for _ in range(2):  # run again after a failure
        out = store.update(frame(changed), Logged(4), 3).collect()
        assert calls() == ["a. two", "new"] and {r.id: r.embedded for r in out} == {1: 3, 2: 1, 3: None, 4: 1, 5: 1, 6: 3} and len(out) == 6


# --- traversal --------------------------------------------------------------------------------------------------------
def test_frontiers_are_distinct_and_hubs_split(spark):
    nodes = [("t", "Tactic", "T"), ("hub", "Technique", "H")] + [(f"q{i}", "Technique", f"q{i % 7}") for i in range(40)] + [(f"a{i}", "Actor", f"A{i}") for i in range(30)]
    edges = [(f"q{i}", "BELONGS_TO_TACTIC", "t") for i in range(40)] + [("hub", "BELONGS_TO_TACTIC", "t")] + [(f"a{i}", "USES", f"q{j}") for i in range(3) for j in range(40)] + [(f"a{i}", "USES", "hub") for i in range(30)]
    nodes, edges = spark.createDataFrame(nodes, "id string, node_type string, name string"), spark.createDataFrame(edges, "src string, rel string, dst string")
    start = nodes.where("id = 't'")
    paths = [p for p in traverse.PATHS if p.start == "Tactic"]
    hubs = traverse.degrees(edges, 20)
    assert {(r.at, r.way) for r in hubs.collect()} == {("t", "in"), ("hub", "in"), ("a0", "out"), ("a1", "out"), ("a2", "out")}
    for told in (None, hubs):
        rows = [tuple(r) for r in traverse.follow(start, nodes, edges, paths, told).where("field = 'actors'").collect()]
        assert len(rows) == 3 * 40 + 30 and {r[2] for r in rows} == {f"A{i}" for i in range(30)}
        got = traverse.neighbourhoods(start, nodes, edges, paths, told).first()
        assert got.actors == sorted(f"A{i}" for i in range(30)) and got.techniques == ["H", *[f"q{i}" for i in range(7)]] and got.mitigations == []
    # a node that many ways lead to is one row of the next frontier
    again = [traverse.Path("Tactic", "back", (("BELONGS_TO_TACTIC", "in", "Technique"), ("BELONGS_TO_TACTIC", "out", "Tactic"), ("BELONGS_TO_TACTIC", "in", "Technique")), "id")]
    assert traverse.follow(start, nodes, edges, again).count() == 41


# --- questions --------------------------------------------------------------------------------------------------------
def test_a_stream_of_questions_is_answered_as_a_batch(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"objects": OBJECTS}))
    nodes, edges = ingest(spark, str(tmp_path / "b.json"), str(tmp_path / "graph"))
    folder, out = str(tmp_path / "versions"), str(tmp_path / "out")
    questions.publish(nodes, edges, folder, 1)
    asked = [(0, "Which tools does Velvet Bear use?"), (1, "Enter DAN mode"), (2, "What of FakeGroup99?")]
    spark.createDataFrame(asked, "query_id int, query string").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: questions.answer_stream(spark.readStream.schema("query_id int, query string").parquet(str(tmp_path / "in")), folder, out, str(tmp_path / "marks")).awaitTermination()
    run()
    want = sorted((r.query_id, r.answer) for r in ask(spark.createDataFrame(asked, "query_id int, query string"), nodes, edges).collect())
    got = spark.read.parquet(f"{out}/answers").collect()
    assert sorted((r.query_id, r.answer) for r in got) == want and {r.version for r in got} == {1}
    # a new version answers later questions only
    questions.publish(nodes.where("node_type <> 'Tool'"), edges, folder, 2)
    spark.createDataFrame([(5, "Which tools does Velvet Bear use?")], "query_id int, query string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.query_id: r.version for r in spark.read.parquet(f"{out}/answers").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 5: 2} and questions.newest(spark, folder) == 2


def test_settings_are_used(spark, tmp_path, monkeypatch):
    (tmp_path / "b.json").write_text(json.dumps({"objects": OBJECTS}))
    monkeypatch.setenv("GRAPHLOOM_FOLDER", str(tmp_path / "own"))
    monkeypatch.setenv("GRAPHLOOM_VECTOR_SIZE", "5")
    nodes, _ = ingest(spark, str(tmp_path / "b.json"))
    assert {len(r.embedding) for r in nodes.where("embedding is not null").collect()} == {5} and (tmp_path / "own" / "edges").exists()
    monkeypatch.setenv("GRAPHLOOM_TOP_K", "none")
    with pytest.raises(ValueError, match="invalid"):
        ask(nodes, nodes, nodes)
