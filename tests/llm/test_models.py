"""Language identification, quality and mixing: held-out accuracy, brute force, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, mixing, quality

POOLS = {"en": "the of and thing with that from", "de": "der die und ungen schaft für über", "fr": "le la et tion être où eaux", "xx": "zq qz zzq qqz zqz qzq"}


def rows_of(spark, n=400):
    rng = np.random.default_rng(1)
    langs = sorted(POOLS)
    rows = []
    for i in range(n):
        lang = langs[i % 4]
        text = " ".join(rng.choice(POOLS[lang].split(), 40))
        rows.append((i, text, lang if i % 10 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {r[0]: langs[r[0] % 4] for r in rows}


def test_language_held_out(spark):
    docs, truth = rows_of(spark)
    model = langid.fit(docs, sample=30)
    got = {r.id: r for r in langid.identify(docs, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values()) and set(model.languages) == set(POOLS)


def test_language_odd_rows(spark):
    docs, _ = rows_of(spark, 100)
    model = langid.fit(docs, sample=10)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 ?!", 5), (None, "the of and", 5), (5, "the of and thing " * 40_000, 5), (5, "the of and thing " * 40_000, 5)], "doc_id long, text string, score int")
    got = sorted(((r.id or 0, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()), key=str)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and len(got) == 6 and got[-1][1] == got[-2][1] == "en"
    assert langid.identify(odd.limit(0), model).count() == 0
    # columns of the same names stay
    clash = langid.annotate(odd, model)
    assert clash.columns == ["doc_id", "text", "score", "lang_pred", "score_"] and {r.score for r in clash.collect()} == {5}
    for empty in (docs.where("lang is null"), docs.limit(0)):
        none = langid.fit(empty)
        assert none.languages == [] and {(r.lang_pred, r.score) for r in langid.identify(odd, none).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'de'"), sample=5)
    assert [p[:2] for p in langid.predict(one, ["word", "", None])] == [("de", 1.0), ("und", 0.0), ("und", 0.0)]


def test_the_sample_is_bounded(spark, monkeypatch):
    # two identifiers with very many rows and a very long text: a row for each, of a bounded size
    rows = [(i % 2, f"{'ab' if i % 2 else 'cd'} {i} " * 3, "x" if i % 2 else "y") for i in range(400)] + [(1, "ab " * 100_000, "x")]
    rows = [(1 if i else 2, t, y) for i, t, y in rows]
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels, **_: seen.append((texts, labels)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=160)
    (texts, labels), = seen
    assert labels == ["x", "y"] and len(texts) == 2
    # windows are drawn evenly from all of a text
    text = bytes(range(64)) * 3 + b"middle" + bytes(64 * 996 - 6) + b"end"
    assert langid.drawn_windows(text, 1000) == text
    few = langid.drawn_windows(text, 5)
    assert len(few) == 4 * 64 + 3 and few.startswith(bytes(range(64))) and few.endswith(b"end")
    assert few[64:128] == text[64 * 249 : 64 * 250]


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands far behind what does not."""
    same = "the of and " * 20_000
    docs = [(i, same + (" zug zig zag" if i % 2 else " bim bam bum") * 4000, "x" if i % 2 else "y") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = quality.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = [quality.score_text(t, model) for t in ("zug zig zag " * 50, "bim bam bum " * 50)]
    assert got[0] > 0.5 > got[1]
    mix = mixing.learn(df.select(F.col("doc_id").alias("id"), "text"), df.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")))
    assert any("z" in f for f in mix.features) and any("b" in f for f in mix.features)
    # documents count in the order of their hashes as far as the bound on features goes
    few = quality.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), features=30)
    assert not few.part.any()


def test_language_equals_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    model = langid.train([b"abc abd " * 60, b"xyz xxy " * 60, bytes(range(97, 123)) * 9], ["a", "x", "z"], steps=30)
    sig = lambda v: 1 / (1 + math.exp(-v))
    h = langid.HIDDEN

    def run(symbols, side):
        state, out = [0.0] * h, []
        for s in symbols:
            a, u = model.inputs[side][s], model.recurrent[side]
            dot = lambda j: sum(state[i] * float(u[i, j]) for i in range(h))  # noqa: E731,B023
            z, r = [sig(a[j] + dot(j)) for j in range(h)], [sig(a[h + j] + dot(h + j)) for j in range(h)]
            c = [math.tanh(a[2 * h + j] + r[j] * dot(2 * h + j)) for j in range(h)]
            state = [x + g * (y - x) for x, g, y in zip(state, z, c, strict=True)]
            out.append(state)
        return out

    for text in ["abc xyz", "é" * 50 + " abd", "".join(rng.choice(list("abcxyz "), 150))]:
        data = text.encode()
        total = np.zeros(len(model.languages))
        for k in range(0, len(data), langid.WINDOW):
            window = [*data[k : k + langid.WINDOW]]
            padded = window + [langid.PAD] * (langid.WINDOW - len(window))
            one, two = run(padded, 0), run(padded[::-1], 1)[::-1]
            for t in range(len(window)):
                score = np.array([*one[t], *two[t]]) @ model.out + model.bias
                total += np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        lang, p, _ = langid.predict(model, [text])[0]
        assert lang == model.languages[int(total.argmax())] and math.isclose(p, total.max() / len(data), rel_tol=1e-3)


def test_every_byte_is_read(spark):
    docs, _ = rows_of(spark, 100)
    model = langid.fit(docs, sample=10)
    text = "the of and " * 100
    ends = langid.predict(model, [text, text + "zq qz zzq " * 300, "zq qz zzq " * 300 + text])
    assert ends[0][0] == "en" and ends[1][0] == ends[2][0] == "xx"
    # pooled by hand: the mean over all positions of all windows
    data = text.encode()
    p = model.probabilities(langid.windows_of(data)).reshape(-1, len(model.languages))[: len(data)].mean(axis=0)
    assert math.isclose(p.max(), ends[0][1], rel_tol=1e-4)
    many = langid.predict(model, [text, None, text * 3, "x"] * 5)
    assert many[0] == many[4] or math.isclose(many[0][1], many[4][1], rel_tol=1e-6)


def test_backpropagation_learns_context():
    # both languages have the same bytes; only their order tells them apart
    model = langid.train([b"ab" * 400, b"aabb" * 200], ["x", "y"], steps=120)
    got = langid.predict(model, ["ab" * 100, "aabb" * 50])
    assert [g[0] for g in got] == ["x", "y"] and min(g[1] for g in got) > 0.8


# --- quality ----------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    rng = np.random.default_rng(3)
    good, bad = ["river", "stone", "garden", "lantern", "measure"], ["BUY!!", "cl1ck", "fr33", "w1n!!", "$$$"]
    docs = [(i, " ".join(rng.choice(good if i % 4 else bad, 30))) for i in range(300)]
    marks = [(i, int(bool(i % 4)), 7) for i in range(300)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, text int")
    model = quality.fit(d, m.select("doc_id", "quality"))
    got = {r.id: r.score for r in quality.score(d, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(i % 4) for i in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "river"), (4, "river stone " * 100_000), (4, "word" * 500_000)], "doc_id long, text string")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    assert quality.score(odd.limit(0), model).count() == 0
    # one label, none, or no rows: the prior, whatever the text
    for marks_, low in ((m.select("doc_id", F.lit(1).alias("quality")), 0.9), (m.select("doc_id", F.lit(None).cast("int").alias("quality")), 0.4), (m.limit(0), 0.4)):
        flat = {r.score for r in quality.score(odd, quality.fit(d, marks_)).collect()}
        assert len(flat) == 1 and flat.pop() > low
    assert quality.score(d.limit(0), quality.fit(d.limit(0), m)).count() == 0


def test_quality_equals_an_unhashed_trainer():
    texts, labels = ["river stone", "buy buy now", "stone garden river", "now click"], [1, 0, 1, 0]
    model = quality.train(texts, labels, epochs=3)
    rng = np.random.default_rng(3)
    vectors = {k: v for k, v in enumerate(((rng.random((quality.BUCKETS, quality.DIM)) - 0.5) / quality.DIM).astype(np.float32))}
    w, bias, step = np.zeros((quality.DIM, 2)), np.zeros(2), 0
    for _ in range(3):
        for i in rng.permutation(len(texts)):
            ids = quality.buckets(texts[i]).tolist()
            mean = sum(vectors[k] for k in ids) / len(ids)
            e = np.exp(mean @ w + bias)
            p = e / e.sum() - np.eye(2)[labels[i]]
            rate, back = quality.RATE * (1 - step / 12), w @ p
            w, bias, step = w - rate * np.outer(mean, p), bias - rate * 0.1 * p, step + 1
            for k in set(ids):
                vectors[k] = vectors[k] - rate * ids.count(k) / len(ids) * min(len(set(ids)), 200) * back
    for t in [*texts, "garden now", ""]:
        ids = quality.buckets(t).tolist()
        mean = sum((vectors[k] for k in ids), np.zeros(quality.DIM)) / max(1, len(ids))
        e = np.exp(mean @ w + bias)
        assert math.isclose(quality.score_text(t, model), e[1] / e.sum(), rel_tol=1e-3)


def test_features_are_those_of_the_words():
    text = "ab  abc abc\nd"
    got = sorted(quality.buckets(text).tolist())
    # one bucket a word, one for the word said twice, and n-grams of ' ab ', ' abc ', ' abc ', ' d '
    grams = sum(max(0, len(w) + 2 - n + 1) for w in text.split() for n in (3, 4, 5))
    assert len(got) == 4 + 1 + grams and got.count(quality.SAME) >= 1
    assert sorted(quality.buckets("abc d").tolist()) == sorted(quality.buckets(" abc\td ").tolist())
    assert len(quality.buckets("")) == 0 and len(quality.buckets(None)) == 0
    before, quality.PIECE = quality.PIECE, 4
    try:
        whole = sorted(x for x in quality.buckets(text).tolist() if x != quality.SAME)
    finally:
        quality.PIECE = before
    assert whole == [x for x in got if x != quality.SAME]


# --- mixing -----------------------------------------------------------------------------------------------------------
def test_mixing_meets_targets(spark):
    docs, truth = rows_of(spark)
    docs = docs.where("doc_id % 4 <> 1 or doc_id % 3 = 0").withColumn("rate", F.lit(9))
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    want = {"en": 1.0, "de": 1.0, "fr": 2.0, "xx": 4.0}
    mix, rows = mixing.fit(docs, labelled, targets=want)
    n = [r.asDict() for r in rows.collect()]
    for k in range(4):
        reached = sum(r["n"] * r["rate"] * r[f"__p{k}"] for r in n)
        assert math.isclose(reached, mix.targets[k], rel_tol=0.03) and math.isclose(reached, mix.reached[k], rel_tol=1e-6)
    assert min(r["rate"] for r in n) >= 0 and all(math.isclose(sum(r[f"__p{k}"] for k in range(4)), 1) for r in n)
    assert all(math.isclose(r["rate"], max(0.0, 1 - sum(r[f"__p{k}"] * mix.steps[k] for k in range(4))), abs_tol=1e-6) for r in n)
    best = {r.id: r.domain for r in mixing.rates(docs, labelled, targets=want).collect()}
    held = [i for i in best if zlib.crc32(str(i).encode()) % 5 == 0]
    taught = labelled.where(~F.col("id").isin(held))
    best = {r.id: r.domain for r in mixing.rates(docs, taught, targets=want).collect()}
    assert sum(best[i] == truth[i] for i in held) >= 0.95 * len(held)


@pytest.mark.parametrize(("want", "floor"), [((8, 1, 1, 1), 0.0), ((50, 1, 1, 1), 0.5), ((1, 0, 0, 0), 0.0), ((1, 1000, 1, 1), 0.0)])
def test_mixing_reaches_the_optimum(spark, want, floor):
    """Harsh targets, on soft posteriors, against the least squares that numpy finds."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.7] * 4, 400) * 0.8 + 0.05
    t = rng.integers(1, 200, 400).astype(float)
    totals = t @ p
    targets = np.array(want) / sum(want) * totals.sum()
    scale = np.where(targets > 0, targets, totals)
    rows = spark.createDataFrame([(float(n), *map(float, x)) for n, x in zip(t, p, strict=True)], "n double, __p0 double, __p1 double, __p2 double, __p3 double")
    steps, reached = mixing._descend(rows, [f"__p{i}" for i in range(4)], targets, scale, float(totals.sum()), floor)
    got = np.maximum(floor, 1 - p @ np.array(steps))
    assert np.allclose((t * got) @ p, reached, rtol=1e-6)
    # plain projected gradient with momentum, for as long as it takes
    a = (p * t[:, None] / scale).T
    size = 1 / np.linalg.norm(a @ a.T, 2)
    r, before = np.ones(400), np.ones(400)
    for k in range(60_000):
        y = r + k / (k + 3) * (r - before)
        before, r = r, np.maximum(floor, y - size * (a.T @ (a @ y - targets / scale)))
    loss = lambda x: np.sum((a @ x - targets / scale) ** 2)
    assert loss(got) <= loss(r) * 1.001 + 1e-5 and np.allclose(a @ got, a @ r, atol=1e-2)


def test_null_and_repeated_ids_are_rounded_by_their_texts(spark):
    rows = [(None, f"aaa bbb {i}", "x") for i in range(200)] + [(1, f"zz yy {i}", "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(1, "y")], "id long, domain string")
    out = mixing.mixed(docs, labelled, total=600.0, targets={"y": 1.0})
    kept = out.groupBy("text").count().count()
    assert 0.3 < kept / 400 < 0.7  # a rate of a half, each row by itself


def test_mixing_features_equal_brute_force(spark):
    docs, truth = rows_of(spark, 60)
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    mix = mixing.learn(docs.select(F.col("doc_id").alias("id"), "text"), labelled)
    rows = docs.select("text", mixing.counts(F.col("text"), mix.features).alias("c"), mixing.grams(F.lower("text")).alias("g")).collect()
    for r in rows[:10]:
        assert [int(x) for x in r.c] == [r.text.lower().count(f) for f in mix.features]
        assert sorted(r.g) == sorted(r.text.lower()[i : i + n] for n in mixing.GRAMS for i in range(len(r.text) - n + 1))
    assert len(mix.features) == mixing.FEATURES and all(len(f) in mixing.GRAMS for f in mix.features)


def test_mixing_floor_and_copies(spark):
    docs, _ = rows_of(spark)
    docs = docs.where("doc_id % 4 <> 1 or doc_id % 12 = 1")
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    mix, rows = mixing.fit(docs, labelled, floor=1.0)
    assert rows.agg(F.min("rate")).first()[0] >= 1 and all(math.isclose(a, b, rel_tol=0.02) for a, b in zip(mix.reached, mix.targets, strict=True))
    out = mixing.mixed(docs, labelled, floor=1.0)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == docs.count() < out.count()


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "aaa bbb", None), (3, "zzz", "y"), (3, "zzz", "y")], "doc_id long, text string, lang string")
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))
    rows = mixing.rates(docs, labelled).collect()
    assert len(rows) == 5 and all(r.rate >= 0 and 0 <= r.posterior <= 1.0001 for r in rows)
    alone = mixing.rates(docs, labelled.limit(0)).collect()
    assert len(alone) == 5 and {r.domain for r in alone} == {None}
    assert mixing.rates(docs.limit(0), labelled).count() == 0 and mixing.mixed(docs.limit(0), labelled).count() == 0
    names = spark.createDataFrame([(1, "aaa", 1, 2, 3)], "doc_id long, text string, __seen int, __rate int, __p0 int")
    assert mixing.mixed(names, labelled, floor=1.0).collect()[0].asDict() == names.first().asDict()
    many = spark.createDataFrame([(i, f"text {i}", f"domain {i}") for i in range(80)], "doc_id long, text string, lang string")
    assert len(mixing.learn(many.select(F.col("doc_id").alias("id"), "text"), many.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))).domains) == 80
    with pytest.raises(ValueError, match="weights"):
        mixing.rates(docs, labelled, targets={"q": 1.0})
