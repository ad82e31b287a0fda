"""License scans, collocations and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from graphloom.llm import collocations, licenses, variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- licenses ---------------------------------------------------------------------------------------------------------
def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def plain_blocks(text, templates):
    w, out = license_words(text), set()
    for n, t in enumerate(templates):
        mine = set(t.words)
        for i in range(len(w)):
            block = w[i : i + len(t.words)]
            if w[i] in mine and (block == t.words if t.ordered else len(mine & set(block)) >= t.needed):
                out.add((n, t.label, i, round(len(mine & set(block)) / len(mine), 9)))
    return out


MADE = [licenses.Template("x", "a b c d e f a b", 0.8), licenses.Template("y", "é Ö1 k", 1.0), licenses.Template("z", "a a b", 1.0, True), licenses.Template("loose", "b c d", 0.3)]


def test_blocks_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "...", "CC BY", "cc-by cc by-nc CC\tBY", "All RIGHTS reserved", "all rights reserved", "K É ö1 k", "É Ö1 K", "é Ö1 k", "a" * 50, "general public general public license license"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [" ".join(rng.choice(["Permission", "is", "hereby", "granted", "free", "of", "charge", "to", "any", "person", "x", "license"]) for _ in range(40)) for _ in range(20)]
    texts += [licenses.NOTICES[11].text.upper().replace(" ", ", ").replace("CHARGE", "cost"), "a b c d e f a b " * 3000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, hits string")
    templates = [*MADE, *licenses.PHRASES, *licenses.NOTICES]
    got = defaultdict(set)
    for r in licenses.blocks(docs, templates).collect():
        found = (r.template, r.label, r.start, round(r.containment, 9))
        assert r.size == len(templates[r.template].words) and found not in got[r.id]
        got[r.id].add(found)
    for i, t in enumerate(texts):
        assert got[i] == plain_blocks(t, templates), t


def test_scan_of_odd_tables(spark):
    rows = [(None, "CC BY here"), (None, None), (5, "cc by cc by all rights reserved"), (5, "cc by cc by all rights reserved"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.id), r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels), r.score) for r in licenses.scan(docs, licenses.NOTICES, licenses.PHRASES).collect())
    twice = ("5", 7, 3, 0, 4, ("cc-by", "reserved"), ("cc-by", "reserved"), 1.0)
    assert out == sorted([("None", 3, 1, 0, 0, ("cc-by",), ("cc-by",), 1.0), ("None", 0, 0, None, None, (), (), 0.0), twice, twice, ("6", 0, 0, None, None, (), (), 0.0)], key=str)
    assert licenses.scan(docs.limit(0), licenses.NOTICES, licenses.PHRASES).count() == 0
    with pytest.raises(ValueError, match="word"):
        licenses.scan(docs, [licenses.Template("none", " ")], [])


# --- collocations -----------------------------------------------------------------------------------------------------
def plain_collocations(rows, max_n, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and c >= a and inside(p, q) for q, c in cand.items()):
                continue
            score, _, l, r = min((int(Fraction(1000 * a * n[lang], count[p[:k]] * count[p[k:]])), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "pairs"), [(collocations.BLOCK, collocations.PAIRS), (300, 50)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "PAIRS", pairs)
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "the", "und", "é", "É", "x1", "new", "York", "york", "city", "a", "of", " "])
    text = lambda: "".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "; "]) for _ in range(rng.randrange(0, 120)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(120)]
    rows += [("en", None), (None, None), ("", "a b a b a b"), ("en", "new york city of the new york city " * 60), ("en", "one long repeated passage of words " * 40), ("en", "same row twice"), ("en", "same row twice")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "lang string, text string, phrase int")
    got = collocations.collocations(docs, least=8, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    out = [tuple(r) for r in got.collect()]
    want = plain_collocations([(lang if lang is not None else None, t) for lang, t in rows], 5, 8, 40)
    # an empty language is one of its own, a null one is und
    want = [w for w in want if w[0] != ""]
    assert sorted(o for o in out if o[0] != "" and o[0] != "und") == [w for w in want if w[0] != "und"] and len(out) > 40
    und = plain_collocations([("und", t) for lang, t in rows if lang is None or lang == "und"], 5, 8, 40)
    assert sorted(o for o in out if o[0] == "und") == und


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(docs.limit(0)).count() == 0 and collocations.collocations(docs).count() == 0


def test_workers_hold_batches_of_a_few_mb(spark, monkeypatch, tmp_path):
    """12 MB of texts in one partition, with above half a million different pairs: no batch of them goes to or comes from a worker."""
    kind, log, key = type(spark.range(0)), str(tmp_path / "batches"), "spark.sql.execution.arrow.maxBytesPerBatch"
    plain, before = kind.mapInArrow, spark.conf.get(key)

    def watched(df, run, *args, **options):
        def noted(way, batch):
            with open(log, "a") as file:
                file.write(f"{way} {batch.nbytes}\n")
            return batch

        return plain(df, lambda batches: (noted("given", out) for out in run(noted("taken", b) for b in batches)), *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    word = "hex(1024 + (xxhash64(id * 2000 + i) & 1023))"
    docs = spark.range(0, 1000, 1, 1).selectExpr("'en' as lang", f"concat_ws(' ', transform(sequence(1, 2000), i -> {word})) as text")
    counted = collocations.phrase_counts(docs)
    assert counted.agg({"words": "sum"}).first()[0] == 2_000_000 and counted.where("phrase is not null").count() == 1024
    sizes = [line.split() for line in (tmp_path / "batches").read_text().splitlines()]
    assert {way for way, _ in sizes} == {"taken", "given"}
    assert max(int(n) for _, n in sizes) < 4_000_000 and spark.conf.get(key) == before


def test_products_beyond_64_bits(spark):
    """Counts as a large corpus has them are exact: the same expression on made counts."""
    a, n, l, r = 9_000_000_000, 8_000_000_000_000_000, 9_500_000_001, 9_100_000_007
    got = spark.sql(f"select cast(cast(1000 * cast({a} as decimal(19,0)) as decimal(24,0)) * cast({n} as decimal(19,0)) as decimal(38,0)) div cast(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)) as decimal(38,0)) as s").first().s
    assert got == 1000 * a * n // (l * r)


# --- variants ---------------------------------------------------------------------------------------------------------
def plain_words(rows, length, least):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= length
    return {w: n for w, n in count.items() if n >= least}


def plain_variants(words, times=5):
    cut = defaultdict(set)
    for w in words:
        cut[w].add(w)
        for k in range(len(w)):
            cut[w[:k] + "\x00" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for k in range(len(w)):
            if (o := w[:k] + w[k + 1 :]) in words:
                near[w].add(o)
                near[o].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def made_words(seed, n, letters="abé"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(n)]


@pytest.mark.parametrize("group", [variants.GROUP, 7])
def test_variants_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(variants, "GROUP", group)
    rng = random.Random(11)
    pool = made_words(1, 260)
    rows = [(i, " ".join(rng.choice(pool[: rng.choice([5, 60, 260])]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(None, "Straße STRASSE straßen ÄRGER ärger"), (7, None), (8, ""), (9, "1234 %%"), (9, "ärgerlich " * 9), (9, "ärgerlich " * 9), (10, "x" * 5000)]
    chain = ["wordaaaa"] * 5 + ["wordaaab"] * 25 + ["wordaabb"] * 125 + ["wordabbb"] * 700 + ["wordabb"] * 5
    rows += [(500 + k, " ".join(chain[k::7])) for k in range(7)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, word string")
    words = plain_words(rows, 6, 5)
    counted = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert counted == words and len(words) > 150
    out = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in variants.variants(docs).collect())
    want = plain_variants(words)
    assert out == want and any(w[1] and w[2] != w[1] for w in want)


def test_one_edit():
    pairs = [("abcdef", "abcdef", False), ("abcdef", "abcdeg", True), ("abcdef", "abdef", True), ("abdef", "abcdef", True), ("abcdef", "bacdef", False), ("abcdef", "abcd", False), ("ééé", "éeé", True), ("a", "", True)]
    assert all(variants.one_edit(a, b) is same for a, b, same in pairs)


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, "short words only here")], "doc_id long, text string")
    assert variants.variants(docs.limit(0)).count() == 0 and variants.variants(docs).count() == 0
