"""Phrase collocation mining.

Texts are exploded into the n-grams of their pieces, rows (lang, phrase, count) that Spark aggregates by hash. A phrase that
is frequent enough has only frequent enough pairs of neighbouring words, so pairs are counted first, by hash, and n-grams
of three words and more become rows only where each of their pairs may be frequent: a hash never counts less than the pair
itself. Counts of first and last parts are joined, scores are decimals, phrases that a one-word extension explains go by an
anti-join, and windows rank the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.base import join_counted, materialise, small_batches

#: Bytes of text that are encoded at a time (a piece is never cut), and pairs that are counted before they become rows.
BLOCK, PAIRS = 1 << 21, 1 << 21
#: Bytes of a batch of texts that a worker takes, and rows of one that it gives: JVM and worker hold both, for each task.
TAKEN, GIVEN = 1 << 21, 100_000
#: Bits of the table that tells which pairs may be frequent; its size does not grow with the data.
BITS = 26
#: Bytes that a text which waits for others takes besides its own.
OBJECT = 64
#: Shares that phrases of a language are ranked in before the last ranking.
SHARES = 64
UNDETERMINED = "und"
#: A-Z to a-z; what ends a piece to a line feed; tabs to spaces. All are ASCII, so UTF-8 stays as it is.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
ROWS = [("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text) of rows (lang, text binary), normalised by TABLE, in blocks that end where a piece ends. Texts wait for
    more of their language; those of all languages are no more than four blocks."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, lang in enumerate(langs):
            text = bytes(texts[i].as_buffer() or b"").translate(TABLE)
            while len(text) > BLOCK:
                cut = text.rfind(b"\n", 0, BLOCK) + 1 or text.find(b"\n", BLOCK) + 1 or len(text)
                yield lang, text[:cut]
                text = text[cut:]
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + OBJECT
            total += len(text) + OBJECT
            for full in [lang] if sizes[lang] >= BLOCK else list(held) if total >= 4 * BLOCK else []:
                total -= sizes.pop(full)
                yield full, b"\n".join(held.pop(full))
    while held:
        lang, parts = held.popitem()
        yield lang, b"\n".join(parts)


class Words:
    """The words of a block: codes into a dictionary, and whether the next word is in the same piece."""

    def __init__(self, lang: str, data: bytes) -> None:
        a = np.frombuffer(data, np.uint8)
        word = (a != 10) & (a != 32)
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # what lies from a word's start to the next one's holds an end of a piece
        self.joined = ~np.logical_or.reduceat(a == 10, starts)[:-1] if len(starts) else np.zeros(0, bool)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        del edge, starts, ends
        found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a[word])]).dictionary_encode()
        self.codes, self.words = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
        seed = xxhash.xxh32_intdigest(lang)
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def pairs(self) -> np.ndarray:
        """A hash for each two neighbours (also for those that a piece ends between)."""
        h = self.hashes[self.codes] if len(self.codes) else self.hashes
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return x * np.uint64(0x94D049BB133111EB)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), text.alias("text"))


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """A table of 2 ** BITS bits, packed: set where the hash of a pair falls that stands least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            first = np.flatnonzero(np.diff(x, prepend=~x[:1], append=~x[-1:]))  # where each different one begins, and the end
            for k in range(0, len(first) - 1, GIVEN):
                at = first[k : k + GIVEN + 1]
                yield pa.RecordBatch.from_arrays([pa.array(x[at[:-1]].view(np.int64)), pa.array(np.diff(at))], ["h", "c"])

        for lang, data in _blocks(batches):
            words = Words(lang, data)
            held.append(words.pairs()[words.joined])
            n += len(held[-1])
            del words
            if n >= PAIRS:
                yield from out()
                n = 0
        if n:
            yield from out()

    # a pair seldom comes twice from a task: counting there as well would only hold its rows
    pairs = texts.mapInArrow(run, "h long, c long").repartition("h")
    counts = pairs.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    bits = counts.selectExpr(f"shiftrightunsigned(h, {64 - BITS}) as at").selectExpr("shiftright(at, 3) as byte", "shiftleft(1, int(at % 8)) as bit")
    with small_batches(texts.sparkSession, TAKEN):
        found = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** BITS / 8 rows at most
    table = np.zeros(1 << (BITS - 3), np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return table


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, c, words): each phrase of 1 to max_n words with c >= least occurrences; in a row with a null phrase
    the rest. words sums the occurrences of single words, so that its sum over a language is that of all its words."""
    spark: SparkSession = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    table = spark.sparkContext.broadcast(frequent_pairs(texts, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = table.value
        for lang, data in _blocks(batches):
            words = Words(lang, data)
            codes, n = words.codes, len(words.codes)
            if not n:
                continue
            phrases, counts = [w.decode("utf-8", "replace") for w in words.words], np.bincount(codes, minlength=len(words.words)).tolist()
            single = phrases[:]
            bit = words.pairs() >> np.uint64(64 - BITS)
            ok = words.joined & (may[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, part = np.arange(n), codes
            for size in range(2, max_n + 1):
                # phrases that go on by one word: part numbers the different ones before it
                go = at + size - 2 < n - 1
                at, part = at[go], part[go]
                go = ok[at + size - 2]
                at, part = at[go], part[go]
                if not len(at):
                    break
                _, first, part, c = np.unique(part * len(single) + codes[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
                phrases += [" ".join([single[k] for k in codes[i : i + size].tolist()]) for i in at[first].tolist()]
                counts += c.tolist()
            for k in range(0, len(phrases), GIVEN):
                some = phrases[k : k + GIVEN]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(counts[k : k + GIVEN], pa.int64())], [x for x, _ in ROWS])

    counted = texts.mapInArrow(run, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("c"))
    single = F.when(F.instr("phrase", " ") == 0, F.col("c")).otherwise(0)
    kept = counted.groupBy("lang", F.when(F.col("c") >= least, F.col("phrase")).alias("phrase")).agg(F.sum("c").alias("c"), F.sum(single).alias("words"))
    with small_batches(spark, TAKEN):
        return materialise(kept, "phrases")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    A phrase is 2 to max_n words of one piece and stands a >= least times; a piece ends at . , ; : ! ? or a line's end,
    words at spaces and tabs, and A-Z count as a-z. l and r are the counts of its first words and of the rest, at the cut
    with the lowest score floor(1000 a n / (l r)), the first of equal ones. A phrase goes if a longer one that holds it
    stands as often. Order: score and a descending, phrase by its bytes. Null languages count as und, null texts as empty;
    equal rows count each.
    """
    counted = phrase_counts(docs, lang_col, text_col, max_n, least)
    sums = materialise(counted.groupBy("lang").agg(F.sum("words").alias("n")), "phrase-words")
    known = counted.where("phrase is not null").select("lang", "phrase", "c")
    total = known.count()
    parts = F.split("phrase", " ")
    found = known.withColumn("w", parts).withColumn("size", F.size("w")).where("size > 1")
    # a longer phrase of equal count has a one-word extension of equal count
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    longer = found.where("size > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"), "c").distinct()
    left = found.join(longer, ["lang", "phrase", "c"], "left_anti")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("c").alias("a"), "k", F.struct("lang", joined(F.lit(1), F.col("k")).alias("p")).alias("first"), F.struct("lang", joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("p")).alias("rest"))
    cuts = materialise(cuts, "phrase-cuts")
    rows = cuts.count()
    for side, count in (("first", "l"), ("rest", "r")):
        # a word that many phrases begin or end with is a heavy key
        keyed = known.select(F.struct("lang", F.col("phrase").alias("p")).alias(side), F.col("c").alias(count))
        often = keyed.join(cuts.groupBy(side).agg(F.count("*").alias("often")), side)
        cuts = join_counted(cuts, often, side, "often", rows, total)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(sums), "lang")  # a row for each language
    # decimals of 38 digits: exact, and div cuts instead of rounding
    score = F.expr("cast(cast(1000 * a_ as decimal(24,0)) * n_ as decimal(38,0)) div cast(l_ * r_ as decimal(38,0))")
    cuts = cuts.withColumns({f"{c}_": whole(c) for c in "alrn"}).withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
