"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

One edit changes at most Q of a word's q-grams and moves the others by at most one place, so words one edit apart share one
of their Q + 1 rarest q-grams at nearly the same place. Words meet in groups by such a q-gram, place and length; a group has
an inverted index of (q-gram, place), of whose postings the shortest are merged for each word, the long ones are only asked
for what that found, and pairs above the bound of shared q-grams are verified.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import eq, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import BROADCAST_ROWS, materialise

#: Code points of a q-gram.
Q = 2
#: Words of a group, at least, that are dealt into blocks of which each two meet.
GROUP = 4096
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs loses a code point.
WORN = 199


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, least: int = 5) -> DataFrame:
    """(word, n): the runs of letters of all texts in lower case, n times in all; a run whose hash with its document's id
    says so has lost a code point. Null texts have none; a null id is hashed as an empty one."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), lowered(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # a run gets no longer, so that shorter ones need no hash
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"[a-z\\u00C0-\\u00FF]{{{length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    worn = F.when(h % WORN == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(worn.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def grams(word: str) -> list[str]:
    return [word[k : k + Q] for k in range(len(word) - Q + 1)]


class Index:
    """Words of one length and their postings: for each place the q-grams there, and the numbers of the words that have it,
    ascending."""

    def __init__(self, places: int) -> None:
        self.words: list[tuple] = []
        self.grams: list[list[str]] = []
        self.postings: list[dict[str, list[int]]] = [defaultdict(list) for _ in range(places)]

    def add(self, word: tuple, own: list[str]) -> None:
        n = len(self.words)
        self.words.append(word)
        self.grams.append(own)
        for held, g in zip(self.postings, own, strict=True):
            held[g].append(n)

    def near(self, word: str, own: list[str], shift: int) -> Iterator[tuple]:
        """Words one edit from word, whose q-grams are own; those here are longer by shift (0 or 1).

        The words must share all q-grams but Q of the longer one's, at places that differ by shift at most. Of the lists of
        the word's q-grams, each the union of its places, so many shortest ones are merged that a word in none of them
        cannot share enough; what they hold is then counted in all.
        """
        need, none = len(own) + shift - Q, ()
        lists = [[p.get(g, none)] for p, g in zip(self.postings, own, strict=False)]
        if shift:
            lists = [[*x, p.get(g, none)] for x, p, g in zip(lists, self.postings[1:], own, strict=True)]
            lists.sort(key=lambda x: len(x[0]) + len(x[1]))
        else:
            lists.sort(key=lambda x: len(x[0]))
        merged = [p for x in lists[: len(own) - need + 1] for p in x if p]
        if not merged:
            return
        last = -1
        for n in merged[0] if len(merged) == 1 else heapq.merge(*merged):
            if n == last:
                continue
            last = n
            other = self.grams[n]
            same = map(eq, own, other)
            if sum(map(or_, same, map(eq, own, other[1:])) if shift else same) >= need and one_edit(word, self.words[n][0]):
                yield self.words[n]


def _rarest(word: str, often: dict[str, int]) -> list[tuple[str, int]]:
    """The Q + 1 rarest q-grams and their places."""
    found = [(often[g], g, k) for k, g in enumerate(grams(word))]
    return [(g, k) for _, g, k in sorted(found)[: Q + 1]]


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n), distinct and of 2 Q code points or more -> (a, a_n, b, b_n): each two words that are one edit
    apart, both ways round. words must be a table that can be read again cheaply.

    A large group is dealt into blocks: a word is sent to each meeting of its block, so a meeting never holds more than two
    blocks, and no pair is lost.
    """

    def all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = defaultdict(int)
            for w in batch.column(0).to_pylist():
                for g in grams(w):
                    found[g] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["g", "c"])

    told = words.select("word").mapInArrow(all_grams, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))
    often = {r.g: r.c for r in told.collect()}  # of letters of RUN there are 90, so 8,100 rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word meets those of its own length and those one longer in its own groups, and shorter ones in theirs."""
        for batch in batches:
            out = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, k in _rarest(w, often):
                    out.append((f"{g}{len(w)}:{k}", w, n, False))
                    out += [(f"{g}{len(w) - 1}:{p}", w, n, True) for p in (k, k - 1) if p >= 0]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["key", "word", "n", "longer"])

    dealt = materialise(words.select("word", "n").mapInArrow(deal, "key string, word string, n long, longer boolean"), "variant-groups")
    sizes = materialise(dealt.groupBy("key").agg(F.count("*").alias("size")), "variant-sizes")
    total = sizes.agg(F.sum("size")).first()[0]
    most = max(GROUP, -(-(total or 0) // BROADCAST_ROWS))
    large = sizes.where(F.col("size") > most).select("key", F.ceil(F.col("size") / most).cast("int").alias("blocks"))  # BROADCAST_ROWS at most
    rows = dealt.join(F.broadcast(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = F.concat_ws(":", "key", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    rows = rows.select(meeting.alias("key"), "word", "n", "longer", "block")

    def meet(members: list[tuple]) -> Iterator[tuple]:
        """members: (word, n, longer, block). Words of one block meet where block and block are the same."""
        apart = len({m[3] for m in members}) > 1
        base, more = [m for m in members if not m[2]], [m for m in members if m[2]]
        if not base or len(base) + len(more) == 1:
            return
        length = len(base[0][0])
        same, longer = Index(length - Q + 1), Index(length - Q + 2)
        for m in more:
            longer.add(m, grams(m[0]))
        for w in base:  # a word meets those that came before it, and all longer ones
            own = grams(w[0])
            for index, shift in ((same, 0), (longer, 1)):
                for x in index.near(w[0], own, shift):
                    if not apart or w[3] != x[3]:
                        yield (w[0], w[1], x[0], x[1]) if w[0] < x[0] else (x[0], x[1], w[0], w[1])
            same.add(w, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        out: list[tuple] = []
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "a_n", "b", "b_n"])
        for _, group in groupby(members(), key=lambda m: m[0]):
            out += meet([m[1:] for m in group])
            if len(out) >= 50_000:
                yield table()
                out = []
        if out:
            yield table()

    # a number given to repartition() is kept: the work of a group is more than its bytes tell
    tasks = max(1, min(20_000, (total or 0) // 100_000 + 24))
    pairs = rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "a string, a_n long, b string, b_n long").distinct()
    pairs = materialise(pairs, "variant-pairs")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of word_counts().

    form is the most frequent word one edit away (ties: the first by code points) if it is times as frequent at least, else
    null; root is where following forms ends, the word itself if it has none; n_near counts the words one edit away. Empty
    tables and tables without such words give no rows; repeated rows count each.
    """
    words = materialise(word_counts(docs, id_col, text_col, max(length, 2 * Q), least), "variant-words")
    near = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    out = words.join(near, F.col("word") == F.col("a"), "left").drop("a")
    good = -F.col("best.m") >= times * F.col("n")
    out = materialise(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "variant-forms")
    # a form is more frequent than its word, so following forms ends; each round doubles the way
    steps = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        steps = materialise(steps.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.select("word", "root")
    return out.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
