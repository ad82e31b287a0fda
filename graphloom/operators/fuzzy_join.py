"""Similarity join by the plain ratio that loses no pair: q-grams, prefix lists, then the longest common subsequence.

The ratio is 200 LCS / (a + b) of two lengths a and b. A pair of the least ratio has a common subsequence of some length c,
so that a - c characters go and b - c come; each of those takes at most two, each of these at most one of a's pairs of
neighbours away, and what stays has moved by a - c places at most one way and b - c the other. Pairs of neighbours are
ordered rarest first; two texts that keep k in common share one in the first n - k + 1 of either. Where lengths leave no
pair of neighbours certain, single characters take their place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import fuzzy
from graphloom.sources.scratch import materialise

#: Grams whose frequency is told to every task; rarer ones are all alike.
TOLD = 10_000


def common(a: int, b: int, least: float) -> int:
    """Characters that texts of these lengths share in order, at least, if their ratio is least or more."""
    return math.ceil(least * (a + b) / 200 - 1e-9)


def kept_pairs(a: int, b: int, least: float) -> int:
    """Pairs of neighbours that stay, at least; may be below 1."""
    return 3 * common(a, b, least) - a - b - 1


def lengths(a: int, least: float) -> range:
    """Lengths of texts that can reach the ratio with one of length a."""
    return range(math.ceil(a * least / (200 - least) - 1e-9), math.floor(a * (200 - least) / least + 1e-9) + 1)


def prefixes(text: str, least: float, often: dict[str, int], others: list[int]) -> list[tuple[str, int]]:
    """(gram, place) that a text is joined by: pairs of neighbours as far as some length of others needs them, and single
    characters if another length leaves no pair certain."""
    n, out = len(text), []
    reach = lengths(n, least)
    able = [b for b in others if b in reach]
    for size, need in ((2, [k for b in able if (k := kept_pairs(n, b, least)) >= 1]), (1, [common(n, b, least) for b in able if kept_pairs(n, b, least) < 1])):
        if need:
            grams = sorted((often.get(text[i : i + size], 0), text[i : i + size], i) for i in range(n - size + 1))
            out += [(g, i) for _, g, i in grams[: len(grams) - min(need) + 1]]
    return out


def _indexed(texts: DataFrame, least: float, often: dict[str, int], others: list[int], side: str) -> DataFrame:
    """(gram, place, id, length) of texts(id, text), columns named after the side."""
    types = [("gram", pa.string()), ("place", pa.int32()), ("id", pa.int64()), ("length", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            out = [(g, i, n, len(t)) for n, t in rows for g, i in prefixes(t, least, often, others)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])

    found = texts.select("id", "text").mapInArrow(run, "gram string, place int, id long, length int")
    return found.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in ("place", "id", "length")])


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (a_id, b_id) of written tables left and right (id, text), among them all pairs that reach the ratio."""
    if not 0 < least <= 100:
        raise ValueError("the least ratio is above 0 and 100 at most")
    both = left.select("text").unionByName(right.select("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                found.update(t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

    told = both.mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = {r.gram: r.n for r in told.orderBy(F.desc("n"), "gram").limit(TOLD).collect()}
    known = lambda df: sorted(r.n for r in df.select(F.length("text").alias("n")).distinct().collect())  # noqa: E731  a row for each length
    a, b = _indexed(left, least, often, known(right), "a"), _indexed(right, least, often, known(left), "b")
    total = F.col("a_length") + F.col("b_length")
    shared = F.ceil(least * total / 200 - 1e-9)
    goes, comes = F.col("a_length") - shared, F.col("b_length") - shared
    moved = F.col("b_place") - F.col("a_place")
    kind = F.when(3 * shared - total - 1 >= 1, 2).otherwise(1)
    fits = (goes >= 0) & (comes >= 0) & (moved >= -goes) & (moved <= comes) & (F.length("gram") == kind)
    return a.join(b, "gram").where(fits).select("a_id", "b_id").distinct()


def ratio_join(left: DataFrame, right: DataFrame, least: float, report: dict | None = None) -> DataFrame:
    """(a, b, score) of each two distinct texts of left(text) and right(text) whose ratio is least or more.

    Pairs that share a gram of their prefixes are first held against the count of grams that they must share in all; only
    those that pass are compared. Nulls and empty texts match nothing. A report is given the number of all pairs as "pairs",
    of those joined as "joined" and of those compared as "compared".
    """
    numbered = lambda df, name: materialise(df.select("text").where("text <> ''").distinct().withColumn("id", F.monotonically_increasing_id()), name)
    left, right = numbered(left, "ratio-left"), numbered(right, "ratio-right")
    pairs = candidates(left, right, least)
    pairs = pairs.join(left.select(F.col("id").alias("a_id"), F.col("text").alias("a")), "a_id").join(right.select(F.col("id").alias("b_id"), F.col("text").alias("b")), "b_id").select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a, b, fuzzy.ratio_of(a, b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if shares_enough(a, b, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "score"])

    scored = pairs.mapInArrow(compare, "a string, b string, score double")
    if report is not None:
        scored = materialise(scored, "ratio-compared")
        report |= {"pairs": left.count() * right.count(), "joined": pairs.count(), "compared": scored.count()}
    return scored.where(F.col("score") >= least)


def shares_enough(a: str, b: str, least: float) -> bool:
    """Whether two texts have as many grams in common as their lengths ask for."""
    need, size = kept_pairs(len(a), len(b), least), 2
    if need < 1:
        need, size = common(len(a), len(b), least), 1
    held = Counter(a[i : i + size] for i in range(len(a) - size + 1))
    for i in range(len(b) - size + 1):
        g = b[i : i + size]
        if held.get(g, 0):
            held[g] -= 1
            need -= 1
            if need <= 0:
                return True
    return need <= 0
