"""Which texts contain which needles: an equi-join on each needle's rarest trigram, confirmed on the whole strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.scratch import materialise

#: Characters of a gram; shorter needles are grams themselves.
GRAM = 3
#: Needles, and bytes of them, that go to every task at most; more are joined.
NEEDLES, NEEDLE_BYTES = 10_000, 1 << 20
#: Bytes of texts that a task looks at together, one text at least.
PIECE = 1 << 22


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text. Takes time in proportion to the text."""
    one = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    runs = one
    for k in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(one, k, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(runs, lambda g: g.isNotNull()))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text) of distinct needles(needle) and texts(text) where the needle is part of the text, capitals counting.

    An index of the texts' trigrams tells how rare each is; a needle is looked for only in the texts that have the rarest of
    its own, and nowhere if one of them is in no text. Needles of one or two characters are joined as grams of that length.
    Nulls and the empty needle are in nothing. No side is broadcast by assumption and no pair is made that shares no gram.
    """
    needles = materialise(needles.select("needle").where("needle <> ''").distinct(), "needles")
    texts = materialise(texts.select("text").where("text <> ''").distinct().withColumn("text_id", F.monotonically_increasing_id()), "texts")
    sizes = sorted(r.n for r in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM rows at most
    if not sizes:
        return needles.select("needle", F.col("needle").alias("text")).limit(0)
    held = F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes])).alias("gram")
    index = materialise(texts.select("text_id", held), "trigrams")
    often = index.groupBy("gram").agg(F.count("*").alias("texts"))
    # a short needle has no gram but itself
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))
    asked = needles.select("needle", F.explode(own).alias("gram"))
    found = asked.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("m"))
    rarest = found.where("m.texts > 0").select("needle", "m.gram")
    pairs = index.join(rarest, "gram").select("text_id", "needle")
    return pairs.join(texts, "text_id").where(F.contains("text", "needle")).select("needle", "text")


def held(needles: DataFrame, rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, needle) of each of rows and distinct needles(needle) where the needle is part of the row's text, as containing().

    Rows are read once and no text moves: every task has the needles, knows the texts that may hold one by a gram of it, and
    looks at these. Needles too many for that are joined with the texts.
    """
    needles = materialise(needles.select("needle").where("needle <> ''").distinct(), "needles")
    size = needles.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if size[0] > NEEDLES or size[1] > NEEDLE_BYTES:
        return rows.join(containing(needles, rows), "text").select("id", "needle")
    wanted = [r.needle for r in needles.orderBy("needle").collect()]  # NEEDLES at most
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
            ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
                piece, starts = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
                scan = scan or _Scan([w.encode() for w in wanted], piece)
                row, which = scan.found(piece, starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array([wanted[i] for i in which], pa.string())], ["id", "needle"])
                at = to

    return rows.where("text <> ''").mapInArrow(run, f"id {kind}, needle string")


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The run of n bytes at each place, as a number."""
    codes = data[: max(len(data) - n + 1, 0)].astype(np.int32)
    for k in range(1, n):
        codes = codes << 8 | data[k : len(codes) + k]
    return codes


class _Scan:
    """Looks for needles in UTF-8, where a character begins nowhere but at its own first byte. Each is known by that of its
    grams of three bytes (or of its own length) which is rarest in a first piece of texts."""

    def __init__(self, needles: list[bytes], piece: np.ndarray) -> None:
        self.needles, self.tables = needles, []
        for n in sorted({min(len(w), GRAM) for w in needles}):
            mine = {i: _codes(np.frombuffer(w, np.uint8), n) for i, w in enumerate(needles) if min(len(w), GRAM) == n}
            seen = np.zeros(1 << 8 * n, np.int32)
            grams = np.unique(np.concatenate(list(mine.values())))
            seen[grams] = np.arange(1, len(grams) + 1)
            often = np.bincount(seen[_codes(piece, n)], minlength=len(grams) + 1)
            by: dict[int, list[int]] = {}
            for i, codes in mine.items():
                by.setdefault(int(codes[often[seen[codes]].argmin()]), []).append(i)
            seen[:] = 0
            seen[list(by)] = np.arange(1, len(by) + 1)
            self.tables.append((n, seen, list(by.values())))

    def found(self, piece: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Places of texts, which begin at starts (the last one ends the piece), and of the needles in each."""
        rows, which = [], []
        for n, table, by in self.tables:
            grams = table[_codes(piece, n)]
            at = np.flatnonzero(grams)
            pairs = np.unique((np.searchsorted(starts, at, "right") - 1) * len(by) + grams[at] - 1)
            last, text = -1, b""
            for row, gram in zip((pairs // len(by)).tolist(), (pairs % len(by)).tolist(), strict=True):
                if row != last:
                    last, text = row, piece[starts[row] : starts[row + 1]].tobytes()
                here = [i for i in by[gram] if self.needles[i] in text]
                rows += [row] * len(here)
                which += here
        return np.array(rows, np.int64), which
