"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints are dealt into tiles by a cell number (population count, or a band of lengths). Only tiles whose
cells are within reach meet; inside a meeting, blocks whose population counts differ beyond the radius are skipped, and
the others are compared with exclusive-or and bit counts. A meeting emits a spanning forest of its links, never pairs.

Near-duplicates take such links as candidates only: inside each group that candidates connect, sets of shingles are
compared, and only pairs whose own similarity is high enough link.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import Links, blocks_for, components, join_counted, materialise, meet_by_number

SEED = 42
#: Distinct fingerprints in a tile, on average at most; a table of fewer is dealt into so many tiles (and one a cell more).
TILE, TILES = 262_144, 24
#: Fingerprints in a block inside a meeting of two tiles, and those that a block is compared with at a time.
BLOCK, WIDE = 64, 4096
#: Standard deviations by which the radius of candidates is wider than a similarity is expected to need.
WIDER = 4
#: Texts, and shingles in them, that are confirmed at a time, on average at most.
CHUNK, SHINGLES = 4096, 1 << 20


def _wide(data: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(data, seed) + xxhash.xxh3_128_digest(data, seed + 1)


DIGESTS = {64: xxhash.xxh64_digest, 128: xxhash.xxh3_128_digest, 256: _wide}


def _shingles(text: bytes, words: int) -> tuple[bytes, Iterable[tuple[int, int]]]:
    """The text in lower case with single spaces, and where in it each shingle starts and ends."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return norm, []
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(norm)]]).tolist()
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = [0], [len(norm)]
    return norm, zip(starts, ends, strict=True)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The set of a whole text's shingles, as sorted 64-bit hashes."""
    norm, spans = _shingles(text, words)
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(norm[a:b], SEED) for a, b in spans]), np.uint64))


def fingerprint(text: bytes, words: int, bits: int, distinct: bool = False) -> tuple[int, bytes]:
    """(number of shingles, fingerprint as bits/8 bytes, high bit first) of a UTF-8 text; A-Z counts as a-z.

    distinct: each different shingle counts once, so that a line repeated in a text does not outvote the rest of it.
    """
    norm, spans = _shingles(text, words)
    if not norm:
        return 0, bytes(bits // 8)
    digest = DIGESTS[bits]
    if distinct:
        spans = {norm[a:b]: (a, b) for a, b in spans}.values()
    ones, total = np.zeros(bits, np.int64), 0
    for some in batched(spans, 65_536):
        part = np.frombuffer(b"".join([digest(norm[a:b], SEED) for a, b in some]), np.uint8).reshape(-1, bits // 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return total, np.packbits(ones * 2 > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 64, distinct: bool = False, rid_col: str | None = None) -> DataFrame:
    """(id, shingles, ones, fp binary) of every row's whole text, and rid if there is a column of row numbers. A null text
    counts as empty: no shingle, fingerprint zero. Rows that repeat are all returned, as are null ids."""
    if bits not in DIGESTS:
        raise ValueError("bits is 64, 128 or 256")
    more = [rid_col] if rid_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", words, bits, distinct) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([int.from_bytes(f).bit_count() for _, f in found], pa.int32()), pa.array([f for _, f in found], pa.binary()), *batch.columns[2:]],
                ["id", "shingles", "ones", "fp", *more],
            )

    return rows.mapInArrow(run, "id long, shingles long, ones int, fp binary" + ", rid long" * bool(more))


def _words(fp: pd.Series) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(len(fp), -1)


class _Tile:
    """Fingerprints sorted by the population counts of their 16-bit parts, in blocks with the ranges of those counts."""

    def __init__(self, ids: np.ndarray, fp: np.ndarray) -> None:
        parts = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(len(fp), -1)).astype(np.int16)
        order = np.lexsort(parts.T[::-1])
        self.ids, self.fp, parts = ids[order], np.ascontiguousarray(fp[order]), parts[order]
        at = np.arange(0, len(ids), BLOCK)
        self.low, self.high = np.minimum.reduceat(parts, at), np.maximum.reduceat(parts, at)


def meet(a: _Tile, b: _Tile, radius: int, links: Links | _Ratio) -> None:
    """Add every link of at most radius differing bits between the tiles (or within one, if a is b)."""
    for i in range(len(a.low)):
        near = np.maximum(0, np.maximum(a.low[i] - b.high, b.low - a.high[i])).sum(axis=1) <= radius
        if a is b:
            near[:i] = False
        at = np.flatnonzero(np.repeat(near, BLOCK)[: len(b.ids)])
        own = slice(i * BLOCK, (i + 1) * BLOCK)
        ids, fp = a.ids[own], a.fp[own]
        for k in range(0, len(at), WIDE):
            part = at[k : k + WIDE]
            others = b.fp[part]
            differ = np.bitwise_count(fp[:, :1] ^ others[None, :, 0]).astype(np.uint8 if fp.shape[1] < 4 else np.uint16)
            for w in range(1, fp.shape[1]):
                differ += np.bitwise_count(fp[:, w : w + 1] ^ others[None, :, w])
            x, y = np.divmod(np.flatnonzero((differ <= radius).ravel()), len(part))
            if a is b:
                x, y = x[(up := i * BLOCK + x < part[y])], y[up]
            links.add(ids[x], b.ids[part[y]])


def link_components(prints: DataFrame, radius: int = 4, min_ratio: float | None = None, tile: int | None = None) -> DataFrame:
    """prints(id, shingles, ones, fp) -> (id, fp, component): the smallest id reachable over links, itself included.

    min_ratio: link only rows whose shingle counts are in this ratio at least, as similarity of so much needs; cells are
    then bands of that ratio, else population counts. Rows with equal fingerprints (and, with min_ratio, equal counts)
    are one node. prints must be a table that can be read again cheaply. tile: fingerprints in a tile, on average at most;
    each fingerprint is sent to the tiles of its own cell and of those in reach, once each.
    """
    spark = prints.sparkSession
    key = ["fp"] if min_ratio is None else ["fp", "shingles"]
    all_nodes = materialise(prints.groupBy(*key).agg(F.min("id").alias("id"), F.first("ones").alias("ones"), F.count("*").alias("rows")), "simhash-keys")
    nodes = all_nodes.drop("rows")
    if min_ratio is None:
        cell, reach = F.col("ones"), radius
    else:
        cell, reach = F.floor(F.log(F.greatest("shingles", F.lit(1))) / math.log(1 / min_ratio)).cast("int"), 1
    nodes = materialise(nodes.where("id is not null").withColumn("cell", cell), "simhash-nodes")
    counts = {r.cell: r["count"] for r in nodes.groupBy("cell").count().collect()}  # a row for each cell: few
    size = tile or min(TILE, sum(counts.values()) // TILES + 1)
    first, ends = {}, {}
    for c in sorted(counts):
        first[c] = max(ends.values(), default=0)
        ends[c] = first[c] + blocks_for(counts[c], size)
    # tiles are numbered by cell, so those in reach of a cell are one range of numbers
    near = {c: [o for o in counts if abs(o - c) <= reach] for c in counts}
    deal = [(c, first[c], ends[c] - first[c], min(first[o] for o in near[c]), max(ends[o] for o in near[c]) - 1) for c in counts]
    dealt = nodes.join(F.broadcast(spark.createDataFrame(deal, "cell int, first int, blocks int, low int, high int")), "cell")  # a row of numbers for each cell
    dealt = dealt.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("id", "fp", *([] if min_ratio is None else ["shingles"]), "tile", F.explode(F.sequence("low", "high")).alias("other"))
    dealt = dealt.select("id", "fp", *([] if min_ratio is None else ["shingles"]), F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") > F.col("other")).alias("second"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        links = Links()
        one, two = pdf[~pdf.second], pdf[pdf.second]
        tiles = [_Tile(x.id.to_numpy(), _words(x.fp)) for x in (one, two) if len(x)]
        if pdf.t1.iloc[0] == pdf.t2.iloc[0]:
            held = links if min_ratio is None else _Ratio(pdf, min_ratio, links)
            meet(tiles[0], tiles[0], radius, held)
        elif len(tiles) == 2:
            held = links if min_ratio is None else _Ratio(pdf, min_ratio, links)
            meet(tiles[0], tiles[1], radius, held)
        a, b = links.folded()
        return pd.DataFrame({"a": a, "b": b})

    edges = dealt.groupBy("t1", "t2").applyInPandas(compare, "a long, b long")
    roots = components(edges)
    # a fingerprint of very many rows, as copies and empty texts have, is a heavy key
    named = all_nodes.join(roots, F.col("id") == F.col("node"), "left").select(F.struct(*key).alias("key"), F.coalesce("root", "id").alias("component"), "rows")
    total = named.agg(F.sum("rows")).first()[0] or 0
    return join_counted(prints.withColumn("key", F.struct(*key)), named, "key", "rows", total).drop("key")


class _Ratio:
    """Passes on links between rows whose shingle counts are in the ratio."""

    def __init__(self, pdf: pd.DataFrame, ratio: float, links: Links) -> None:
        ids = pdf.id.to_numpy()
        order = np.argsort(ids)
        self.ids, self.n, self.ratio, self.links = ids[order], pdf.shingles.to_numpy()[order], ratio, links

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n, m = self.n[np.searchsorted(self.ids, a)], self.n[np.searchsorted(self.ids, b)]
        ok = np.minimum(n, m) >= self.ratio * np.maximum(n, m)
        self.links.add(a[ok], b[ok])


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits expected at a Jaccard similarity, and WIDER standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + WIDER * math.sqrt(bits * share * (1 - share)))


def confirmed(sets: list[np.ndarray], least: float, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between sets of a Jaccard similarity of least or more that connect all that such pairs connect.

    With first, only the first so many sets are compared with the others. Sets that links connect already are not
    compared, so a group of copies takes about a comparison for each member. Empty sets are equal.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.any() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(codes) + 1, bool)
    root, out = np.arange(m), []
    for a in range(first or m):
        own = codes[starts[a] : starts[a + 1]]
        held[own] = True
        others = np.arange(first or a + 1, m)
        n = sizes[others]
        others = others[(root[others] != root[a]) & (np.minimum(n, sizes[a]) >= least * np.maximum(n, sizes[a]))]
        # a few of each connected part first: one link spares the rest of it
        others = others[np.argsort(root[others], kind="stable")]
        of = root[others]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        low, high = 0, 4
        while len(others) and low <= rank.max():
            b = others[(rank >= low) & (rank < high) & (root[others] != root[a])]
            low, high = high, high * 8
            if not len(b):
                continue
            n = sizes[b]
            if sizes[a]:
                at = np.cumsum(n) - n
                both = np.add.reduceat(held[codes[np.arange(n.sum()) + np.repeat(starts[b] - at, n)]], at, dtype=np.int64)
                b = b[both / (sizes[a] + n - both) >= least]
            if len(b):
                out.append((np.full(len(b), a), b))
                root[np.isin(root, root[b])] = root[a]
        held[own] = False
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def confirmed_components(texts: DataFrame, candidates: DataFrame, similarity: float, words: int) -> DataFrame:
    """texts(rid, text), candidates(rid, id, component, shingles) -> (node, root), linking ids of a component whose sets of shingles are of that similarity or more.

    Large components are dealt into chunks of which each two meet; small ones are confirmed many at a time. Both must be
    tables that can be read again cheaply, with the row numbers that the texts were written with. Only the sets of texts in
    components of several move.
    """
    sizes = candidates.groupBy("component").agg(F.count("*").alias("m"), F.sum("shingles").alias("s")).where("m > 1")
    sizes = materialise(sizes.withColumn("chunks", F.ceil(F.greatest(F.col("m") / CHUNK, F.col("s") / SHINGLES)).cast("int")), "near-sizes")
    members, shingles = sizes.agg(F.sum("m"), F.sum("s")).first()
    batches = max((members or 0) // CHUNK, (shingles or 0) // SHINGLES) + 1
    # a batch of small components, or a large one by itself
    sizes = sizes.select("component", F.greatest("chunks", F.lit(1)).alias("chunks"), "m")
    batch = F.when(F.col("chunks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(batches)))
    chosen = join_counted(candidates.select("rid", "id", "component"), sizes, "component", "m", members or 0).select("rid", "id", "component", "chunks", batch.alias("batch"), (F.col("chunks") > 1).alias("large"))
    chosen = materialise(chosen, "near-candidates")
    rows = meet_by_number(texts.select("rid", "text"), chosen, "near-chosen").select("id", "component", "chunks", "batch", "large", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(x.as_py() or b"", words).tobytes() for x in batch.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], found], ["id", "component", "chunks", "batch", "large", "shingles"])

    rows = materialise(rows.mapInArrow(hashed, "id long, component long, chunks int, batch long, large boolean, shingles binary"), "near-sets")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("id", "component", "batch", "large", "shingles", F.least("chunk", "other").alias("t1"), F.greatest("chunk", "other").alias("t2"), (F.col("chunk") > F.col("other")).alias("second"))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        links, apart = Links(), pdf.t1.iloc[0] != pdf.t2.iloc[0]
        for _, part in pdf.sort_values(["component", "second", "id"]).groupby("component", sort=False):
            first = int((~part.second).sum()) if apart else 0
            if apart and first in (0, len(part)):
                continue
            ids = part.id.to_numpy()
            a, b = confirmed([np.frombuffer(x, np.uint64) for x in part.shingles], similarity, first)
            links.add(ids[a], ids[b])
        a, b = links.folded()
        return pd.DataFrame({"a": a, "b": b})

    return components(rows.groupBy("large", "batch", "t1", "t2").applyInPandas(confirm, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """(id, component) of every document, linking texts whose Jaccard similarity on sets of word shingles is that much or more.

    Fingerprints give candidates, of which each link is confirmed on the whole sets (as 64-bit hashes). With 256 bits, two
    unrelated ones lie within the radius with a probability of some 1e-17, so that components of candidates are groups of
    like texts even among 1e10 of them (with 128 bits it was 1.5e-7, and they would all hang together). Null and empty
    texts have no shingle and link with each other. A null id links with nothing and keeps a null component.
    """
    _, found = _near(docs, id_col, text_col, words, similarity, bits)
    return found.select("id", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 256) -> DataFrame:
    """docs without those that near_duplicates() has under another component than their own id. Rows with a null id stay, as
    do rows that repeat the id that stays. Whole rows are written once and do not move."""
    texts, found = _near(docs, id_col, text_col, words, similarity, bits)
    stays = found.where("id is null or id = component").select("rid")
    return meet_by_number(texts.select("rid", "carried"), stays, "near-stays").select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])


def _near(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows as they were written and numbered, and (rid, id, component) of each."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("carried"))
    texts = materialise(rows, "near-texts").withColumn("text", F.col("carried").getField(text_col).cast("binary"))
    prints = materialise(fingerprints(texts, "id", "text", words, bits, distinct=True, rid_col="rid"), "simhash")
    candidates = link_components(prints, radius_for(similarity, bits), similarity).where("id is not null").select("rid", "id", "component", "shingles")
    roots = confirmed_components(texts, materialise(candidates, "near-linked"), similarity, words)
    named = prints.select("rid", "id").join(roots, F.col("id") == F.col("node"), "left")
    return texts, materialise(named.select("rid", "id", F.coalesce("root", "id").alias("component")), "near-components")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint hex, component) of every row; 64 bits, links at radius or fewer differing bits."""
    prints = materialise(fingerprints(docs, id_col, text_col, words, 64), "simhash")
    return link_components(prints, radius).select("id", F.lower(F.hex("fp")).alias("fingerprint"), "component")
