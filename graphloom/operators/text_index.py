"""A full-text index in immutable segments, whose postings lie in blocks that a search may skip.

A segment holds the texts of one addition: the terms of each text and how often it has them; postings in folders by a hash of the term and by level, in blocks of a term's
postings that count about as much; what each block counts at most; and tombstones of the texts
that it replaces in older segments. Statistics are merged over segments, less what tombstones take away, so that scores are
those of an index made at once. Compaction writes what is left as one segment.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.search import TERM, asked_terms, idf, scored, sized, top, weight
from graphloom.sources.scratch import materialise

#: Folders that terms, and identifiers, are dealt into by hash; blocks of a term in a segment at most.
BUCKETS, LEVELS = 16, 8
#: What tells a block.
PLACE = ["segment", "bucket", "level", "field", "term", "often"]
#: Postings that a task sorts into folders, about: every task writes a file in each, and files cost more than their rows.
SORTED = 1 << 23
#: BM25's parameters that levels are made by; a search may take others, its bounds hold for any.
K1, B = 1.2, 0.75
#: How far apart scores may be that count as equal.
SLACK = 2e-9


def _hashed(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def counted(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(id, row, mark, field, dl, terms, tfs) of each field of rows(id, x): distinct terms and how often each is there; row
    tells rows apart, mark is a hash of x. A row is counted where it is."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, field in enumerate(fields, 3):
                    each = [Counter(find(t)) for t in part.column(i).to_pylist()]
                    lengths = pa.array([sum(c.values()) for c in each], pa.int32())
                    said, often = [list(c) for c in each], [list(c.values()) for c in each]
                    columns = [*part.columns[:3], pa.array([field] * len(part), pa.string()), lengths, pa.array(said, pa.list_(pa.string())), pa.array(often, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "row", "mark", "field", "dl", "terms", "tfs"])

    texts = rows.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("x").alias("mark"), *[F.lower(X.blank(F.col("x")[f])).alias(f"text{i}") for i, f in enumerate(fields)])
    return texts.mapInArrow(run, f"id {kind}, row long, mark long, field string, dl int, terms array<string>, tfs array<int>")


class SegmentedIndex:
    """The index under a folder. fields and the name of the identifier are those of the rows that are added."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], id_col: str = "id", id_type: str = "string") -> None:
        self.spark, self.folder, self.fields, self.id_col, self.id_type = spark, folder, fields, id_col, id_type
        self.schemas = {
            "docs": f"id {id_type}, row long, mark long, field string, dl int, terms array<string>, tfs array<int>, segment int, part int",
            "gone": f"id {id_type}, of int, field string, dl int, terms array<string>, segment int",
            "postings": f"id {id_type}, field string, term string, tf long, dl int, often int, segment int, bucket int, level int",
            "blocks": "field string, term string, often int, n long, max_tf long, min_dl int, level int, segment int, bucket int",
            "stats": "field string, n long, dl long, segment int",
            "done": "base int, segment int",
        }

    # --- what is there --------------------------------------------------------------------------------------------------
    def _read(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], self.schemas[name])

    def _state(self) -> tuple[int, int]:
        """The oldest segment that counts, and the newest; (0, -1) of an empty index."""
        found = self._read("done").agg(F.max("base"), F.max("segment")).first()
        return (found[0], found[1]) if found[0] is not None else (0, -1)

    def _live(self, name: str, base: int, last: int) -> DataFrame:
        return self._read(name).where(F.col("segment").between(base, last))

    def _docs(self, base: int, last: int) -> DataFrame:
        """Texts with a term; a segment keeps a row of those without, too."""
        return self._live("docs", base, last).where("dl > 0")

    def _tombstones(self, base: int, last: int) -> DataFrame:
        """Of what segments from base on have replaced in each other; what was before base has gone with it."""
        return self._live("gone", base, last).where(F.col("of") >= base)

    def _without(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """rows (id, segment, ..) without those that a tombstone is for."""
        return rows.join(sized(gone.select("id", F.col("of").alias("segment")).distinct()), ["id", "segment"], "left_anti")

    # --- writing --------------------------------------------------------------------------------------------------------
    def _put(self, df: DataFrame, name: str, segment: int, by: tuple[str, ...] = ()) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}/segment={segment}")

    def _put_docs(self, docs: DataFrame, segment: int) -> DataFrame:
        """counted() as the segment's texts; as they are written."""
        self._put(docs.withColumn("part", _hashed("id")), "docs", segment, ("part",))
        return self._read("docs").where(F.col("segment") == segment)

    def _put_postings(self, segment: int) -> None:
        """Statistics, postings and blocks of the texts that a segment has."""
        docs = self._docs(segment, segment)
        stats = materialise(docs.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("dl"), F.sum(F.size("tfs")).alias("postings")), "index-stats")
        self._put(stats.select("field", "n", "dl"), "stats", segment)
        rows = stats.agg(F.sum("postings")).first()[0] or 0
        tasks = max(math.ceil(rows / SORTED), min(self.spark.sparkContext.defaultParallelism, math.ceil(8 * rows / SORTED)), 1)
        mean = stats.select("field", (F.col("dl") / F.col("n")).alias("avgdl"))
        share = weight(F.col("tf"), F.col("dl"), F.col("avgdl"), K1, B) / (K1 + 1)
        each = docs.coalesce(tasks).join(F.broadcast(mean), "field")  # a row for each field
        postings = each.select("id", "field", "dl", "avgdl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("id", "field", "dl", "avgdl", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"))
        # postings of a level that have about as many occurrences differ in length alone, which keeps their bound near
        often = F.when(F.col("tf") < 4, F.col("tf")).otherwise(F.floor(F.log2("tf")) + 2).cast("int").alias("often")
        postings = postings.select("id", "field", "term", "tf", "dl", often, _hashed("term").alias("bucket"), F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level"))
        self._put(postings, "postings", segment, ("bucket", "level"))
        written = self._read("postings").where(F.col("segment") == segment)
        blocks = written.groupBy("field", "term", "often", "level", "bucket").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        self._put(blocks, "blocks", segment, ("bucket",))

    def _finish(self, segment: int, base: int) -> None:
        """From now on the segment counts."""
        self._put(self.spark.createDataFrame([(base,)], "base int").coalesce(1), "done", segment)

    def _bury(self, ids: DataFrame, base: int, last: int, segment: int) -> None:
        """Tombstones of the texts that ids have in the segments so far; only the folders of ids are read."""
        parts = [r.part for r in ids.select(_hashed("id").alias("part")).distinct().collect()]  # BUCKETS at most
        old = self._docs(base, last).where(F.col("part").isin(parts)).join(ids, "id", "left_semi")
        old = self._without(old, self._tombstones(base, last))
        self._put(old.select("id", F.col("segment").alias("of"), "field", "dl", "terms"), "gone", segment)

    def add(self, rows: DataFrame) -> None:
        """Add rows, in place of what their identifiers had before. Null identifiers are left out; of rows that repeat one the
        greatest by hash counts. What is not marked as done, as an addition failed, is not read and is written over."""
        base, last = self._state()
        rows = rows.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast(self.id_type).alias("id"), F.struct(*self.fields).alias("x"))
        docs = self._put_docs(counted(rows, self.fields), last + 1)
        ids = docs.where(F.col("field") == self.fields[0])  # a row for each that was added
        repeated = ids.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("mark", "row")).getField("row").alias("best")).where("n > 1")
        repeated = materialise(repeated.select("id", "best"), "index-repeated")
        if not repeated.isEmpty():
            left = docs.join(sized(repeated), "id", "left").where("best is null or best = row").drop("best", "segment", "part")
            docs = self._put_docs(materialise(left, "index-docs"), last + 1)
            ids = docs.where(F.col("field") == self.fields[0])
        self._bury(ids.select("id"), base, last, last + 1)
        self._put_postings(last + 1)
        self._finish(last + 1, base)

    def remove(self, ids: DataFrame) -> None:
        """Take texts of ids(id) away."""
        base, last = self._state()
        self._bury(ids.select(F.col("id").cast(self.id_type).alias("id")).distinct(), base, last, last + 1)
        self._finish(last + 1, base)

    def compact(self) -> None:
        """Write what counts as one segment, which all searches after that read alone."""
        base, last = self._state()
        gone = materialise(self._tombstones(base, last), "index-gone")
        self._put_docs(self._without(self._docs(base, last), gone).drop("segment", "part"), last + 1)
        self._put_postings(last + 1)
        self._finish(last + 1, last + 1)

    # --- searching ------------------------------------------------------------------------------------------------------
    def search(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, report: dict | None = None) -> DataFrame:
        """(query_id, id, score, pos): the k best of each query by BM25, ties by id, as an index made at once gives them.

        The blocks that count most are read first. Their scores can only grow, so that the k-th of them is a bound; a block is
        read only if what it counts at most, with the most of the query's other terms, reaches it. A query that says what must
        be there or not reads all blocks of its terms. A report is given the postings of the terms as "all", of these read as
        "read".
        """
        base, last = self._state()
        asked = materialise(asked_terms(queries).withColumn("bucket", _hashed("term")), "index-asked")
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        blocks = self._live("blocks", base, last).where(F.col("bucket").isin(buckets)).join(sized(asked.select("term").distinct()), "term", "left_semi")
        blocks = materialise(blocks, "index-blocks")
        gone = materialise(self._tombstones(base, last), "index-gone")
        stats = self._live("stats", base, last).select("field", "n", "dl").unionByName(gone.select("field", F.lit(-1).cast("long").alias("n"), (-F.col("dl")).cast("long").alias("dl")))
        totals = stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n > 0").select("field", "n", (F.col("dl") / F.col("n")).alias("avgdl"))
        totals = materialise(totals, "index-totals")
        lost = gone.select("field", F.explode("terms").alias("term")).join(sized(asked.select("term").distinct()), "term", "left_semi").select("field", "term", F.lit(-1).cast("long").alias("n"))
        df = blocks.select("field", "term", "n").unionByName(lost).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")
        df = materialise(df, "index-df")
        # what each block counts at most, for each query
        most = idf(F.col("total"), F.col("df")) * weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)
        bounds = blocks.join(F.broadcast(totals.withColumnRenamed("n", "total")), "field").join(df, ["field", "term"])
        bounds = bounds.join(sized(asked.select("query_id", "term", "need", "banned")), "term").withColumn("most", most)
        bounds = bounds.withColumn("whole", F.max(F.when((F.col("need") > 0) | F.col("banned"), 1).otherwise(0)).over(Window.partitionBy("query_id")) == 1)
        mine = Window.partitionBy("query_id", "field", "term")
        bounds = bounds.withColumn("list_most", F.max("most").over(mine))
        before = F.coalesce(F.sum("n").over(mine.orderBy(F.desc("most"), "segment", "level", "often").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bounds = materialise(bounds.withColumn("first", ~F.col("whole") & (before < k)), "index-bounds")
        sums = bounds.select("query_id", "field", "term", "list_most").distinct().groupBy("query_id").agg(F.sum("list_most").alias("all_most"))
        place = PLACE
        early = scored(self._postings(bounds.where("first").select(*place), gone, base, last), df, totals, asked.drop("bucket"), k1, b)
        floor = top(early, k, [F.desc("score"), F.asc("id")]).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
        reach = F.col("most") + F.col("all_most") - F.col("list_most") >= F.col("floor") - SLACK
        needed = bounds.join(sums, "query_id").join(floor, "query_id", "left").where(F.col("whole") | F.col("floor").isNull() | reach).select(*place).distinct()
        needed = materialise(needed, "index-needed")
        if report is not None:
            read = blocks.join(needed.unionByName(bounds.where("first").select(*place)).distinct(), place, "left_semi").agg(F.sum("n")).first()[0]
            report |= {"all": blocks.agg(F.sum("n")).first()[0] or 0, "read": read or 0}
        found = scored(self._postings(needed, gone, base, last), df, totals, asked.drop("bucket"), k1, b)
        return top(found, k, [F.desc(F.round("score", 9)), F.asc("id")])

    def _postings(self, needed: DataFrame, gone: DataFrame, base: int, last: int) -> DataFrame:
        """Postings of needed blocks that no tombstone is for: folders of other blocks are not opened."""
        folders = needed.select((F.col("bucket") * LEVELS + F.col("level")).alias("f")).distinct().collect()  # BUCKETS x LEVELS at most
        rows = self._live("postings", base, last).where((F.col("bucket") * LEVELS + F.col("level")).isin([r.f for r in folders]))
        place = PLACE
        rows = rows.join(sized(needed.select(*place).distinct()), place, "left_semi")
        return materialise(self._without(rows, gone).select("id", "field", "dl", "term", "tf"), "index-postings")
