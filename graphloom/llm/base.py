"""What the operators of this subpackage share: scratch tables, held-out split, linked components."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A side of a join is broadcast only up to so many rows of at most about 100 bytes; beyond, it is shuffled.
BROADCAST_ROWS = 200_000
#: Rows of a key, at least, that make it a heavy one: those of a join that must not all go to one task.
HEAVY = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets
    a folder of our own; any other raises, as executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/graphloom"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is written yet."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that start within send Arrow batches of about so many bytes to Python workers. The default is 10,000 rows or 64 MB,
    which JVM and worker hold for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id is not held out and never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_ROWS, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores after it as far as df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def heavy_from(rows: int) -> int:
    """Rows of a key that make it heavy in a table of so many: then at most BROADCAST_ROWS keys are, whatever the table."""
    return max(HEAVY, -(-rows // BROADCAST_ROWS))


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, keys: int | None = None) -> DataFrame:
    """rows joined with keyed, which has one row for each key and, as count, how many of the total rows have that key.

    Heavy keys are broadcast, so that their rows stay where they are; only rows of the others are shuffled by the key. If
    keys, the number of rows of keyed, is given and within BROADCAST_ROWS, all are broadcast. Both must be cheap to read
    again.
    """
    least = heavy_from(total)
    if keys is not None and keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed.drop(count)), key)
    if total < least:
        return rows.join(keyed.drop(count), key)
    heavy = F.broadcast(keyed.where(F.col(count) >= least).drop(count))  # at most BROADCAST_ROWS by the bound above
    light = rows.join(heavy.select(key), key, "left_anti").join(keyed.where(F.col(count) < least).drop(count), key)
    return light.unionByName(rows.join(heavy, key))


#: Names that Hadoop has for file systems, and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "wasbs": "abfss"}


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there: any scheme that Arrow knows or that is another name of one, or a
    local path."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":  # a mount on every machine
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


#: Bits of a row's number that count rows in a partition; those above number the partition.
WITHIN = 33
#: Partitions whose verdicts a task holds at a time.
OPEN = 2


def meet_by_number(rows: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """rows joined with verdicts by rid, a number that monotonically_increasing_id() gave rows when they were written; rid is
    unique in verdicts, rows may repeat theirs.

    Rows, however long, stay where they are: verdicts are written in folders by the partition that numbered them, and a task
    reads those of the partitions whose rows it reads. Works alike at any size.
    """
    path = scratch(rows.sparkSession, name)
    part = F.shiftright("rid", WITHIN)
    verdicts.withColumn("__part", part).repartition("__part").sortWithinPartitions("__part", "rid").write.partitionBy("__part").parquet(path)
    more = [f for f in verdicts.schema.fields if f.name != "rid"]
    at, arrow = rows.columns.index("rid"), to_arrow_schema(StructType([f for f in verdicts.schema.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(path)
        held: dict[int, pa.Table] = {}

        def of(k: int) -> pa.Table:
            if k not in held:
                while len(held) >= OPEN:
                    held.pop(next(iter(held)))
                info = fs.get_file_info(f"{folder}/__part={k}")
                there = info.type == pafs.FileType.Directory
                found = pads.dataset(info.path, filesystem=fs, format="parquet", schema=arrow).to_table() if there else arrow.empty_table()
                held[k] = found.sort_by("rid").combine_chunks()
            return held[k]

        for batch in batches:
            rid = batch.column(at).to_numpy(zero_copy_only=False)
            parts = rid >> WITHIN
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(rid)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                known = of(int(parts[a]))
                keys = known.column("rid").to_numpy()
                place = np.searchsorted(keys, rid[a:b])
                ok = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == rid[a:b]) if len(keys) else np.zeros(0, np.int64)
                if len(ok):
                    mine, found = batch.take(pa.array(ok + a)), known.take(pa.array(place[ok]))
                    yield pa.RecordBatch.from_arrays([*mine.columns, *[found.column(f.name).combine_chunks() for f in more]], [*mine.schema.names, *[f.name for f in more]])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as a spanning star forest: (node, smallest node of its component) for every node but the roots."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class Links:
    """Gathers links and folds them to a forest, so that a large group never holds its square of pairs."""

    def __init__(self, fold_at: int = 1_000_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.fold_at = 0, fold_at

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.held += len(a)
            if self.held > self.fold_at:
                self.parts = [self.folded()]
                self.held = len(self.parts[0][0])

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none
        return forest(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds of equi-joins and map-side combined minima. The neighbours of a hub are
    shuffled by it only up to heavy_from() of them; those of a larger one stay where they are and get its minimum by
    broadcast. Every round is written to the shared folder; rounds go on until one changes nothing, about the logarithm
    of the nodes. Loops and null ends link nothing.
    """
    edge = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(edges.where("a <> b").select(edge.alias("e")).select("e.a", "e.b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def with_least(df: DataFrame, least: Column, rows: int) -> DataFrame:
        by_node = df.groupBy("a").agg(least.alias("m"), F.count("*").alias("n"))
        return join_counted(df, materialise(by_node, "least") if rows >= HEAVY else by_node, "a", "n", rows)

    last = mark(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, F.least(F.min("b"), F.first("a")), 2 * last[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        if last[0] >= HEAVY:
            large = materialise(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        small = with_least(large, F.min("b"), last[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(least).distinct(), "stars")
        seen = mark(now)
        if seen == last:
            break
        last = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def blocks_for(count: int, size: int) -> int:
    return max(1, math.ceil(count / size))
