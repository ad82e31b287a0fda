"""Packing into optimal length buckets.

The histogram of all lengths is counted once; dynamic programming over it finds the bucket boundaries that waste the
least padding; inside a bucket, pieces fill batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import materialise, sized_broadcast

#: Longest piece, buckets, tokens in a batch with its padding, pieces that one task numbers, equal rows that one task writes.
LONGEST, BUCKETS, BUDGET, SHARE, COPIES = 2048, 8, 65_536, 100_000, 100_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends, at most buckets, of the length classes that minimise the padding of all pieces.

    lengths are distinct and ascending. Cost of a class is its pieces times its upper end less their tokens; the best
    split is monotone in the end, so each further bucket is found by halving. Of equal costs the earliest split wins.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    cost = lambda i, j: lengths[j - 1] * (total[j] - total[i]) - (mass[j] - mass[i])  # noqa: E731  of a class of i..j-1
    best = np.concatenate([[0.0], [cost(0, j) for j in range(1, n + 1)]])
    splits = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            c = best[i] + cost(i, mid)
            k = int(c.argmin())
            now[mid], split[mid] = c[k], i[k]
            todo += [(low, mid - 1, first, int(i[k])), (mid + 1, high, int(i[k]), last)]
        best = now
        splits.append(split)
    ends, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(split[j])
    return sorted(set(ends))


def pack(rows: DataFrame, id_col: str = "id", length_col: str = "length", longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, piece, start, n_tokens, bucket, bucket_len, batch, slot) of all rows, cut into pieces of longest tokens.

    A batch holds pieces of one bucket only, as many as its budget has room for at the bucket's length, one at least;
    all batches of a bucket but its last are full. A null or negative length counts as none; a row without tokens is one
    empty piece in the first bucket. Rows that repeat are packed as often as they are there. Pieces stand in the order of
    a hash of id, length, piece and the number of the copy, so copies of a row are spread over a bucket's batches, and the
    result depends on neither partitions nor order.
    """
    if longest < 1 or buckets < 1 or budget < longest:
        raise ValueError("longest and buckets are at least 1 and the budget takes the longest piece")
    spark = rows.sparkSession
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    # equal rows are counted first, and written out in parts, as one id (or null) may have very many
    counted = rows.select(F.col(id_col).alias("id"), length.alias("length")).groupBy("id", "length").agg(F.count("*").alias("n"))
    counted = materialise(counted, "pack-counts")
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    if (counted.agg(F.max("n")).first()[0] or 0) > COPIES:
        parts = parts.repartition("id", "length", "part")
    copies = F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)
    rows = materialise(parts.select("id", "length", F.explode(copies).alias("copy")), "pack-rows")
    # at most a row for each length up to longest; long rows add whole pieces to the last one
    whole = F.floor(F.col("length") / longest)
    hist = rows.select(F.explode(F.array(F.struct((F.col("length") % longest).alias("l"), F.when((F.col("length") % longest > 0) | (F.col("length") == 0), 1).otherwise(0).alias("c")), F.struct(F.lit(longest).alias("l"), whole.alias("c")))).alias("x"))
    hist = sorted((r.l, r.c) for r in hist.groupBy(F.col("x.l").cast("long").alias("l")).agg(F.sum("x.c").alias("c")).where("c > 0").collect())
    ends = boundaries(np.array([x for x, _ in hist], np.int64), np.array([c for _, c in hist], np.int64), buckets)
    made, k = [], 0
    for b, end in enumerate(ends):
        count = 0
        while k < len(hist) and hist[k][0] <= end:
            count += hist[k][1]
            k += 1
        made.append((b, end, max(1, budget // max(1, end)), max(1, -(-count // SHARE))))
    of = F.broadcast(spark.createDataFrame(made, "bucket int, bucket_len long, capacity long, shares long"))  # a row for each bucket
    last = F.greatest(F.ceil(F.col("length") / longest) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * longest)
    pieces = pieces.select("id", "length", "copy", "piece", "start", F.least(F.col("length") - F.col("start"), F.lit(longest)).cast("long").alias("n_tokens"))
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > end).cast("int")
    mark = F.xxhash64(F.col("id").cast("string"), F.col("length"), F.col("piece"), F.col("copy"))
    pieces = pieces.withColumn("bucket", bucket).join(of, "bucket").withColumn("mark", mark).withColumn("share", F.pmod("mark", "shares"))
    sizes = pieces.groupBy("bucket", "share").count()
    offset = F.expr("coalesce(sum(count) over (partition by bucket order by share rows between unbounded preceding and 1 preceding), 0)")
    sizes = sizes.select("bucket", "share", offset.alias("offset"))
    numbered = pieces.withColumn("rn", F.expr("row_number() over (partition by bucket, share order by mark, id, length, piece, copy)"))
    numbered = numbered.join(sized_broadcast(sizes, sum(m[3] for m in made)), ["bucket", "share"])
    at = F.col("offset") + F.col("rn") - 1
    return numbered.select("id", "piece", "start", "n_tokens", "bucket", "bucket_len", F.floor(at / F.col("capacity")).cast("long").alias("batch"), (at % F.col("capacity")).cast("int").alias("slot"))
