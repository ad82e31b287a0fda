"""Quality scores by supervised subword embeddings.

A document is the mean of learned vectors of its words, their character n-grams and pairs of one word twice, hashed into a table; a softmax layer
on that mean gives the score. Vectors and layer are learned together by stochastic gradient descent in numpy. As the
layer is linear in the mean, a trained model keeps for each bucket only its vector's part of the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.base import held_out, materialise

#: Hash buckets (a power of two of them), vector length, lengths of character n-grams.
BITS, DIM, GRAMS = 18, 8, (3, 5)
BUCKETS = 1 << BITS
#: The bucket of a word pair of twice the same word: whichever it is, as hashes of such pairs would never meet again.
SAME = 1
#: Bytes of words that are hashed at a time.
PIECE = 1 << 20
#: Labelled documents that training takes at most, and different features of all of them together (8 bytes each), passes
#: over them, first learning rate.
SAMPLE, FEATURES, EPOCHS, RATE = 4000, 1 << 25, 10, 0.6


ODD, ODD32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA6B)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    first = np.ones(n, np.uint64)
    first[1:] = ODD
    back = np.ones(n, np.uint64)
    back[1:] = inverse
    return np.multiply.accumulate(first), np.multiply.accumulate(back)


def _hashed(words: list[bytes]) -> list[np.ndarray]:
    text = b" " + b" ".join(words) + b" "
    x = np.frombuffer(text, np.uint8)
    blank = x == 32
    at = np.flatnonzero(blank)
    up, down = _powers(1 << (len(text) - 1).bit_length())
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    word = (sums[at[1:]] - sums[at[:-1] + 1]) * down[at[:-1] + 1]
    out = [((word ^ (word >> np.uint64(29))) * ODD >> np.uint64(64 - BITS)).astype(np.int32)]
    out.append(np.full(int((word[1:] == word[:-1]).sum()), SAME, np.int32))
    h, inside = x.astype(np.uint32), None
    for n in range(2, GRAMS[1] + 1):
        h = h[:-1] * ODD32 + x[n - 1 :]
        if n > 2:
            inside = ~blank[1:-1] if inside is None else inside[:-1] & ~blank[n - 2 : -1]
        if n >= GRAMS[0]:
            g = h[inside] + np.uint32(n)
            out.append(((g ^ (g >> np.uint32(15))) * ODD32 >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def buckets(text: str | None) -> np.ndarray:
    """Buckets of all features of a text: its words, their character n-grams with a blank at either end, and pairs of one
    word twice."""
    words = (text or "").encode("utf-8", "replace").split()
    out, a, size = [np.zeros(0, np.int32)], 0, 0
    for b, w in enumerate(words, 1):
        size += len(w) + 1
        if size >= PIECE or b == len(words):
            out += _hashed(words[a:b])
            a, size = b, 0
    return np.concatenate(out)


@dataclass
class Model:
    """What each bucket adds to the score's logit when it is all of a text, and the bias."""

    part: np.ndarray
    bias: float


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    ids = buckets(text)
    found, counts = np.unique(ids, return_counts=True)
    return found.astype(np.int32), (counts / max(1, len(ids))).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """train_bags() of texts."""
    return train_bags([_bag(t) for t in texts], labels, epochs, seed)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Learn vectors and softmax weights for two classes, one document at a time. With texts of one class or none there is
    nothing to tell apart, and the bias is that of the labels' shares with one more of each."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), math.log((1 + sum(labels)) / (1 + len(labels) - sum(labels))))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    total, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            mean = share @ vectors[ids]
            score = mean @ weights + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = RATE * (1 - step / total)
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # a text's buckets share one gradient; its size is that of the mean, so it is scaled up to reach each vector
            vectors[ids] -= rate * np.outer(share * min(len(ids), 200), back)
            step += 1
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Train on at most sample rows that are labelled and not held out, and on no more than have features different features.

    The sample is by hash of the identifier: of each of sample buckets the row with the smallest hash. Labels other than
    0 and 1, and identifiers with both, are not learned from; of rows that repeat an identifier the smallest text counts.
    Features are counted where a document is, over its whole text; should those of all exceed features, documents count in
    the order of their hashes as far as it goes. Where only one label is left to learn from, or none, all texts get the
    prior.
    """
    mark = lambda c: F.xxhash64(F.lit("quality"), F.col(c))
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    few = marked.where("low = high").groupBy(F.pmod(mark("__id"), F.lit(sample)).alias("__bucket")).agg(F.min_by(F.struct("__id", F.col("low").cast("int").alias("label")), mark("__id")).alias("r")).select("r.__id", "r.label")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(few), "__id").groupBy("__id", "label").agg(F.min("text").alias("text"))  # few: at most sample rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bag(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(i) for i, _ in found], pa.int64()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["id", "label", "n", "ids", "shares"])

    found = materialise(rows.select("__id", "label", "text").mapInArrow(bags, "id long, label int, n long, ids binary, shares binary"), "quality-bags")
    so_far = F.sum("n").over(Window.orderBy(mark("id"), "id"))  # at most sample rows
    kept = found.join(F.broadcast(found.select("id", "n").withColumn("upto", so_far).where(F.col("upto") <= features).select("id")), "id", "left_semi")
    got = sorted((r.id, r.label, bytes(r.ids), bytes(r.shares)) for r in kept.collect())
    return train_bags([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for _, _, i, s in got], [y for _, y, _, _ in got])


def score_text(text: str | None, model: Model) -> float:
    ids = buckets(text)
    logit = float(model.part[ids].sum(dtype=np.float64)) / max(1, len(ids)) + model.bias
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text: 0 to 1, higher where label 1 is likelier.

    Only the text is looked at. Null and empty texts get the score of no evidence (the bias). Rows that repeat are all
    returned; a null id is returned as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score_text(x.as_py(), model) for x in batch.column(1)], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
