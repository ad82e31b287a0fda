"""Language identification: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes that cover them wholly. The network reads every window in both directions, labels
every position, and a document's probabilities are those of its positions pooled. It is trained here, in numpy, by
backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from graphloom.llm.base import fresh, held_out

#: Bytes in a window; the symbol that fills the last one; hidden units in each direction.
WINDOW, PAD, HIDDEN = 64, 256, 8
#: Documents that training takes of each language at most, and of all languages (but at least one of each); windows that it
#: draws of a document at most, evenly from the whole text.
SAMPLE, SAMPLE_ALL, DRAWN = 160, 10_240, 1024
#: Windows in a training step, steps, and windows read at a time afterwards.
BATCH, STEPS, READ = 256, 260, 4096
#: The language of a text that is null or has no letter.
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Model:
    """languages; for each direction input (symbols x 3 hidden), recurrent (hidden x 3 hidden); output weights, bias."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def states(self, x: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps x windows x hidden) of symbols (steps x windows) in the order given."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape, HIDDEN), np.float32)
        table, u = self.inputs[side], self.recurrent[side]
        uz, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        for t in range(len(x)):
            a = table[x[t]]
            gates = h @ uz
            gates += a[:, : 2 * HIDDEN]
            sigmoid(gates)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = h @ uc
            c = r * inner
            c += a[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, inner, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (windows x steps x languages) of every position."""
        x = np.ascontiguousarray(windows.T)
        both = np.concatenate([self.states(x, 0), self.states(x[::-1], 1)[::-1]], axis=2)
        p = both.reshape(-1, 2 * HIDDEN) @ self.out
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(WINDOW, len(windows), -1).transpose(1, 0, 2)


def windows_of(text: bytes) -> np.ndarray:
    """All of a text as windows (n x WINDOW) of symbols."""
    n = -(-len(text) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def drawn_windows(text: bytes, most: int) -> bytes:
    """At most so many windows of a text, evenly spread over all of it, one after the other."""
    n = -(-len(text) // WINDOW)
    if n <= most:
        return text
    return b"".join(text[WINDOW * i : WINDOW * (i + 1)] for i in np.linspace(0, n - 1, most).astype(int).tolist())


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 1) -> Model:
    """A model of the labels' languages; each language has the same share of the windows in every step. Without labels it
    knows no language, and a single one is certain."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    of = {k: np.concatenate([windows_of(t) for t, y in zip(texts, labels, strict=True) if y == k] or [np.zeros((0, WINDOW), np.int16)]) for k in languages}
    of = {k: w if len(w) else np.full((1, WINDOW), PAD, np.int16) for k, w in of.items()}
    h, k = HIDDEN, len(languages)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    m = Model(languages, [draw(257, 3 * h, s=0.3) for _ in range(2)], [draw(h, 3 * h, s=0.3) for _ in range(2)], draw(2 * h, k, s=0.3), np.zeros(k, np.float32))
    params = [*m.inputs, *m.recurrent, m.out, m.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1 if k > 1 else 1):
        y = np.arange(BATCH) % k
        rows = np.stack([of[languages[c]][rng.integers(len(of[languages[c]]))] for c in y])
        x = np.ascontiguousarray(rows.T)
        kept: list[list] = [[], []]
        sides = [m.states(x, 0, kept[0]), m.states(x[::-1], 1, kept[1])[::-1]]
        both = np.concatenate(sides, axis=2)
        score = both @ m.out + m.bias
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        real = x != PAD
        p *= (real / max(1, real.sum()))[:, :, None]
        p = p.astype(np.float32)
        back = p @ m.out.T
        grads = [np.zeros_like(q) for q in params]
        grads[4] = np.einsum("tnh,tnk->hk", both, p)
        grads[5] = p.sum(axis=(0, 1))
        for side in range(2):
            u = m.recurrent[side]
            order = x if side == 0 else x[::-1]
            g = back[:, :, side * h : (side + 1) * h]
            g = g if side == 0 else g[::-1]
            dh = np.zeros((BATCH, h), np.float32)
            into, du = np.empty((WINDOW, BATCH, 3 * h), np.float32), grads[2 + side]
            for t in range(WINDOW - 1, -1, -1):
                before, z, r, inner, c = kept[side][t]
                dh = dh + g[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                gate = np.concatenate([dz, dr], axis=1)
                into[t] = np.concatenate([gate, dc], axis=1)
                du[:, : 2 * h] += before.T @ gate
                du[:, 2 * h :] += before.T @ (dc * r)
                dh = dh * (1 - z) + gate @ u[:, : 2 * h].T + (dc * r) @ u[:, 2 * h :].T
            np.add.at(grads[side], order.ravel(), into.reshape(-1, 3 * h))
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-4
        for q, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, sample_all: int = SAMPLE_ALL, drawn: int = DRAWN) -> Model:
    """Train on at most sample documents of each language among rows with a label and a text that are not held out.

    The sample is by hash of the identifier, so it depends neither on partitions nor on order: for each language and each
    of its buckets the row with the smallest hash. The buckets of a language are sample, or fewer where sample_all does not
    go round. Of rows that repeat an id and label, the smallest text counts. The windows that a step may take of a document
    are drawn where the document is, evenly from its whole text, so that no more than drawn of each come to the driver
    (DRAWN of 64 bytes of SAMPLE_ALL documents: 670 MB at most). Without a labelled text the model knows no language.
    """
    mark = F.xxhash64(F.lit("langid"), F.col(id_col))
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(label_col).cast("string").alias("label"), mark.alias("mark"), F.col(text_col).alias("text"))
    found = rows.agg(F.countDistinct("label")).first()[0]
    buckets = max(1, min(sample, sample_all // max(1, found)))
    few = rows.groupBy("label", F.pmod("mark", F.lit(buckets)).alias("bucket")).agg(F.min("mark").alias("mark")).select("label", "mark")
    # a row for each bucket of a language: sample_all, or a row for each language
    picked = rows.join(F.broadcast(few), ["label", "mark"]).groupBy("label", "mark").agg(F.min("text").alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([drawn_windows(t.as_buffer().to_pybytes(), drawn) for t in batch.column(1)], pa.binary())], ["label", "windows"])

    got = sorted((r.label, bytes(r.windows)) for r in picked.select("label", F.col("text").cast("binary")).mapInArrow(draw, "label string, windows binary").collect())
    return train([t for _, t in got], [y for y, _ in got])


def _letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, pooled probability, its standard error) of each text: the mean of its positions' probabilities, and what
    that of its windows tells of it, to which one window of the most variance possible is added. A model without languages
    tells none."""
    out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    if not model.languages:
        return out
    sums, sizes, windows = np.zeros((len(texts), len(model.languages))), np.ones(len(texts)), np.zeros(len(texts))
    squares = np.zeros_like(sums)
    held, owners, count = [], [], 0

    def flush() -> None:
        nonlocal count
        if held:
            w, own = np.concatenate(held), np.concatenate(owners)
            for k in range(0, len(w), READ):
                part, of = w[k : k + READ], own[k : k + READ]
                real = (part != PAD).astype(np.float32)
                found = np.einsum("nts,nt->ns", model.probabilities(part), real)
                np.add.at(sums, of, found)
                np.add.at(squares, of, found**2 / real.sum(axis=1)[:, None])
                np.add.at(windows, of, 1)
        held.clear()
        owners.clear()
        count = 0

    for i, text in enumerate(texts):
        if text and _letter(text):
            data = text.encode("utf-8", "replace")
            sizes[i] = len(data)
            for a in range(0, len(data), READ * WINDOW):
                w = windows_of(data[a : a + READ * WINDOW])
                held.append(w)
                owners.append(np.full(len(w), i))
                count += len(w)
                if count >= READ:
                    flush()
    flush()
    pooled = sums / sizes[:, None]
    for i, text in enumerate(texts):
        if pooled[i].any():
            best, n = int(pooled[i].argmax()), windows[i]
            p = float(min(1.0, pooled[i, best]))
            variance = max(0.0, squares[i, best] / sizes[i] - p * p) + p * (1 - p) / n
            out[i] = (model.languages[best], p, float(np.sqrt(variance / n)))
    return out


def annotate(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language of every row's whole text, its probability and, with a third name, that one's
    standard error, as more columns of these names.

    Only the text is looked at. Texts that are null, empty or without a letter get und and 0. Rows that repeat are all
    returned. A name that docs has already, in any case, gets underscores after it; columns of docs stay as they are.
    """
    names = tuple(fresh(docs, n) for n in names)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict(model, batch.column(at).to_pylist())
            more = [pa.array([g[k] for g in got], pa.float64() if k else pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType() if k else StringType()) for k, n in enumerate(names)]])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; a null id is returned as it is. See annotate()."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return annotate(rows, model).drop("text")
