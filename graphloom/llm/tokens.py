"""Token counts under a public byte-level BPE vocabulary, given by the path of its ranks file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A ranks file that has to be at this path on every machine; the operators take another as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are encoded at a time, at least; the pattern's matcher has no room for much longer runs of white space.
PIECE = 65_536
#: Runs of white space (as the pattern has it) that are too long for the matcher: all but the last character of one is
#: one word to the pattern, and all of it at the end of a text.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % PIECE)
#: Where a token begins under the pattern, so that a text may be cut: before a single blank between two other characters,
#: between a letter and a digit, and where a sign follows either.
BREAK = re.compile(r"\S(?= \S)|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[^\W_](?=[^\w\s])")


@cache
def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    try:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    except OSError as e:
        raise FileNotFoundError(f"the vocabulary {vocabulary} has to be readable on every machine: {e}") from e
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text without long runs of white space in parts whose tokens are the text's."""
    at = 0
    while len(text) - at > 2 * size and (found := BREAK.search(text, at + size)):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def count(text: str | None, encoder: tiktoken.Encoding) -> int:
    text, at, total = text or "", 0, 0
    for m in RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += sum(len(encoder.encode_ordinary(p)) for p in pieces(text[at : m.start()]))
        total += len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return total + sum(len(encoder.encode_ordinary(p)) for p in pieces(text[at:]))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, length) of every row's whole text in tokens; null and empty texts have none, text that looks like a special
    token is ordinary text. Rows that repeat are all returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x.as_py(), encoder) for x in batch.column(1)], pa.int64())], ["id", "length"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, length long")
