"""Models that a caller may plug in, and what is used without one."""

from __future__ import annotations

from typing import Protocol

import zlib


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Expander(Protocol):
    """A query to other wordings of it, a line each."""

    def expand(self, query: str) -> str: ...


class Judge(Protocol):
    """Whether a query is allowed, as JSON text with allowed and reason."""

    def judge(self, query: str) -> str: ...


class Extractor(Protocol):
    """Entities of a query as JSON text: field to list of {value, source_text}."""

    def extract(self, query: str, found: dict[str, list[str]], hints: str) -> str: ...


class Scorer(Protocol):
    """Scores of numbered cards as JSON text: {"scores": [{"index": 0, "score": 8.5}]}."""

    def score(self, query: str, cards: list[str]) -> str: ...


class Generator(Protocol):
    """An answer from a context."""

    def answer(self, query: str, context: str, filters: str) -> str: ...


class HashEmbedder:
    """Counts of hashed words, as a vector of length one: needs no model, and equal texts have equal vectors."""

    def __init__(self, size: int = 768) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h & 1 << 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out
