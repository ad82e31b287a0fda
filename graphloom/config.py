"""Settings that a caller may give in the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "GRAPHLOOM_"


@dataclass(frozen=True)
class Settings:
    """Where nodes and edges are kept, the length of vectors, nodes that a search returns and that an answer shows."""

    folder: str = "graph"
    vector_size: int = 768
    top_k: int = 10
    shown: int = 5

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Defaults, replaced by GRAPHLOOM_FOLDER, GRAPHLOOM_VECTOR_SIZE and so on; a number that is none raises ValueError."""
        given = {f.name: env[PREFIX + f.name.upper()] for f in fields(cls) if env.get(PREFIX + f.name.upper())}
        return cls(**{k: v if k == "folder" else int(v) for k, v in given.items()})
