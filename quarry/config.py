"""Settings from the environment; a value that can't be read leaves the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: What counts as true.
TRUE = {"1", "true", "yes", "y", "on"}


def read(name: str, default, env: Mapping[str, str] | None = None):
    """A setting of the default's type."""
    raw = (os.environ if env is None else env).get(name)
    if raw is None or not raw.strip():
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in TRUE
    try:
        return type(default)(raw.strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class Config:
    chunk_size: int = 4000
    chunk_overlap: int = 200
    chunk_method: str = "recursive"
    recall_k: int = 10
    graph_k: int = 20
    vector_k: int = 40
    rerank_k: int = 3
    rerank_least: float = 0.4
    job_interval: str = "10 seconds"
    session_ttl: int = 86_400
    graph_enabled: bool = True

    @classmethod
    def load(cls, prefix: str = "QUARRY_", env: Mapping[str, str] | None = None) -> Config:
        return cls(**{f.name: read(prefix + f.name.upper(), f.default, env) for f in fields(cls)})
