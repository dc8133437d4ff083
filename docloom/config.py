"""Effective defaults of the retrieval engine, checked when made."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    chunk_max_tokens: int = 1500
    chunk_min_tokens: int = 100
    chunk_overlap_tokens: int = 50
    parent_max_tokens: int = 1200
    child_max_tokens: int = 300
    child_overlap_tokens: int = 50
    table_row_threshold: int = 1500
    table_max_tokens: int = 2000
    heading_sizes: tuple[float, float, float, float] = (16.0, 13.0, 11.0, 10.5)
    footnote_fraction: float = 0.88
    table_quality_min: float = 0.25
    history_turns: int = 5
    variants: int = 3
    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    final_k: int = 10
    rerank_k: int = 8
    near_dup_cosine: float = 0.92
    context_chunks: int = 3
    confidence_min: float = 0.40
    confidence_weights: tuple[float, float, float] = (0.35, 0.30, 0.35)
    guard_min_overlap: float = 0.5
    short_term_turns: int = 10
    memory_top_k: int = 3
    max_sessions: int = 100
    session_ttl_minutes: int = 60
    rate_per_second: float = 1.0
    rate_burst: float = 10.0
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        for name in ("near_dup_cosine", "confidence_min", "guard_min_overlap", "table_quality_min", "footnote_fraction"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"unknown log level {self.log_level}")


DEFAULTS = Settings()


def lookup(tree: dict[str, Any], path: str, default: Any = None) -> Any:
    """Value at a dotted path of a nested configuration, or default."""
    node: Any = tree
    for key in path.split("."):
        if not isinstance(node, dict) or key not in node:
            return default
        node = node[key]
    return default if node is None else node
