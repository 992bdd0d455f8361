"""Parameters of the recommender."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("cosine", "cooccurrence")
PRECISIONS = ("published", "full")


@dataclass(frozen=True)
class ModelConfig:
    """``published``: similarities and scores have 10 decimals from stage to stage; ``full``: doubles, rounded on output only."""

    method: str = "cosine"
    min_common_users: int = 1
    top_l: int = 50
    top_k: int = 10
    relevance_threshold: int = 4
    precision: str = "published"

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown similarity method {self.method!r}: {', '.join(METHODS)}")
        if self.precision not in PRECISIONS:
            raise ValueError(f"unknown precision {self.precision!r}: {', '.join(PRECISIONS)}")
        for name in ("min_common_users", "top_l", "top_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 1 <= self.relevance_threshold <= 5:
            raise ValueError("relevance_threshold must be from 1 to 5")
