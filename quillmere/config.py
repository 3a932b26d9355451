"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from quillmere.errors import BadConfig


@dataclass(frozen=True)
class Config:
    weight_vector: float = 1.0
    weight_fts: float = 1.0
    weight_graph: float = 0.5
    chunk_tokens: int = 1024
    chunk_overlap: int = 128
    max_rounds: int = 3
    confidence_threshold: float = 0.7
    embedding_dim: int = 768
    max_results: int = 20
    separator: str = "\n\n"
    skip_graph: bool = False
    caption_images: bool = False
    translate_terms: bool = True

    def __post_init__(self):
        if self.chunk_tokens < 1 or self.chunk_overlap < 0 or self.embedding_dim < 1 or not 0 <= self.confidence_threshold <= 1:
            raise BadConfig(f"out of bounds: {self}")

    def bounded(self, max_results: int | None, max_rounds: int | None) -> tuple[int, int]:
        """Options of a request: out of 1..100 results or 1..10 rounds means the default."""
        return (max_results if max_results and 0 < max_results <= 100 else self.max_results), (max_rounds if max_rounds and 0 < max_rounds <= 10 else self.max_rounds)
