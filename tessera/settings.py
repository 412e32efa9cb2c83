"""Defaults that change results, and the fixed vocabularies of the data model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

# The vocabularies of the data model.
SOURCE_KINDS = ("wiki", "raw", "clipping", "operational")
PAGE_ROLES = ("evidence", "idea", "log", "route-map", "durable", "current-state", "decision", "project", "operational")
INTENTS = ("current-state", "decision", "chronology", "evidence", "general")
MODES = ("dense", "lexical", "hybrid")
SCHEMA_VERSION = 8


@dataclass(frozen=True)
class Settings:
    """Retrieval and projection defaults. The numbers are fixed values: results depend on them."""

    dimension: int = 384
    mode: str = "hybrid"
    k_dense: int = 50
    k_lexical: int = 50
    k_final: int = 10
    rrf_k: int = 20
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    graph_weight: float = 0.5
    graph_seeds: int = 5
    graph_neighbours: int = 30
    scope_linked: int = 40
    per_document: int = 3
    chunk_chars: int = 2000
    context_tokens: int = 1500
    document_tokens: int = 600
    max_excerpts: int = 8
    debounce_seconds: int = 2
    ignored_dirs: tuple[str, ...] = (".obsidian", ".trash", ".git")
    ignored_globs: tuple[str, ...] = ("**/.*",)
    rerank: bool = False
    rerank_limit: int = 20
    query_recipe: str = "query-v2-bge-instruction"
    expand_queries: bool = False
    graph: bool = False
    stem: bool = True
    allow_reindex: bool = True
    allow_full_rebuild: bool = False
    inject: bool = False
    inject_profile: str = "answer"
    inject_tokens: int = 600
    inject_excerpts: int = 4
    inject_deadline_ms: int = 1500

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        for name in ("dimension", "k_dense", "k_lexical", "k_final", "context_tokens", "document_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def load_settings(*layers: Mapping[str, object]) -> Settings:
    """Settings from layers, the later before the earlier (defaults, a file, the environment, arguments); None leaves a value as it is.

    An unknown name is an error, so a misspelt one doesn't go unseen.
    """
    known = {f.name for f in fields(Settings)}
    merged: dict[str, object] = {}
    for layer in layers:
        for name, value in layer.items():
            if name not in known:
                raise ValueError(f"no setting {name!r}")
            if value is not None:
                merged[name] = value
    return Settings(**merged)
