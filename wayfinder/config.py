"""Configuration: defaults, reading, validation."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Weights:
    task_route: float = 0.0
    keyword: float = 0.25
    name_match: float = 0.20
    vector: float = 0.25
    kind_preference: float = 0.10
    exported: float = 0.10
    path_match: float = 0.10


@dataclass(frozen=True)
class Search:
    default_limit: int = 15
    cutoff: str = "none"
    relative_gap_threshold: float = 0.80
    min_results: int = 3
    max_results: int = 8
    rerank_weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Index:
    exclude_patterns: tuple[str, ...] = ("target/**", ".git/**", "node_modules/**", ".venv/**", "fuzz/**", "*.lock", ".wayfinder/**")


@dataclass(frozen=True)
class Embedding:
    provider: str = ""
    model: str = "nomic-embed-text-v2-moe"
    dimensions: int = 768
    batch_size: int = 32


@dataclass(frozen=True)
class Summary:
    provider: str = ""
    model: str = ""
    max_tokens: int = 512
    batch_size: int = 4
    concurrency: int = 1
    temperature: float = 0.2
    exported_only: bool = True


@dataclass(frozen=True)
class Reranker:
    enabled: bool = False
    provider: str = ""
    model: str = ""
    top_k: int = 25
    batch_size: int = 25
    timeout_secs: int = 30


@dataclass(frozen=True)
class Config:
    search: Search = field(default_factory=Search)
    index: Index = field(default_factory=Index)
    embedding: Embedding = field(default_factory=Embedding)
    summary: Summary = field(default_factory=Summary)
    reranker: Reranker = field(default_factory=Reranker)
    providers: dict = field(default_factory=lambda: {"ollama": {"base_url": "http://localhost:11434/v1"}})
    editor_link: str = "vscode://file/{abs_path}:{line}"


def merged(kind: type, given: dict):
    """kind with the given values; nested tables merge into defaults, unknown keys are ignored."""
    values = {}
    default = kind()
    for f in fields(kind):
        if f.name not in given:
            continue
        value, now = given[f.name], getattr(default, f.name)
        values[f.name] = merged(type(now), value) if is_dataclass(now) else {**now, **value} if isinstance(now, dict) else tuple(value) if isinstance(now, tuple) else value
    return kind(**values)


def read_config(text: str) -> Config:
    return merged(Config, tomllib.loads(text))


def validate(c: Config) -> Config:
    """The configuration, or a ValueError that names the first rule broken."""
    s, w = c.search, c.search.rerank_weights
    named = [p for p in (c.embedding.provider, c.summary.provider, c.reranker.provider if c.reranker.enabled else "") if p]
    rules = [
        (abs(sum(getattr(w, f.name) for f in fields(w)) - 1) <= 0.001, "rerank weights must sum to 1"),
        (s.cutoff in ("none", "relative_gap"), "cutoff must be none or relative_gap"),
        (0 <= s.relative_gap_threshold <= 1, "relative_gap_threshold must be between 0 and 1"),
        (s.min_results >= 1, "min_results must be at least 1"),
        (s.max_results >= s.min_results, "max_results must not be below min_results"),
        (all(p in c.providers for p in named), "an unknown provider is named"),
        (not (c.embedding.provider and c.summary.provider) or c.embedding.provider == c.summary.provider, "summary and embedding must name the same provider"),
        (0 <= c.summary.temperature <= 2, "temperature must be between 0 and 2"),
        (c.summary.batch_size > 0 and c.embedding.batch_size > 0, "batch sizes must be positive"),
        (c.embedding.dimensions > 0, "dimensions must be positive"),
        (c.summary.concurrency > 0, "concurrency must be positive"),
        (not c.reranker.enabled or bool(c.reranker.model and c.reranker.top_k > 0 and c.reranker.batch_size > 0 and c.reranker.timeout_secs > 0), "an enabled reranker needs a model and positive sizes"),
        (all(p.get("base_url", "x") for p in c.providers.values()), "base_url must not be empty"),
        (bool(c.editor_link), "editor_link must not be empty"),
    ]
    for good, what in rules:
        if not good:
            raise ValueError(what)
    return c
