"""Run settings: a tree of dataclasses read from YAML on the driver.

Section and setting names and their defaults are fixed values: files written for other tools of this kind keep working.
"""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


def _of(kind: type) -> Any:
    return field(default_factory=kind)


@dataclass
class Project:
    name: str = "leafmill"
    version: str = "1.0"
    author: str | None = None
    description: str | None = None


@dataclass
class Inputs:
    paths: list[str] = _of(list)
    patterns: list[str] = field(default_factory=lambda: ["*.pdf"])
    recursive: bool = True


@dataclass
class Chunking:
    mode: str = "smart"
    tokens_per_chunk: int = 2000
    overlap_tokens: int = 200
    respect_page_bounds: bool = True
    min_chunk_tokens: int = 100
    max_chunk_tokens: int = 4000
    enable_trimming: bool = True
    token_budget: int = 8000


@dataclass
class Ingestion:
    mode: str = "extract_text"
    chunking: Chunking = _of(Chunking)
    extract_images: bool = True
    extract_tables: bool = False
    ocr_fallback: bool = False


@dataclass
class Llm:
    provider: str = "openai"
    model: str = "gpt-4-1106-preview"
    temperature: float = 0.0
    seed: int | None = None
    max_tokens: int | None = None
    api_key: str | None = None
    base_url: str | None = None
    timeout: int = 120
    max_retries: int = 3

    def __post_init__(self) -> None:
        if m := re.fullmatch(r"\$\{(.+)\}", self.api_key or ""):
            self.api_key = os.environ.get(m[1])


@dataclass
class Strategy:
    enabled: bool = True
    template_version: str = "1.0"
    params: dict[str, Any] = _of(dict)
    min_score: float | None = None


@dataclass
class Strategies:
    key_points: Strategy = _of(Strategy)
    cloze_definitions: Strategy = _of(Strategy)
    figure_based: Strategy = _of(Strategy)

    def enabled(self) -> list[str]:
        """In declared order."""
        return [f.name for f in fields(self) if getattr(self, f.name).enabled]


@dataclass
class Rag:
    enabled: bool = False
    provider: str = "faiss"
    embedding_model: str = "text-embedding-3-large"
    k: int = 5
    index_path: str | None = None


@dataclass
class Deduplication:
    enabled: bool = True
    fuzzy_threshold: float = 0.85
    embedding_threshold: float = 0.9
    policy: str = "or"
    scope_within_run: bool = True
    scope_persistent: bool = False
    index_path: str | None = None


@dataclass
class Hallucination:
    require_citations: bool = True
    verify_quotes: bool = True
    drop_on_failure: bool = True


@dataclass
class Review:
    enabled: bool = False
    min_score: float = 7.0
    allow_edits: bool = True
    template_version: str = "1.0"


@dataclass
class Telemetry:
    enabled: bool = True
    track_tokens: bool = True
    track_costs: bool = True
    track_timing: bool = True
    track_cache_hits: bool = True


@dataclass
class Pipeline:
    ingestion: Ingestion = _of(Ingestion)
    llm: Llm = _of(Llm)
    rag: Rag = _of(Rag)
    deduplication: Deduplication = _of(Deduplication)
    hallucination: Hallucination = _of(Hallucination)
    review: Review = _of(Review)
    telemetry: Telemetry = _of(Telemetry)


@dataclass
class Tags:
    default_tags: list[str] = _of(list)
    auto_generate: bool = True
    include_source: bool = True
    include_strategy: bool = True


@dataclass
class Taxonomy:
    auto_detect: bool = True
    hierarchical: bool = True
    max_depth: int = 3


@dataclass
class Ids:
    strategy: str = "content_hash"
    salt: str = "leafmill"


@dataclass
class Anki:
    deck_name: str = "Leafmill"
    deck_id: int | None = None
    deck_structure: str = "flat"
    note_types: dict[str, dict[str, Any]] = _of(dict)
    preserve_latex: bool = True


@dataclass
class Output:
    workspace: str = "workspace"
    csv_path: str = "workspace/cards.csv"
    media_path: str = "workspace/media"
    apkg_path: str = "workspace/deck.apkg"
    manifest_path: str = "workspace/manifest.json"


@dataclass
class Generate:
    strategies: Strategies = _of(Strategies)
    tags: Tags = _of(Tags)
    taxonomy: Taxonomy = _of(Taxonomy)
    ids: Ids = _of(Ids)
    language: str = "en"
    anki: Anki = _of(Anki)
    output: Output = _of(Output)


@dataclass
class Config:
    project: Project = _of(Project)
    inputs: Inputs = _of(Inputs)
    pipeline: Pipeline = _of(Pipeline)
    generate: Generate = _of(Generate)

    def __post_init__(self) -> None:
        from leafmill.operators.chunking import MODES
        from leafmill.operators.deck import STRUCTURES

        p, g = self.pipeline, self.generate
        for value, allowed in (
            (p.ingestion.chunking.mode, MODES), (g.anki.deck_structure, STRUCTURES), (g.ids.strategy, ("content_hash", "persistent")),
            (p.deduplication.policy, ("or", "and")), (p.llm.provider, ("openai", "anthropic")),
        ):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")

    @classmethod
    def from_dict(cls, data: dict[str, Any] | None) -> Config:
        """Settings from a tree. Flat trees, whose sections stand on top, are read as well, with a warning."""
        data = dict(data or {})
        homes = {f.name: home for home in ("pipeline", "generate") for f in fields(Pipeline if home == "pipeline" else Generate)}
        if flat := sorted(homes.keys() & data.keys()):
            warnings.warn(f"sections {', '.join(flat)} on top are read as parts of 'pipeline' and 'generate'", DeprecationWarning, stacklevel=2)
            for name in flat:
                data[homes[name]] = {**(data.get(homes[name]) or {}), name: data.pop(name)}
        return _build(cls, data, "")

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))

    def to_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(asdict(self), f, sort_keys=False)


def _build(cls: type, data: dict[str, Any] | None, at: str):
    known = {f.name: f for f in fields(cls)}
    out = {}
    for k, x in (data or {}).items():
        if k not in known:
            warnings.warn(f"there is no setting {at}{k}; it is left out", UserWarning, stacklevel=2)
            continue
        default = known[k].default_factory() if callable(known[k].default_factory) else known[k].default
        out[k] = _build(type(default), x, f"{at}{k}.") if is_dataclass(default) else x
    return cls(**out)
