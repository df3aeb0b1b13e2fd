"""Settings, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1960
    chunk_overlap: int = 392
    daily_limit: int = 500
    glean_rounds: int = 0
    top_k: int = 12
    max_context_entities: int = 20
    merge_threshold: float = 0.92
    review_threshold: float = 0.80
    bridge_threshold: float = 0.90
    max_name_hints: int = 30
    backup_keep: int = 10
    min_candidates: int = 2
    leiden_seed: int = 42
    community_max_size: int = 30
    community_max_level: int = 3
    report_top_levels: int = 1
    report_level: int = 0
    external_max: int = 20
    admit_ratio: float = 0.55
    admit_min: int = 3
    admit_max: int = 20
    max_subqueries: int = 4
    extraction_mode: str = "auto"
    profile: str = "quality"
    fast_threshold: int = 3
    coref_merge: bool = True
    first_person_scope: str = "document"


DEFAULTS = Settings()
