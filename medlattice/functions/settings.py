"""Thresholds of the clinical operators, and a YAML loader for a site's own values."""
from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .config import CUES, SECTIONS


@dataclass(frozen=True)
class Settings:
    """Tunable thresholds; ``load`` reads ``section: {key: value}`` from YAML and keeps defaults for the rest."""

    max_len: int = 120
    max_words_symptom: int = 10
    max_words_drug: int = 8
    drug_min_ascii: int = 4
    fuzz_threshold: float = 88
    substr_coverage: float = 0.60
    bare_conf: float = 0.95
    neg_window: int = 35
    fuzzy_threshold: float = 90
    disease_fuzzy_threshold: float = 82
    sections: dict = field(default_factory=lambda: SECTIONS)
    cues: dict = field(default_factory=lambda: CUES)


def load(thresholds: str | None = None, sections: str | None = None, cues: str | None = None) -> Settings:
    """Settings from YAML files (driver side)."""
    import yaml

    def read(path):
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}

    out = Settings()
    if thresholds:
        known = {f.name for f in fields(Settings)}
        values = {k: v for part in read(thresholds).values() for k, v in part.items() if k in known}
        out = replace(out, **values)
    if sections:
        from .text import normalize_literal

        out = replace(out, sections={k: [normalize_literal(p) for p in v] for k, v in read(sections).items()})
    return replace(out, cues=CUES | read(cues)) if cues else out
