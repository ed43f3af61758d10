"""Defaults of the engine, in one place."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    dedup_distance: float = 0.061
    edge_threshold: float = 0.32
    max_edges: int = 8
    search_distance: float = 0.451
    top_k: int = 5
    pool: int = 20
    rerank_pool: int = 40
    rrf_k: int = 60
    chunk_words: int = 400
    overlap_words: int = 50
    max_bytes: int = 500_000
    code_lines: int = 80
    code_overlap: int = 10
    min_file_bytes: int = 20
    snippet_chars: int = 600
    max_depth: int = 5
    ks: tuple[int, ...] = (1, 3, 5, 10, 20)
    max_lookups: int = 4
    max_claims: int = 20
    api_limit: int = 50
    document_chars: int = 200_000
    preview_chars: int = 200
    generate_model: str = ""
    deep_model: str = ""
    mcp_enabled: bool = False


DEFAULTS = Settings()


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """The defaults, over them a JSON file (unknown names are an error; a missing file is none), over it LODESTONE_<NAME> of the
    environment."""
    out, kinds = DEFAULTS, {f.name: type(getattr(DEFAULTS, f.name)) for f in fields(Settings)}
    if path and os.path.exists(path):
        with open(path) as f:
            held = json.load(f)
        if unknown := set(held) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out = replace(out, **{k: tuple(v) if kinds[k] is tuple else kinds[k](v) for k, v in held.items()})
    for name, value in (os.environ if environment is None else environment).items():
        k = name.removeprefix("LODESTONE_").lower()
        if name.startswith("LODESTONE_") and k in kinds:
            made = value.lower() in ("1", "true", "yes") if kinds[k] is bool else tuple(int(x) for x in value.split(",")) if kinds[k] is tuple else kinds[k](value)
            out = replace(out, **{k: made})
    return out


def save(path: str, settings: Settings) -> None:
    """What differs from the defaults, as JSON."""
    held = {f.name: getattr(settings, f.name) for f in fields(Settings) if getattr(settings, f.name) != getattr(DEFAULTS, f.name)}
    with open(path, "w") as f:
        json.dump(held, f, indent=2)
