"""Settings: defaults, checks, and the layered merge of config mappings."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values: results depend on them. Zero is a legal value everywhere."""

    max_chunk_tokens: int = 1500
    max_symbol_chunk_tokens: int = 900
    max_results: int = 25
    max_token_budget: int = 1200
    max_exact_token_budget: int = 4000
    layer_boosts: dict[str, float] = field(default_factory=lambda: {"session": 1.5, "repo": 1.3, "workspace": 1.1, "global": 1.0})
    graph_depth: int = 2
    graph_max_nodes: int = 20
    max_graph_boost: float = 10.0
    diversity_decay: float = 0.7
    diversity_start: int = 3
    fts_limit: int = 15
    embeddings: bool = True
    embeddings_retrieval: bool = False
    memory_injection: str = "relevant"
    sent_dedup: bool = True
    token_calibration: float = 1.0
    framing_reserve: int = 48
    graph_expansion: bool = True
    containment_dedup: bool = True
    diversity_filter: bool = True
    patterns: tuple[str, ...] = ("**/*.md", "**/*.txt", "**/AGENTS.md", "**/CLAUDE.md", "**/SKILLS.md", "**/.cursor/rules/**", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.go", "**/go.mod", "**/*.proto", "**/*.rs", "**/*.java", "**/*.c", "**/*.cpp", "**/*.h", "**/*.hpp", "**/*.cs", "**/*.json", "**/*.yaml", "**/*.yml", "**/*.toml", "**/*.ini")
    ignore: tuple[str, ...] = ("**/node_modules/**", "**/.git/**", "**/dist/**")

    def __post_init__(self):
        if min(self.max_chunk_tokens, self.max_symbol_chunk_tokens, self.max_results, self.max_token_budget) < 1:
            raise ValueError("sizes must be positive")
        if not 0 <= self.diversity_decay <= 1 or min(self.graph_depth, self.graph_max_nodes, self.diversity_start, self.fts_limit) < 0:
            raise ValueError("out of range")
        if self.memory_injection not in ("off", "always", "relevant"):
            raise ValueError("memory_injection is off, always or relevant")


RRF_K = 60
CLASS_CHILDREN = 3
MIN_EDGE_WEIGHT, HUB_DEGREE, MIN_ENTITY = 0.5, 30, 3
MAX_FILE_BYTES = 2 << 20
MEMORY_TOKENS = 120
SESSION_MAX_MS = 24 * 3600 * 1000
SENT_TTL_MS = 15 * 60 * 1000
#: BM25's published constants, and the weight of each indexed column.
K1, B = 1.2, 0.75
COLUMN_WEIGHTS = {"content": 10.0, "summary": 6.0, "keywords": 20.0, "section_title": 8.0}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over wins; mappings merge; lists are united in order, unless the key ends in '!', which replaces."""
    out = dict(base)
    for key, value in over.items():
        name = key.removesuffix("!")
        old = out.get(name)
        if key.endswith("!") or old is None:
            out[name] = value
        elif isinstance(old, dict) and isinstance(value, dict):
            out[name] = merged(old, value)
        elif isinstance(old, (list, tuple)) and isinstance(value, (list, tuple)):
            out[name] = tuple(dict.fromkeys([*old, *value]))
        else:
            out[name] = value
    return out


def load(*layers: dict[str, Any]) -> tuple[Config, list[str]]:
    """(config, unknown keys, which are dropped) from mappings, the most general first."""
    values: dict[str, Any] = dataclasses.asdict(Config())
    unknown = []
    for layer in layers:
        known = {k: v for k, v in layer.items() if k.removesuffix("!") in values}
        unknown += [k for k in layer if k not in known]
        values = merged(values, known)
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}), unknown


def fingerprint(cfg: Config, version: str = "1") -> str:
    """What an index depends on; another value asks for a full rebuild."""
    parts = [cfg.patterns, cfg.ignore, cfg.max_chunk_tokens, cfg.max_symbol_chunk_tokens, cfg.embeddings, version]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()
