"""Configuration in layers: defaults, a global file, a repository's file, the environment, what the caller says."""

from __future__ import annotations

import copy
import os
import re
from collections.abc import Mapping

#: The defaults of every setting.
DEFAULTS: dict = {
    "database": {"path": "~/.siftline"},
    "embedding": {"provider": "hash", "dimensions": 384, "model": "hash"},
    "indexing": {"max_chunk_tokens": 800, "chunk_overlap": 100, "debounce_ms": 1000, "concurrency": 4, "max_file_bytes": 2 << 20},
    "search": {"vector_weight": 0.70, "keyword_weight": 0.20, "symbol_weight": 0.10, "path_weight": 0.05, "structural_weight": 0.05, "dependency_weight": 0.08, "reference_weight": 0.08, "test_weight": 0.03, "recency_weight": 0.02, "limit": 10, "per_file": 4, "per_symbol": 2},
    "retrieval": {"seeds": 8, "hops": 2, "chunks": 20, "tokens": 12_000, "threshold": 0.15},
    "security": {"allow_sensitive_files": False},
    "ignore": [],
}

PREFIX = "SIFTLINE_"


def _key(name: str) -> str:
    """camelCase and kebab-case names as snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()


def merged(base: dict, layer: Mapping | None) -> dict:
    """base with a layer over it: maps are merged, ignore lists grow, anything else is replaced; unknown keys are kept."""
    out = copy.deepcopy(base)
    for name, value in (layer or {}).items():
        key = _key(str(name))
        if isinstance(value, Mapping) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif key == "ignore":
            out[key] = [*out.get(key, []), *(value or [])]
        elif value is not None:
            out[key] = value
    return out


def read_file(path: str) -> dict:
    """A YAML file as a map; {} where there is none, no YAML library, or something else in it."""
    try:
        import yaml
    except ImportError:
        return {}
    try:
        with open(os.path.expanduser(path), encoding="utf-8") as file:
            found = yaml.safe_load(file)
    except (OSError, yaml.YAMLError):
        return {}
    return found if isinstance(found, dict) else {}


def _typed(text: str, like) -> object:
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, list):
        return [x.strip() for x in text.split(",") if x.strip()]
    try:
        return type(like)(text) if isinstance(like, int | float) else text
    except ValueError:
        return like


def from_environment(env: Mapping[str, str], defaults: dict = DEFAULTS) -> dict:
    """Settings named SIFTLINE_SECTION_KEY; values that don't fit the type of the default are left out."""
    out: dict = {}
    for section, values in defaults.items():
        if isinstance(values, dict):
            for key, like in values.items():
                if (text := env.get(f"{PREFIX}{section}_{key}".upper())) is not None:
                    out.setdefault(section, {})[key] = _typed(text, like)
        elif (text := env.get(f"{PREFIX}{section}".upper())) is not None:
            out[section] = _typed(text, values)
    return out


def load(repo: str | None = None, env: Mapping[str, str] | None = None, given: Mapping | None = None, home: str = "~/.siftline/config.yaml") -> dict:
    """All layers, the later ones over the earlier: defaults, home, the repository's .siftline.yaml, environment, given."""
    out = merged(DEFAULTS, read_file(home))
    if repo:
        out = merged(out, read_file(os.path.join(repo, ".siftline.yaml")))
    return merged(merged(out, from_environment(os.environ if env is None else env)), given)


def weights(config: dict) -> dict[str, float]:
    """Signal weights by signal."""
    return {("semantic" if k == "vector_weight" else k.removesuffix("_weight")): float(v) for k, v in config["search"].items() if k.endswith("_weight")}
