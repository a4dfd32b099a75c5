"""Validated settings. Keys that begin with an underscore are comments, unknown keys are errors, null blocks switch a part off."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_args, get_type_hints


@dataclass(frozen=True)
class Agentic:
    max_chars_per_page: int = 8000
    max_steps: int = 20
    section_top_n: int = 5
    section_char_budget: int = 15000


@dataclass(frozen=True)
class Reranker:
    kind: str = "late_interaction"
    model: str | None = None


@dataclass(frozen=True)
class Settings:
    """Defaults of a question's way from channels to context."""

    project_name: str = "docs"
    k_standard: int = 40
    k_deep_dive: int = 60
    k_retrieve: int | None = None
    deep_dive_batch_size: int = 10
    top_n_after_rerank: int = 15
    expansion_char_budget: int = 60000
    bm25_enabled: bool = True
    title_boost_enabled: bool = True
    hyde_enabled: bool = False
    temperature: float = 0.0
    max_tokens: int = 2000
    reranker: Reranker | None = None
    agentic: Agentic | None = field(default_factory=Agentic)

    def __post_init__(self) -> None:
        if " " in self.project_name:
            raise ValueError("project_name must not contain a blank")

    def depth(self, *, deep_dive: bool = False) -> tuple[int, int]:
        """How many rows each channel gives, and how many the fused pool has; a deep dive ignores ``k_retrieve``."""
        k = self.k_deep_dive if deep_dive else self.k_standard
        return (k if deep_dive or self.k_retrieve is None else self.k_retrieve), k


@dataclass(frozen=True)
class Extraction:
    """Defaults of the way from pages to chunks."""

    max_tokens: int = 384
    overlap_tokens: int = 50
    char_chunk_size: int = 1000
    char_overlap: int = 200
    min_score: float = 0.3
    min_word_count: int = 50
    substantial_word_count: int = 100
    use_token_chunking: bool = False

    def __post_init__(self) -> None:
        if self.char_chunk_size < self.char_overlap + 100:
            raise ValueError("char_chunk_size must be at least char_overlap + 100")
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("overlap_tokens must be below max_tokens")


def build(kind: type, given: dict[str, Any] | None):
    """An instance of a settings class from a mapping."""
    blocks = {"reranker": Reranker, "agentic": Agentic}
    given = {k: v for k, v in (given or {}).items() if not k.startswith("_")}
    known = {f.name for f in fields(kind)}
    if unknown := sorted(given.keys() - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**{k: build(blocks[k], v) if k in blocks and isinstance(v, dict) else v for k, v in given.items()})


def load(kind: type, path: str | None = None):
    """Settings from the file given, else from ./config.json if it is there, else the defaults."""
    if path is None and not Path("config.json").exists():
        return kind()
    return build(kind, json.loads(Path(path or "config.json").read_text(encoding="utf-8")))


def set_dotted(config: dict, key: str, value: Any) -> dict:
    """A copy of a nested mapping with the value at a dotted key."""
    head, _, rest = key.partition(".")
    return config | {head: set_dotted(config.get(head) or {}, rest, value) if rest else value}


def without_comments(config: Any) -> Any:
    if isinstance(config, dict):
        return {k: without_comments(v) for k, v in config.items() if not k.startswith("_")}
    return [without_comments(v) for v in config] if isinstance(config, list) else config


def config_hash(config: dict) -> str:
    """Twelve hex digits that depend on the settings, not on the order of keys; names a corpus variant's folder."""
    return hashlib.sha256(json.dumps(without_comments(config), sort_keys=True).encode()).hexdigest()[:12]


def combinations(choices: dict[str, list]) -> list[dict]:
    """All combinations of the values, the last key fastest; one empty one without keys."""
    return [dict(zip(choices, values, strict=True)) for values in itertools.product(*choices.values())]


KINDS = ("int", "float", "bool", "categorical")


def check_space(space: dict[str, dict], fixed: dict[str, Any], settings: type = Settings) -> None:
    """Refuse search spaces with unknown parameters or kinds, wrong bounds, or parameters that are fixed as well."""
    known = {f.name for f in fields(settings)}
    if both := sorted(space.keys() & fixed.keys()):
        raise ValueError(f"both fixed and searched: {', '.join(both)}")
    if unknown := sorted((space.keys() | fixed.keys()) - known):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    for name, spec in space.items():
        kind = spec.get("type")
        if kind not in KINDS:
            raise ValueError(f"{name}: type must be one of {', '.join(KINDS)}")
        if kind in ("int", "float") and not spec.get("low", 1) <= spec.get("high", 0):
            raise ValueError(f"{name}: needs low <= high")
        if kind == "categorical" and not spec.get("choices"):
            raise ValueError(f"{name}: needs choices")


def draw(spec: dict, rng: random.Random) -> Any:
    """One value of a parameter: whole numbers by ``step``, real ones by their logarithm with ``log``."""
    if spec["type"] == "int":
        return rng.randrange(spec["low"], spec["high"] + 1, spec.get("step", 1))
    if spec["type"] == "float":
        if spec.get("log"):
            return math.exp(rng.uniform(math.log(spec["low"]), math.log(spec["high"])))
        return rng.uniform(spec["low"], spec["high"])
    return rng.random() < 0.5 if spec["type"] == "bool" else rng.choice(spec["choices"])


def sample_space(space: dict[str, dict], fixed: dict[str, Any], trials: int, seed: int = 0) -> list[dict]:
    """Random parameters for each trial, the same for the same seed; fixed ones first."""
    rng = random.Random(seed)
    return [fixed | {name: draw(spec, rng) for name, spec in space.items()} for _ in range(trials)]


def sample_trials(space: dict[str, Any], fixed: dict[str, dict[str, Any]], trials: int, seed: int = 0) -> list[dict]:
    """For each trial ``mode, params, extraction, names``: a mode is drawn, then the parameters of that mode alone, those of ``model`` and of ``extraction`` always.

    ``names`` are the values drawn under ``<block>__<parameter>``, as blocks may have parameters of one name. Without an extraction block it is None.
    """
    rng, out = random.Random(seed), []
    for _ in range(trials):
        mode = rng.choice(space["mode"]["choices"])
        drawn = {b: {name: draw(spec, rng) for name, spec in space[b].items()} for b in (mode, "model", "extraction") if b in space}
        merged = {b: fixed.get(b, {}) | drawn[b] for b in drawn}
        params = merged.get(mode, fixed.get(mode, {})) | merged.get("model", {})
        names = {"mode": mode} | {f"{b}__{k}": v for b, own in drawn.items() for k, v in own.items()}
        out.append({"mode": mode, "params": params, "extraction": merged.get("extraction"), "names": names})
    return out


#: Names of types in a JSON schema.
JSON_TYPES = {str: "string", float: "number", int: "number", bool: "boolean"}


def json_schema(kind: type, name: str) -> dict:
    """The strict JSON schema of a typed dictionary or data class; a string in an annotated type is the field's description."""
    properties = {}
    for field_name, annotation in get_type_hints(kind, include_extras=True).items():
        args = get_args(annotation)
        prop = {"type": JSON_TYPES.get(args[0] if args else annotation, "string")}
        about = [a for a in args[1:] if isinstance(a, str)]
        properties[field_name] = prop | ({"description": about[0]} if about else {})
    schema = {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}
    return {"name": name, "strict": True, "schema": schema}


def as_dict(settings: Any) -> dict:
    return {f.name: as_dict(v) if is_dataclass(v := getattr(settings, f.name)) else v for f in fields(settings)}
