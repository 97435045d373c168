"""Settings of the engine, from code, environment or a file of KEY=VALUE lines."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from math import isfinite

PREFIX = "RECALLGRID_"


@dataclass(frozen=True)
class Config:
    store_text: bool = True
    store_text_maxlen: int | None = None
    vocab_size: int = 65_536
    dim: int = 256
    seed: int = 41
    char_ngrams: tuple = (2,)
    jamo_ngrams: tuple = (3, 5)
    suffix_strip: bool = True
    cross_space: bool = True
    title_boost: float = 2.0
    max_doc_tokens: int | None = None
    max_query_tokens: int | None = None
    bm25_seed_k: int = 24
    vector_seed_k: int = 24
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    ppr_alpha: float = 0.5
    ppr_iters: int = 20
    graph_expand_k: int = 16
    top_k: int = 8
    knn_edges: int = 6
    knn_min_sim: float = 0.25
    knn_sample_cap: int | None = None
    tag_fanout: int = 6
    hebb_eta: float = 0.3
    hebb_decay: float = 0.9
    hebb_prune: float = 0.05
    hidden: int = 16
    lr: float = 0.05
    l2: float = 1e-4
    replay_cap: int = 4096
    blend_min_events: int = 100
    epsilon: float = 0.05
    trust_helpful: float = 0.05
    trust_unhelpful: float = 0.10
    trust_half_life_days: float = 45.0
    trust_weight: float = 2.0
    distill_epochs: int = 4
    distill_lr: float = 1e-3
    distill_batch: int = 64

    def __post_init__(self):
        least = {"dim": 1, "vocab_size": 2, "hidden": 1, "top_k": 1, "max_doc_tokens": 1, "max_query_tokens": 1, "knn_sample_cap": 1}
        for name, bound in least.items():
            if getattr(self, name) is not None and getattr(self, name) < bound:
                raise ValueError(f"{name} must be at least {bound}")
        for name in ("epsilon", "trust_helpful", "trust_unhelpful"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("lr", "l2", "trust_half_life_days", "trust_weight"):
            value = getattr(self, name)
            if not isfinite(value) or value < 0 or (name == "lr" and value == 0):
                raise ValueError(f"{name} must be finite and not negative (lr: above 0)")

    @property
    def tokens(self) -> dict:
        return {"sizes": self.char_ngrams, "strip": self.suffix_strip, "cross": self.cross_space}

    @classmethod
    def from_env(cls, dotenv: str | None = None, **overrides) -> "Config":
        """Overrides win over the environment, it over ``dotenv``, that over the defaults."""
        known = {**(read_dotenv(dotenv) if dotenv else {}), **os.environ}
        values = {f.name: _convert(known[PREFIX + f.name.upper()], f.default) for f in fields(cls) if PREFIX + f.name.upper() in known}
        return cls(**{**values, **{k: v for k, v in overrides.items() if v is not None}})


def _convert(text: str, like):
    if isinstance(like, bool):
        return text.strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(like, tuple):
        return tuple(map(int, text.replace(",", " ").split()))
    if like is None:
        return int(text) if text.strip().lower() not in {"", "none"} else None
    return type(like)(text)


def read_dotenv(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments, ``export`` and quotes are understood, a missing file is empty.
    With ``override`` the values also replace those of the process environment."""
    found = {}
    try:
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                key, sep, value = line.removeprefix("export ").partition("=")
                if sep and not line.startswith("#"):
                    found[key.strip()] = value.strip().strip("'\"")
    except FileNotFoundError:
        return {}
    if override:
        os.environ.update(found)
    return found
