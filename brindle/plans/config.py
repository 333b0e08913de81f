"""Parameters of the pipelines with their defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from brindle.operators.entity import TIERS, V3_GRID
from brindle.operators.retrieval import GRID, RECALL_FLOOR


@dataclass(frozen=True)
class RetrievalConfig:
    k_overlap: int = 20
    k_tfidf: int = 10
    k_neigh: int = 3
    max_features: int = 250_000
    min_common: int = 1
    grid: dict = field(default_factory=lambda: dict(GRID))
    recall_floor: float = RECALL_FLOOR
    synonyms: int = 4
    neighbours: int = 20


@dataclass(frozen=True)
class SelectionConfig:
    mode: str = "greedy_1to1"
    threshold: float | None = None
    quantiles: int = 401
    rank_src_max: int = 0
    rank_tgt_max: int = 0


@dataclass(frozen=True)
class ScorerConfig:
    kind: str = "gbt"
    maxIter: int = 40
    maxDepth: int = 6
    stepSize: float = 0.05
    subsamplingRate: float = 0.8
    seed: int = 2026
    folds: int = 3


@dataclass(frozen=True)
class GateConfig:
    grid: tuple = V3_GRID
    recall_ratio: float = 0.95
    tiers: dict = field(default_factory=lambda: dict(TIERS))
    counterfactual_weight: float = 0.25
    counterfactual_ratio: float = 0.5
    counterfactual_floor: int = 20


@dataclass(frozen=True)
class PairConfig:
    pair: str = "src-tgt"
    mode: str = "classes"
    retrieval: RetrievalConfig = RetrievalConfig()
    scorer: ScorerConfig = ScorerConfig()
    selection: SelectionConfig = SelectionConfig()
    gates: GateConfig = GateConfig()

    def name(self) -> str:
        """The pair's name in lower case with single dashes."""
        return re.sub(r"[^a-z0-9]+", "-", self.pair.lower()).strip("-")

    def seed(self, pair_index: int, expert_index: int) -> int:
        return self.scorer.seed + 10_000 * pair_index + 100 * expert_index


def safe_name(model: str) -> str:
    """A model name that can be part of a path."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", model.rstrip("/").rsplit("/", 1)[-1])


def parse_grid(text: str, kind=int, positive: bool = True) -> list:
    """Distinct numbers of a comma-separated list in order; fails on none and, with `positive`, on numbers below 0."""
    out = list(dict.fromkeys(kind(x) for x in text.split(",") if x.strip()))
    if not out or (positive and min(out) < 0):
        raise ValueError(f"unusable grid {text!r}")
    return out
