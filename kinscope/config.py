"""Settings of the engine. Every value is a parameter of the operators; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMES = ("smooth_idf", "plain_idf", "binary")
METRICS = ("cosine", "jaccard", "weighted_jaccard")
LINKAGES = ("average", "single", "complete")


@dataclass(frozen=True)
class Config:
    """Defaults as published for the reference configuration; `validate` is called by everything that takes a Config."""

    scheme: str = "smooth_idf"
    smoothing: float = 1.0
    metric: str = "cosine"
    min_features: int = 5
    top_k: int = 10
    min_score: float = 0.05
    max_evidence: int = 8
    coverage_correction: bool = True
    coverage_power: float = 1.0
    component_weights: dict[str, float] = field(default_factory=lambda: {"rarity": 0.40, "margin": 0.35, "sufficiency": 0.25})
    high_level: float = 0.70
    medium_level: float = 0.45
    margin_saturation: float = 0.15
    min_known: int = 3
    saturation_known: int = 12
    weak_component: float = 0.34
    linkage: str = "average"
    distance_threshold: float = 0.65
    min_cluster: int = 2
    seed: int = 1337
    repeats: int = 20
    max_query_features: int = 400
    max_id_chars: int = 40
    max_blob_chars: int = 16_000
    max_top_k: int = 50

    def validate(self) -> Config:
        if self.scheme not in SCHEMES:
            raise ValueError(f"scheme must be one of {SCHEMES}, not {self.scheme!r}")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, not {self.metric!r}")
        if self.linkage not in LINKAGES:
            raise ValueError(f"linkage must be one of {LINKAGES}, not {self.linkage!r}")
        if abs(sum(self.component_weights.values()) - 1) > 1e-9 or set(self.component_weights) != {"rarity", "margin", "sufficiency"}:
            raise ValueError("component weights are rarity, margin and sufficiency, and add up to 1")
        if not 0 <= self.medium_level <= self.high_level <= 1:
            raise ValueError("levels must ascend within 0 and 1")
        if self.top_k < 1 or self.min_features < 1 or self.smoothing < 0 or not 0 <= self.min_score <= 1:
            raise ValueError("top_k and min_features start at 1, smoothing at 0, and min_score lies within 0 and 1")
        if not 0 < self.distance_threshold <= 1:
            raise ValueError("distance_threshold lies within 0 and 1")
        return self
