"""Every knob of the engine, passed explicitly; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class ChunkConfig:
    target: int = 450
    least: int = 300
    most: int = 600
    overlap: int = 80
    look_ahead: int = 30

    def __post_init__(self):
        if self.overlap >= min(self.target, self.least, self.most):
            raise ValueError("the overlap must be shorter than a chunk, or chunking would never end")


@dataclass(frozen=True)
class GazetteerConfig:
    min_length: int = 5
    most_per_motif: int = 500
    anti_window: int = 60
    use_anti: bool = True


@dataclass(frozen=True)
class SemanticConfig:
    top_n: int = 8
    least_similarity: float = 0.70
    most_per_scene: int = 3


@dataclass(frozen=True)
class JudgeConfig:
    top_k: int = 8
    keep: int = 3
    snippet: int = 480
    scene_prompt: int = 2400
    shortlist: int = 12
    shortlist_chars: int = 4000
    threshold: float = 0.25
    prior_unmentioned: float = 0.55
    similarity_cut: float = 0.36


@dataclass(frozen=True)
class VerifierConfig:
    threshold: float = 0.32
    alpha: float = 0.7
    gain: float = 0.05
    sentences: int = 2
    most_chars: int = 280
    window: int = 40
    negation_factor: float = 0.6
    meta_factor: float = 0.75
    anti_factor: float = 0.5


@dataclass(frozen=True)
class CalibrationConfig:
    bins: int = 10
    step: float = 0.01
    objective: str = "f1@precision"
    min_precision: float = 0.70
    min_recall: float = 0.10
    min_samples: int = 8


def params(*configs) -> dict:
    """All knobs of some configurations, by class and name: what a run is stamped with."""
    return {type(c).__name__: asdict(c) for c in configs}
