"""Typed settings of the operators, checked as a whole before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Ranking:
    weights: dict[str, float] = field(default_factory=lambda: {"document_count": 0.7, "source_count": 0.3})
    z_clip: float = 3.0
    lexical_weight: float = 0.65
    least_cosine: float = 0.4


@dataclass(frozen=True)
class Linking:
    neighbours: int = 8
    least_cosine: float = 0.7
    merge_cosine: float = 0.95
    least_shared: int = 2
    most_members: int = 24


@dataclass(frozen=True)
class Dataset:
    horizon_months: int = 12
    valid_share: float = 0.8
    test_share: float = 0.9
    embargo_months: int = 12
    most_missing: float = 0.4
    most_correlated: float = 0.95


@dataclass(frozen=True)
class Settings:
    ranking: Ranking = Ranking()
    linking: Linking = Linking()
    dataset: Dataset = Dataset()

    def problems(self) -> list[str]:
        """Everything that contradicts, not only the first."""
        out = []
        if not self.ranking.weights or self.ranking.z_clip <= 0:
            out.append("ranking needs weights and a positive z_clip")
        for part, names in ((self.ranking, ("lexical_weight", "least_cosine")), (self.linking, ("least_cosine", "merge_cosine")), (self.dataset, ("valid_share", "test_share", "most_missing", "most_correlated"))):
            out += [f"{n} must lie within 0 and 1" for n in names if not 0 <= getattr(part, n) <= 1]
        if self.dataset.valid_share >= self.dataset.test_share:
            out.append("valid_share must be less than test_share")
        if self.linking.merge_cosine < self.linking.least_cosine:
            out.append("merge_cosine must not be less than least_cosine")
        return out


def load(values: dict) -> Settings:
    """Settings from nested dictionaries; unknown names and contradictions are errors."""
    parts, known = {}, {f.name: f for f in fields(Settings)}
    for name, part in values.items():
        if name not in known:
            raise ValueError(f"unknown settings: {name}")
        kind = type(getattr(Settings(), name))
        wrong = set(part) - {f.name for f in fields(kind)}
        if wrong:
            raise ValueError(f"unknown settings: {sorted(wrong)}")
        parts[name] = kind(**part)
    out = Settings(**parts)
    if out.problems():
        raise ValueError("; ".join(out.problems()))
    return out
