"""Settings of a reconciliation run."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from .functions.tables import HOLIDAYS


@dataclass(frozen=True)
class Weights:
    identifier: float = 0.6
    token_set: float = 0.3
    jaro_winkler: float = 0.1


@dataclass(frozen=True)
class Signals:
    string: float = 0.5
    amount: float = 0.2
    date: float = 0.3


@dataclass(frozen=True)
class MatchConfig:
    holidays: tuple[dt.date, ...] = HOLIDAYS
    settlement_window: int = 2
    date_slack: int = 1
    amount_tolerance_pct: float = 0.5
    strings: Weights = field(default_factory=Weights)
    signals: Signals = field(default_factory=Signals)
    accept: float = 0.72
    floor: float = 0.2
    #: A date score fades out over so many times the window and slack beyond the window.
    date_fade: int = 3
    #: Components with more candidate edges are matched greedily, not optimally.
    assignment_edges: int = 400
    max_agent_records: int = 20
    fuzzy: bool = True
    holiday_aware: bool = True
    assignment: bool = True
    agent: bool = True
    fx: bool = True

    def but(self, **changes) -> MatchConfig:
        return replace(self, **changes)


_LADDER = (
    ("Exact only", {"fuzzy": False, "holiday_aware": False, "assignment": False, "agent": False, "fx": False}),
    ("+ Fuzzy", {"fuzzy": True}),
    ("+ FX normalization", {"fx": True}),
    ("+ Holiday-aware windows", {"holiday_aware": True}),
    ("+ Optimal assignment", {"assignment": True}),
    ("+ LLM adjudication", {"agent": True, "max_agent_records": 5}),
)


def ablation_ladder(base: MatchConfig | None = None) -> list[tuple[str, MatchConfig]]:
    """Each rung adds one capability to the one before."""
    cfg, out = base or MatchConfig(), []
    for label, changes in _LADDER:
        cfg = cfg.but(**changes)
        out.append((label, cfg))
    return out
