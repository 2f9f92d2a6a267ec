"""Parameters of a study: one frozen record, passed to every stage."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Study:
    """Dates and sizes of one study; the defaults are the published study's."""

    cut: dt.date = dt.date(2025, 2, 28)
    definition_start: dt.date = dt.date(2023, 6, 1)
    scoring_start: dt.date = dt.date(2025, 4, 1)
    horizon: int = 60
    cohort_days: int = 60
    new_client_days: int = 90
    windows: tuple[int, ...] = (15, 30, 60, 90)
    inactivity_days: int = 60
    seed: int = 123
    train_percent: int = 70
    folds: int = 5

    def last_look_ahead(self) -> dt.date:
        return self.cut + dt.timedelta(days=self.horizon)


@dataclass(frozen=True)
class TreeParams:
    cp: float = 1e-4
    min_split: int = 15
    min_bucket: int = 7
    max_depth: int = 30
    max_bins: int = 128
    max_leaves: int = 25


@dataclass(frozen=True)
class ForestParams:
    """One forest; `max_leaves` limits the leaves of each tree (None: no limit), depth 30 is the deepest Spark grows."""

    mtry: int = 6
    trees: int = 100
    sample_rate: float = 1.0
    min_node: int = 1
    max_leaves: int | None = None
    max_depth: int = 30
    max_bins: int = 128


def forest_grid(
    n_features: int,
    trees=(100, 300, 500),
    rates=(0.6, 0.7, 0.8, 1.0),
    min_nodes=(1, 5, 10),
    leaf_limits=(None, 50, 100),
) -> list[ForestParams]:
    """The whole search grid: 324 combinations for 33 features."""
    middle = round(n_features**0.5)
    tries = sorted({max(1, middle - 2), middle, min(n_features, middle + 2)})
    return [
        ForestParams(m, t, r, s, limit)
        for limit in leaf_limits for s in min_nodes for r in rates for t in trees for m in tries
    ]


@dataclass(frozen=True)
class LogisticParams:
    """`tol` ends a single LASSO fit; `tolerance` is how far from an optimum, as a share of the penalty, it may be."""

    correlation_limit: float = 0.9
    vif_limit: float = 5.0
    lambdas: int = 20
    lambda_ratio: float = 1e-3
    forced_drops: tuple[str, ...] = ("weekend_sales", "total_amount", "mean_ticket")
    drop_by_vif: bool = False
    use_context: bool = False
    max_iter: int = 100
    tol: float = 1e-8
    tolerance: float = 1e-3


@dataclass(frozen=True)
class ValueParams:
    """Discounting of expected losses: `rate` per period, `months` payments, half a period's delay."""

    rate: float = 0.04
    months: int = 12

    @property
    def factor(self) -> float:
        v = 1 / (1 + self.rate)
        return v**0.5 * (1 - v**self.months) / (1 - v)


@dataclass(frozen=True)
class Settings:
    study: Study = field(default_factory=Study)
    tree: TreeParams = field(default_factory=TreeParams)
    forests: tuple[ForestParams, ...] = (ForestParams(4), ForestParams(6), ForestParams(8))
    logistic: LogisticParams = field(default_factory=LogisticParams)
    value: ValueParams = field(default_factory=ValueParams)
