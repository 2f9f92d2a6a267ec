"""Features of a cohort, from sales and accounts to a table without missing values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean_accounts, clean_sales, last_day, one_per_key
from ..operators.history import HISTORY, RATIOS, client_features, window_columns, with_ratios
from ..operators.imputing import fill_medians, fill_two_event, fill_windows, fit_medians
from ..params import Study
from ..session import materialise

CONTEXT = ["province", "account_type", "sector"]


def predictors(study: Study) -> list[str]:
    history = [c for c in HISTORY if c not in ("sales", "approved")]
    return [*history, *window_columns(study.windows), *RATIOS, *CONTEXT]


def with_context(features: DataFrame, accounts: DataFrame, dedup: str = "before") -> DataFrame:
    """Left join of the account columns.

    `dedup` says what happens to clients with several account rows: one account row is kept "before" the join, one
    joined row is kept "after" it, or "never", which repeats the client.
    """
    accounts = one_per_key(accounts) if dedup == "before" else accounts
    joined = features.join(accounts.select("client_id", *CONTEXT), "client_id", "left")
    return one_per_key(joined) if dedup == "after" else joined


def raw_features(
    sales: DataFrame,
    accounts: DataFrame,
    study: Study,
    since: dt.date | None = None,
    cut: dt.date | None = None,
    labelled: bool = True,
    dedup: str = "before",
) -> DataFrame:
    """Predictors of the active clients with their label, missing values still in place."""
    rated = with_ratios(client_features(sales, study, since, cut, labelled), study.windows)
    joined = with_context(rated, accounts, dedup)
    return joined.select("client_id", *predictors(study), *(["churned"] if labelled else []))


def fill_rules(raw: DataFrame, study: Study) -> DataFrame:
    """Fills that need no fitting: 0 for empty windows, -1 for measures of two events."""
    return fill_two_event(fill_windows(raw, study.windows))


def training_features(
    raw_sales: DataFrame, raw_accounts: DataFrame, study: Study, dedup: str = "before"
) -> tuple[DataFrame, dict[str, float]]:
    """The labelled feature table and the medians that filled it: those of columns that lack a value.

    The table is written before the medians are fitted on it, so the sales are read once.
    """
    sales = clean_sales(raw_sales, until=study.last_look_ahead())
    filled = fill_rules(raw_features(sales, clean_accounts(raw_accounts), study, dedup=dedup), study)
    filled = materialise(filled, "features")
    medians = fit_medians(filled)
    return fill_medians(filled, medians), medians


def scoring_features(
    raw_sales: DataFrame,
    raw_accounts: DataFrame,
    study: Study,
    medians: dict[str, float] | None = None,
    dedup: str = "before",
) -> tuple[DataFrame, dt.date]:
    """The features of today's active clients, up to the newest sale, and that date.

    Without `medians` they are refitted on this cohort.
    """
    cut = last_day(clean_sales(raw_sales))
    sales = clean_sales(raw_sales, since=study.scoring_start)
    raw = raw_features(
        sales, clean_accounts(raw_accounts), study, study.scoring_start, cut, labelled=False, dedup=dedup
    )
    filled = fill_rules(raw, study)
    if medians is None:
        filled = materialise(filled, "scoring-features")
        medians = fit_medians(filled)
    return fill_medians(filled, medians), cut


def deterministic_score(features: DataFrame) -> DataFrame:
    """A score without training, for checks of everything that follows a score."""
    logit = 0.8 - F.col("activity_change") + F.col("mean_gap") / 400
    return features.withColumn("score", F.round(1 / (1 + F.exp(-logit)), 4))
