"""The whole analysis of a log from one pass over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldtally import fixed
from fieldtally.functions.economics import with_net_profit
from fieldtally.operators.summaries import SUMMARY_MEASURES, profit_over_seasons, fixation_of, season_summary
from fieldtally.session import durable


@dataclass(frozen=True)
class Analysis:
    """Season means, fixation and profit of every condition."""

    seasons: DataFrame
    fixation: DataFrame
    profit: DataFrame


def analyze(
    df: DataFrame,
    id_cols: Sequence[str],
    threshold: float = fixed.FIXATION_RF,
    price: float = fixed.GRAIN_PRICE,
) -> Analysis:
    """Season summary, fixation and profit together.

    All three need only the means per condition and season.  That small table is
    written once, so the log is read a single time.
    """
    means = season_summary(with_net_profit(df, price), id_cols, (*SUMMARY_MEASURES, "net_profit"))
    seasons = durable(means)
    return Analysis(
        seasons=seasons.drop("net_profit").orderBy(*id_cols, "season"),
        fixation=fixation_of(seasons, id_cols, threshold),
        profit=profit_over_seasons(seasons, id_cols),
    )
