"""Aggregates over plot-season logs.

All of them reduce on the map side first, so a condition or run that holds a
large share of the rows reaches the shuffle as one partial row per task.
Rows without a group key are left out and missing measures are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.economics import net_profit
from fieldtally.functions.keys import measure, nan_to_null, with_values

SUMMARY_MEASURES = ("grain_tha", "pest_loss_tha", "resistant_fraction", "spray_count", "cost_per_spray")


def _group(df: DataFrame, keys: Sequence[str]):
    return with_values(df, *keys).groupBy(*keys)


def summarize(df: DataFrame, keys: Sequence[str], **aggregates: tuple[str, str] | Column) -> DataFrame:
    """Named aggregates, each a ``(column, function)`` pair or a Spark column."""
    functions: Mapping[str, Callable] = {
        "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
        "std": F.stddev_samp, "std_pop": F.stddev_pop, "nunique": F.countDistinct,
    }

    def build(spec) -> Column:
        if isinstance(spec, Column):
            return spec
        column, function = spec
        # NaN is missing to every aggregate; of other columns it does not exist.
        known = measure(column) if dict(df.dtypes).get(column) in ("double", "float") else F.col(column)
        if function in ("mean", "std", "std_pop"):
            return functions[function](measure(column))
        if function == "sum":
            return F.coalesce(F.sum(known), F.lit(0))
        return functions[function](known)

    return _group(df, keys).agg(*[build(spec).alias(name) for name, spec in aggregates.items()])


def season_summary(df: DataFrame, id_cols: Sequence[str], measures: Sequence[str] = SUMMARY_MEASURES) -> DataFrame:
    """Mean of every measure the log has, per condition and season."""
    keys = [*id_cols, "season"]
    present = [c for c in measures if c in df.columns]
    return _group(df, keys).agg(*[F.avg(measure(c)).alias(c) for c in present])


def mean_sd(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Mean and sample standard deviation; ``columns`` maps a column to the
    prefix of its two results."""
    built = []
    for column, prefix in columns.items():
        built.append(F.avg(measure(column)).alias(f"{prefix}_mean"))
        built.append(F.stddev_samp(measure(column)).alias(f"{prefix}_sd"))
    return _group(df, keys).agg(*built)


def fixation_of(seasons: DataFrame, id_cols: Sequence[str], threshold: float = fixed.FIXATION_RF) -> DataFrame:
    """Fixation from a season summary: the first season whose mean resistance
    reaches ``threshold`` (null if none does), the last season, and its mean."""
    rf = F.col("resistant_fraction")
    return seasons.groupBy(*id_cols).agg(
        F.min(F.when(rf >= threshold, F.col("season"))).alias("fixation_season"),
        F.max("season").alias("max_season"),
        F.max_by(rf, "season").alias("final_mean_rf"),
    )


def fixation(df: DataFrame, id_cols: Sequence[str], threshold: float = fixed.FIXATION_RF) -> DataFrame:
    return fixation_of(season_summary(df, id_cols, ("resistant_fraction",)), id_cols, threshold)


def peak_rf(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Highest season mean of resistance."""
    seasons = season_summary(df, id_cols, ("resistant_fraction",))
    return seasons.groupBy(*id_cols).agg(F.max("resistant_fraction").alias("peak_rf"))


def profit_over_seasons(seasons: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    profit = F.col("net_profit")
    return seasons.groupBy(*id_cols).agg(
        F.count("season").alias("n_seasons"),
        F.coalesce(F.sum(profit), F.lit(0.0)).alias("cumulative_profit"),
        F.stddev_pop(profit).alias("profit_sd"),
        F.avg(profit).alias("mean_profit"),
    )


def season_profit(df: DataFrame, id_cols: Sequence[str], price: float = fixed.GRAIN_PRICE) -> DataFrame:
    """Mean net profit over all rows of a condition and season."""
    profit = df.withColumn("net_profit", net_profit(price))
    return season_summary(profit, id_cols, ("net_profit",))


def profit_summary(df: DataFrame, id_cols: Sequence[str], price: float = fixed.GRAIN_PRICE) -> DataFrame:
    """Cumulative, mean and population sd of the season means of profit."""
    return profit_over_seasons(season_profit(df, id_cols, price), id_cols)


def run_season_means(df: DataFrame, id_cols: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean over the plots of a run, per season."""
    keys = [*dict.fromkeys([*id_cols, "run_id", "season"])]
    return _group(df, keys).agg(*[F.avg(measure(c)).alias(c) for c in columns])


def balanced_season_means(df: DataFrame, id_cols: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Season means in which every run counts once, whatever its rows."""
    runs = run_season_means(df, id_cols, columns)
    return runs.groupBy(*id_cols, "season").agg(*[F.avg(c).alias(c) for c in columns])


def balanced_season_profit(df: DataFrame, id_cols: Sequence[str], price: float = fixed.GRAIN_PRICE) -> DataFrame:
    return balanced_season_means(df.withColumn("net_profit", net_profit(price)), id_cols, ("net_profit",))


def balanced_profit(df: DataFrame, id_cols: Sequence[str], price: float = fixed.GRAIN_PRICE) -> DataFrame:
    """As :func:`profit_summary`, over run-balanced season means."""
    return profit_over_seasons(balanced_season_profit(df, id_cols, price), id_cols)


def run_total(df: DataFrame, keys: Sequence[str], price: float = fixed.GRAIN_PRICE) -> DataFrame:
    """Net profit of a run over all its plots and seasons; rows without a profit are
    skipped."""
    return _group(nan_to_null(df), ["run_id", *keys]).agg(F.coalesce(F.sum(net_profit(price)), F.lit(0.0)).alias("profit"))


def run_means(df: DataFrame, keys: Sequence[str], season: int, column: str = "grain_tha") -> DataFrame:
    """Mean over the plots of a run at one season."""
    rows = df.filter(F.col("season") == season)
    return _group(rows, ["run_id", *keys]).agg(F.avg(measure(column)).alias(column))


def early_mean(df: DataFrame, keys: Sequence[str], last: int = 6, column: str = "grain_tha") -> DataFrame:
    """Mean of the run means over the first seasons."""
    rows = df.filter(F.col("season") <= last)
    runs = _group(rows, [*keys, "run_id"]).agg(F.avg(measure(column)).alias(column))
    return runs.groupBy(*keys).agg(F.avg(column).alias(f"early_{column}"))


def terminal_mean(
    df: DataFrame, keys: Sequence[str], column: str = "grain_tha", season: int | None = None
) -> DataFrame:
    """Mean at one season, or at the last season each condition has."""
    if season is not None:
        return _group(df.filter(F.col("season") == season), keys).agg(
            F.max("season").alias("season"), F.avg(measure(column)).alias(f"terminal_{column}")
        )
    seasons = season_summary(df, keys, (column,))
    return seasons.groupBy(*keys).agg(
        F.max("season").alias("season"), F.max_by(column, "season").alias(f"terminal_{column}")
    )


def condition_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean over all rows of a condition, seasons pooled."""
    return _group(df, keys).agg(*[F.avg(measure(c)).alias(f"{c}_mean") for c in columns])


def mean_of_season_sds(df: DataFrame, keys: Sequence[str], column: str = "spray_count") -> DataFrame:
    """Sample sd within each season, averaged over seasons."""
    seasons = _group(df, [*keys, "season"]).agg(
        F.stddev_samp(measure(column)).alias("sd"), F.sum(measure(column)).alias("s"), F.count(measure(column)).alias("n")
    )
    return seasons.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias(f"{column}_mean"), F.avg("sd").alias(f"{column}_mean_sd")
    )


def run_inventory(df: DataFrame, keys: Sequence[str] = ("strategy", "pesticide_choice")) -> DataFrame:
    """Last season and number of rows of every run."""
    return _group(df, ["run_id", *keys]).agg(
        F.max("season").alias("last_season"), F.count("season").alias("n_rows")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, missing ones left out."""
    return with_values(df.select(column), column).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values of each column, missing ones left out.

    The combinations are reduced first, so the counting works on them alone.
    """
    return df.select(*columns).distinct().agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def distinct_conditions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_values(df.select(*keys), *keys).distinct()


def sweep_fixation(df: DataFrame, first: str, second: str, threshold: float = fixed.FIXATION_RF) -> DataFrame:
    """Fixation and peak resistance for every pair of two swept columns."""
    seasons = season_summary(df, [first, second], ("resistant_fraction",))
    rf = F.col("resistant_fraction")
    return seasons.groupBy(first, second).agg(
        F.min(F.when(rf >= threshold, F.col("season"))).alias("fixation_season"),
        F.max(rf).alias("peak_rf"),
    )


def sweep_matrix(
    df: DataFrame, rows: str, columns: str, values: Sequence, threshold: float = fixed.FIXATION_RF
) -> DataFrame:
    """The fixation seasons of two swept columns as a matrix; ``values`` names
    the columns to show, which spares a pass to discover them."""
    pairs = sweep_fixation(df, rows, columns, threshold)
    return pairs.groupBy(rows).agg(
        *[
            F.max(F.when(F.col(columns) == F.lit(v), F.col("fixation_season"))).alias(f"{columns}_{v}")
            for v in values
        ]
    )


def fixation_free_frontier(
    df: DataFrame, swept: str, by: str, threshold: float = fixed.FIXATION_RF
) -> DataFrame:
    """Smallest value of ``swept`` that never fixates, per value of ``by``; null
    where every value fixates."""
    pairs = sweep_fixation(df, swept, by, threshold)
    return pairs.groupBy(by).agg(
        F.min(F.when(F.col("fixation_season").isNull(), F.col(swept))).alias(f"min_{swept}")
    )


def plot_choice_summary(df: DataFrame, keys: Sequence[str] = ("plot_strategy", "plot_pesticide")) -> DataFrame:
    """Season means by what each plot itself does, in landscapes of mixed plots."""
    return season_summary(df, keys)


def daily_monitors(df: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    """State of the whole field per day."""
    present = []
    if "resistant_fraction" in df.columns:
        present.append(F.avg(measure("resistant_fraction")).alias("mean_rf"))
    return _group(df, keys).agg(
        F.avg(measure("pest_load")).alias("mean_load"),
        F.max(measure("pest_load")).alias("max_load"),
        *present,
        F.coalesce(F.sum("sprayed"), F.lit(0)).cast("bigint").alias("total_sprays"),
        F.coalesce(F.max("sprayed"), F.lit(0)).cast("int").alias("any_spray"),
    )


def conservation(
    df: DataFrame,
    keys: Sequence[str],
    expected: float = fixed.PEST_FREE_THA,
    tolerance: float = 1e-6,
    harvest_index: float = fixed.HARVEST_INDEX,
) -> DataFrame:
    """Whether grain and loss add up to the pest-free yield in every row."""
    total = measure("grain_tha") + measure("pest_loss_tha")
    off = F.abs(total - F.lit(expected)) > F.lit(tolerance)
    return _group(df, keys).agg(
        F.min(total).alias("min_total"),
        F.max(total).alias("max_total"),
        (F.max(total) / F.lit(harvest_index)).alias("max_biomass_tha"),
        F.count(F.when(off, 1)).alias("n_violations"),
    )


def conservation_violations(
    df: DataFrame, expected: float = fixed.PEST_FREE_THA, tolerance: float = 1e-6
) -> DataFrame:
    total = measure("grain_tha") + measure("pest_loss_tha")
    return df.withColumn("total_tha", total).filter(F.abs(F.col("total_tha") - F.lit(expected)) > F.lit(tolerance))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def rf_plateau(df: DataFrame, id_cols: Sequence[str], last: int = 3, slope: float = 0.005) -> DataFrame:
    """Mean change of resistance over the last seasons, and whether it still climbs.

    The mean of successive changes telescopes, so only the ends of the horizon
    count.  A condition has one row per season here, which bounds its list.
    """
    seasons = season_summary(df, id_cols, ("resistant_fraction",))
    ends = seasons.groupBy(*id_cols).agg(
        F.max("season").alias("last_season"),
        F.max_by("resistant_fraction", "season").alias("final_rf"),
        F.slice(
            F.sort_array(F.collect_list(F.struct("season", "resistant_fraction")), asc=False), 1, last + 1
        ).alias("tail"),
    )
    steps = F.size("tail") - F.lit(1)
    earliest = F.element_at("tail", -1)["resistant_fraction"]
    mean_change = F.when(steps > 0, (F.col("final_rf") - earliest) / steps)
    return ends.select(
        *id_cols,
        "last_season",
        "final_rf",
        mean_change.alias("mean_change"),
        (mean_change > F.lit(slope)).alias("still_climbing"),
    )
