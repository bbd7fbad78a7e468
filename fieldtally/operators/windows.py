"""Running and ordered columns.

A window partition is one plot (at most one row per day) or one run or
condition (at most one row per season), never raw rows: inputs that may repeat
a day or season are aggregated to it first.  That bounds every partition by the
calendar and not by the size of the log.

The daily operators check that inside the same window pass: a plot with two rows of
one day makes the query fail, since no running value over them would be right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions import growth
from fieldtally.functions.economics import net_profit, revenue, spray_bill
from fieldtally.functions.keys import measure, nan_to_null, with_values
from fieldtally.operators.summaries import season_summary


def _ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _so_far(keys: Sequence[str], order: str) -> WindowSpec:
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(keys: Sequence[str], order: str) -> WindowSpec:
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def _once_a_day(keys: Sequence[str], day: str, value: Column) -> Column:
    """``value``, or failure where the row before is of the same day."""
    order = _ordered(keys, day)
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    twice = F.raise_error(F.concat(F.lit("("), named, F.lit(") has several rows on day "), F.col(day).cast("string")))
    return F.when(F.lag(day).over(order) == F.col(day), twice).otherwise(value)


def cumulative_exposure(
    df: DataFrame, keys: Sequence[str] = ("plot_id",), day: str = "day", load: str = "pest_load"
) -> DataFrame:
    """Running sum of daily load."""
    total = F.sum(measure(load)).over(_so_far(keys, day))
    return df.withColumn("cumulative_exposure", _once_a_day(keys, day, total))


def days_above(
    df: DataFrame,
    keys: Sequence[str] = ("plot_id",),
    day: str = "day",
    load: str = "pest_load",
    threshold: float = fixed.SPRAY_THRESHOLD,
) -> DataFrame:
    """Running number of days with a load beyond the threshold."""
    hit = F.when(measure(load) > threshold, 1).otherwise(0)
    return df.withColumn("days_above_threshold", _once_a_day(keys, day, F.sum(hit).over(_so_far(keys, day))))


def days_since_spray(df: DataFrame, keys: Sequence[str] = ("plot_id",), day: str = "day") -> DataFrame:
    """Days since the last spray as the spray decision of the day sees it; before
    the first spray, days since sowing."""
    last = F.last(F.when(F.col("sprayed") == 1, F.col(day)), ignorenulls=True).over(_before(keys, day))
    return df.withColumn("days_since_spray", _once_a_day(keys, day, F.col(day) - F.coalesce(last, F.lit(0))))


def spray_numbers(
    df: DataFrame, plot: Sequence[str] = ("plot_id",), season: str = "season", day: str = "day"
) -> DataFrame:
    """Sprays so far, over the life of the plot and within the season."""
    lifetime = F.sum("sprayed").over(_so_far(plot, day))
    return df.withColumn("lifetime_sprays", _once_a_day(plot, day, lifetime)).withColumn(
        "season_sprays", F.sum("sprayed").over(_so_far([*plot, season], day))
    )


def heat_accumulation(
    df: DataFrame, keys: Sequence[str] = ("plot_id",), day: str = "day", maturity: float = fixed.MATURITY_HEAT
) -> DataFrame:
    """Accumulated heat units, and the first day on which they reach maturity."""
    total = df.withColumn("heat", _once_a_day(keys, day, F.sum(growth.heat_units()).over(_so_far(keys, day))))
    ripe = F.min(F.when(F.col("heat") >= maturity, F.col(day))).over(Window.partitionBy(*keys))
    return total.withColumn("maturity_day", ripe)


def growth_accumulation(df: DataFrame, keys: Sequence[str] = ("plot_id",), day: str = "day") -> DataFrame:
    """Dry matter grown and lost so far, from weather and pest load."""
    heated = df.withColumn("heat", _once_a_day(keys, day, F.sum(growth.heat_units()).over(_so_far(keys, day))))
    factor = growth.growth_factor("pest_load", growth.damage_weight("heat"))
    potential = growth.potential_growth("solar_rad", growth.light_share("heat"))
    daily = heated.withColumn("growth_potential", potential).withColumn(
        "growth_actual", F.col("growth_potential") * factor
    )
    lost = F.col("growth_potential") - F.col("growth_actual")
    return daily.withColumn("biomass", F.sum("growth_actual").over(_so_far(keys, day))).withColumn(
        "biomass_loss", F.sum(lost).over(_so_far(keys, day))
    )


def run_seasons(df: DataFrame, keys: Sequence[str] = (), price: float = fixed.GRAIN_PRICE) -> DataFrame:
    """Money and mean resistance of a run's season, over all its plots."""
    return with_values(nan_to_null(df), "run_id", *keys, "season").groupBy("run_id", *keys, "season").agg(
        F.coalesce(F.sum(revenue(price=price)), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum(spray_bill()), F.lit(0.0)).alias("spray_cost"),
        F.coalesce(F.sum(net_profit(price)), F.lit(0.0)).alias("profit"),
        F.avg("resistant_fraction").alias("mean_rf"),
    )


def profit_change(
    seasons: DataFrame, run: Sequence[str] = ("run_id",), start_money: float = fixed.START_MONEY
) -> DataFrame:
    """Profit of a run's season against the season before.

    A farmer compares money in hand, so the first season also counts the money
    they started with, and is itself compared with nothing.
    """
    order = _ordered(run, "season")
    felt = F.col("profit") + F.when(F.row_number().over(order) == 1, F.lit(start_money)).otherwise(F.lit(0.0))
    with_felt = seasons.withColumn("felt_profit", felt)
    earlier = F.coalesce(F.lag("felt_profit").over(order), F.lit(0.0))
    return (
        with_felt.withColumn("previous_profit", earlier)
        .withColumn("profit_change", F.col("felt_profit") - F.col("previous_profit"))
        .withColumn("declined", F.col("felt_profit") < F.col("previous_profit"))
    )


def wallet(
    seasons: DataFrame, run: Sequence[str] = ("run_id",), start_money: float = fixed.START_MONEY
) -> DataFrame:
    """Money in hand after each season."""
    order = _so_far(run, "season")
    balance = F.lit(start_money) + F.sum("revenue").over(order) - F.sum("spray_cost").over(order)
    return seasons.withColumn("end_money", balance)


def rank_by_profit(conditions: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Place of each condition by cumulative profit, highest first; ties go by key.

    Takes one row per condition, as :func:`balanced_profit` gives.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("cumulative_profit"), *keys)
    return conditions.withColumn("place", F.row_number().over(order))


def best_and_worst(conditions: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The condition with the highest and with the lowest profit, by plain
    aggregates; among equals the lowest key is the best and the worst."""
    profit = F.col("cumulative_profit")
    entry = F.struct(profit, *[F.col(k) for k in keys])
    best = F.min_by(entry, F.struct((-profit).alias("o"), *[F.col(k) for k in keys]))
    worst = F.min(entry)
    found = conditions.groupBy(*by).agg(best.alias("best"), worst.alias("worst"))
    picked = [
        F.col(f"{end}.{name}").alias(f"{end}_{name}")
        for end in ("best", "worst")
        for name in (*keys, "cumulative_profit")
    ]
    return found.select(*by, *picked)


def trajectory(df: DataFrame, id_cols: Sequence[str], measures: Sequence[str] = ("resistant_fraction",)) -> DataFrame:
    """Season means of each condition in order of season."""
    return season_summary(df, id_cols, measures).orderBy(*id_cols, "season")


def rf_growth(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Change of mean resistance from season to season."""
    seasons = season_summary(df, id_cols, ("resistant_fraction",))
    before = F.lag("resistant_fraction").over(_ordered(id_cols, "season"))
    return seasons.withColumn("rf_change", F.col("resistant_fraction") - before)
