"""Joins of logs with dimensions, reported tables and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.growth import growth_stage
from fieldtally.functions.keys import as_column
from fieldtally.operators.summaries import balanced_season_profit, run_means, season_summary
from fieldtally.session import broadcast_if_small


def with_compound(df: DataFrame, dimension: DataFrame, compound: str = "pesticide_choice") -> DataFrame:
    """Add efficacy, selection pressure and cost of the compound in use.

    The default compound, and any the dimension does not know, keep the defaults.
    """
    side = broadcast_if_small(
        dimension.select(F.col("compound").alias(compound), "efficacy", "selection_pressure", "cost")
    )
    joined = df.join(side, compound, "left")
    return joined.select(
        *df.columns,
        F.coalesce("efficacy", F.lit(fixed.DEFAULT_EFFICACY)).alias("efficacy"),
        F.coalesce("selection_pressure", F.lit(fixed.DEFAULT_PRESSURE)).alias("selection_pressure"),
        F.coalesce("cost", F.lit(fixed.DEFAULT_COST)).alias("cost"),
    )


def with_stage(df: DataFrame, heat="heat", rows=fixed.STAGE_ROWS) -> DataFrame:
    """Look up the crop stage whose range of heat units holds a row's total.

    ``rows`` are the few stages with their bounds, light share and damage weight.
    The stage number follows from the bounds, so the lookup is an equality join
    with those rows and not a comparison of every pair.
    """
    stages = df.sparkSession.createDataFrame(
        [(n, share, weight) for n, _, _, share, weight in rows], "stage int, fapar double, weight double"
    )
    return df.withColumn("stage", growth_stage(as_column(heat), rows)).join(
        broadcast_if_small(stages), "stage", "left"
    )


def reconcile(computed: DataFrame, reported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reported rows beside computed ones, matched keys only."""
    return computed.join(broadcast_if_small(reported), list(keys))


def unmatched(computed: DataFrame, reported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, each with its side."""
    left = computed.select(*keys).distinct().withColumn("_c", F.lit(True))
    right = reported.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = left.join(right, list(keys), "full")
    return both.filter(F.col("_c").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_c").isNull(), "reported only").otherwise("computed only").alias("side")
    )


def profit_lead(df: DataFrame, ahead: str = "threshold", behind: str = "calendar") -> DataFrame:
    """By how much one strategy's profit leads another's, per season."""
    seasons = balanced_season_profit(df.filter(F.col("strategy").isin(ahead, behind)), ["strategy"])

    def of(name: str):
        return F.max(F.when(F.col("strategy") == F.lit(name), F.col("net_profit")))

    return (
        seasons.groupBy("season")
        .agg(of(ahead).alias("ahead"), of(behind).alias("behind"))
        .withColumn("lead", F.col("ahead") - F.col("behind"))
    )


def labelled_run_means(logs: dict[str, DataFrame], season: int | None = None, column: str = "grain_tha") -> DataFrame:
    """Run means of several logs at one season, one row per log and run; by default at
    the last season that any of them has."""
    result = None
    for label, log in logs.items():
        if season is None:
            part = season_summary(log, ["run_id"], (column,))
        else:
            part = run_means(log, [], season, column)
        part = part.withColumn("log", F.lit(label))
        result = part if result is None else result.unionByName(part)
    if season is None:
        last = result.agg(F.max("season").alias("last"))
        result = result.join(F.broadcast(last), F.col("season") == F.col("last")).drop("season", "last")
    return result
