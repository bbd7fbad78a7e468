"""Log views derived from the given tables.

The tables are of another kind (orders, events), so the tests read them *as*
logs: every line item becomes a plot season, every user's day a plot day.
Measures are multiples of 1/1024, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.operators.replay import season_ledger


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def harvest_of(lineitem: DataFrame) -> DataFrame:
    read_as = lineitem.selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'calendar' ELSE 'threshold' END AS strategy",
        "l_suppkey % 40 AS run_no",
        "l_suppkey % 3 AS third",
        "l_suppkey % 4 AS fourth",
        "year(l_shipdate) - 1994 AS season",
        "l_partkey % 100 AS plot",
        "l_linenumber AS sprays",
        "l_extendedprice / 20000 AS grain",
        "l_tax * 20 AS loss",
        # Resistance grows by season; the calendar strategy starts lower.
        "CASE l_returnflag WHEN 'A' THEN 0D WHEN 'N' THEN 0.18D + l_discount / 10 ELSE 0.34D + l_discount / 10 END AS pace",
    )
    return read_as.selectExpr(
        "concat_ws('_', strategy, run_no) AS run_id",
        "strategy",
        "CASE third WHEN 0 THEN 'starfarm' WHEN 1 THEN 'etofenprox' ELSE 'neonicotinoid' END AS pesticide_choice",
        "CASE fourth WHEN 0 THEN 0.05D WHEN 1 THEN 0.2D WHEN 2 THEN 0.4D ELSE 0.7D END AS immigration_rate",
        "CAST(season AS INT) AS season",
        "CAST(plot % 10 AS INT) AS plot_x",
        "CAST(plot DIV 10 AS INT) AS plot_y",
        "floor(grain * 1024) / 1024D AS grain_tha",
        "floor(loss * 1024) / 1024D AS pest_loss_tha",
        "CAST(CASE strategy WHEN 'none' THEN 0 ELSE sprays END AS INT) AS spray_count",
        "floor(least(1D, season * pace * CASE third WHEN 1 THEN 0.5D ELSE 1D END) * 1024) / 1024D AS resistant_fraction",
        "CASE third WHEN 1 THEN 110.625D ELSE 100D END AS cost_per_spray",
    )


def harvest(spark: SparkSession, folder: str) -> DataFrame:
    """Plot-season log, one row per line item."""
    return harvest_of(table(spark, folder, "lineitem"))


def daily_of(events: DataFrame) -> DataFrame:
    load = F.expr("least(1024, floor(max(value) / 200 * 1024)) / 1024D")
    return events.groupBy(
        F.col("user_id").alias("plot_id"), F.dayofyear("ts").cast("int").alias("day")
    ).agg(load.alias("pest_load"), F.expr("max(CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END)").alias("sprayed"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Plot-day log: one row per plot and day, so at most 366 rows per plot."""
    return daily_of(table(spark, folder, "events"))


def plotday(spark: SparkSession, folder: str) -> DataFrame:
    """Plot-day log with weather."""
    return daily(spark, folder).selectExpr(
        "plot_id",
        "day",
        "pest_load",
        "sprayed",
        "CAST(40 + plot_id % 25 + day % 5 AS DOUBLE) AS t_mean",
        "18D AS solar_rad",
        "CAST(70 + (plot_id * 7 + day) % 25 AS DOUBLE) AS humidity",
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run, plot and season."""
    return season_ledger(harvest(spark, folder))


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Grid state of every run in season 3."""
    load = F.expr("least(1024, floor(max(pest_loss_tha) / 2 * 1024)) / 1024D")
    return (
        harvest(spark, folder)
        .filter(F.col("season") == 3)
        .groupBy("run_id", "plot_x", "plot_y")
        .agg(load.alias("pest_load"))
    )


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """Grid state of every run in every season."""
    load = F.expr("least(1024, floor(max(pest_loss_tha) / 2 * 1024)) / 1024D")
    return harvest(spark, folder).groupBy("run_id", "season", "plot_x", "plot_y").agg(load.alias("pest_load"))


def compounds(spark: SparkSession) -> DataFrame:
    """Compound dimension: two rows."""
    return spark.createDataFrame(
        fixed.COMPOUND_ROWS, "compound string, efficacy double, selection_pressure double, cost double"
    )
