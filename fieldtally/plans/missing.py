"""Operators on logs with missing values, and on swap logs, whose logged strategy
changes within a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import growth, schedule
from fieldtally.operators import summaries, windows
from fieldtally.operators.spatial import plot_position
from fieldtally.plans.base import plan, r6, sql
from fieldtally.sources import views
from fieldtally.sources.contracts import contract, present_keys, with_derived

_NAN = float("nan")


def _gaps(spark, folder):
    """The harvest log without the grain of some plots (as NaN) and without some keys."""
    log = views.harvest(spark, folder)
    grain = F.when((F.col("plot_x") == 3) & (F.col("season") > 2), F.lit(_NAN)).otherwise(F.col("grain_tha"))
    return log.withColumn("grain_tha", grain).withColumn("season", F.when(F.col("plot_y") != 7, F.col("season")))


_GAPS = """
SELECT run_id, strategy, immigration_rate, pesticide_choice, plot_x, plot_y,
       CASE WHEN plot_x = 3 AND season > 2 THEN NULL ELSE grain_tha END AS grain_tha,
       CASE WHEN plot_y <> 7 THEN season END AS season, spray_count, cost_per_spray, resistant_fraction
FROM harvest"""


@plan("nan_a6_run_total", sql("""
SELECT run_id, strategy, coalesce(sum(grain_tha * 3000 - spray_count * cost_per_spray), 0) AS profit
FROM gaps GROUP BY run_id, strategy""", "harvest", gaps=_GAPS))
def _run_total(spark, folder):
    return summaries.run_total(_gaps(spark, folder), ["strategy"])


@plan("nan_w7_profit_change", sql("""
SELECT run_id, season, profit, felt_profit, felt_profit - coalesce(lag(felt_profit) OVER w, 0) AS profit_change
FROM (SELECT *, profit + CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY season) = 1 THEN 5000 ELSE 0 END
             AS felt_profit
      FROM (SELECT run_id, season, coalesce(sum(grain_tha * 3000 - spray_count * cost_per_spray), 0) AS profit
            FROM gaps WHERE season IS NOT NULL GROUP BY run_id, season) s) t
WINDOW w AS (PARTITION BY run_id ORDER BY season)""", "harvest", gaps=_GAPS))
def _profit_change(spark, folder):
    found = windows.profit_change(windows.run_seasons(_gaps(spark, folder), ["strategy"]))
    return found.select("run_id", "season", "profit", "felt_profit", "profit_change")


def _daily_gaps(spark, folder):
    load = F.when((F.col("plot_id") + F.col("day")) % 5 == 0, F.lit(_NAN)).otherwise(F.col("pest_load"))
    return views.daily(spark, folder).withColumn("pest_load", load)


_DAILY_GAPS = """
SELECT plot_id, day, sprayed, CASE WHEN (plot_id + day) % 5 = 0 THEN NULL ELSE pest_load END AS pest_load FROM daily"""


@plan("nan_w2_days_above_threshold", sql("""
SELECT plot_id, day, CAST(sum(CASE WHEN pest_load > 0.3 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS days_above_threshold,
       sum(pest_load) OVER w AS cumulative_exposure
FROM gaps WINDOW w AS (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)""", "daily", gaps=_DAILY_GAPS))
def _days_above(spark, folder):
    found = windows.cumulative_exposure(windows.days_above(_daily_gaps(spark, folder)))
    return found.select("plot_id", "day", "days_above_threshold", "cumulative_exposure")


@plan("nan_c05_load_band", sql("""
SELECT plot_id, day, CASE WHEN pest_load < 0.1 THEN 'healthy' WHEN pest_load <= 0.4 THEN 'light'
       WHEN pest_load <= 0.7 THEN 'moderate' WHEN pest_load > 0.7 THEN 'overwhelmed' END AS band,
       CASE plot_id % 3 WHEN 0 THEN pest_load > 0.3 WHEN 1 THEN true END AS should_spray
FROM gaps""", "daily", gaps=_DAILY_GAPS))
def _load_band(spark, folder):
    strategy = F.when(F.col("plot_id") % 3 == 0, "threshold").when(F.col("plot_id") % 3 == 1, "calendar")
    return _daily_gaps(spark, folder).select(
        "plot_id", "day", growth.load_band("pest_load").alias("band"),
        schedule.should_spray(strategy, F.lit(99), "pest_load").alias("should_spray"),
    )


@plan("nan_c06_growth_stage", sql("""
SELECT plot_id, day, CASE WHEN heat < 70 THEN 1 WHEN heat < 920 THEN 2 WHEN heat < 1350 THEN 3 WHEN heat >= 1350 THEN 4 END
       AS stage,
       CASE WHEN heat < 70 THEN CAST(0.2 AS DOUBLE) WHEN heat < 920 THEN 0.7 WHEN heat < 1350 THEN 0.9
            WHEN heat >= 1350 THEN 0.85 END AS fapar
FROM (SELECT plot_id, day, CASE WHEN day % 4 > 0 THEN heat END AS heat FROM heated) t""", "heated"))
def _growth_stage(spark, folder):
    days = windows.heat_accumulation(views.plotday(spark, folder))
    days = days.withColumn("heat", F.when(F.col("day") % 4 > 0, F.col("heat")).when(F.col("day") % 8 > 0, F.lit(_NAN)))
    return days.select(
        "plot_id", "day", growth.growth_stage("heat").alias("stage"), growth.light_share("heat").alias("fapar")
    )


@plan("null_c04_plot_position", sql("""
SELECT run_id, plot_x, season, CASE WHEN season IS NULL THEN NULL WHEN plot_x IN (0, 9) AND season IN (0, 9) THEN 'corner'
            WHEN plot_x IN (0, 9) OR season IN (0, 9) THEN 'edge' ELSE 'interior' END AS place,
       CASE substr('AB', (season - 1) % 2 + 1, 1) WHEN 'A' THEN 'etofenprox' WHEN 'B' THEN 'neonicotinoid' END AS scheduled
FROM gaps""", "harvest", gaps=_GAPS))
def _plot_position(spark, folder):
    return _gaps(spark, folder).select(
        "run_id", "plot_x", "season", plot_position("plot_x", "season").alias("place"),
        schedule.scheduled_compound(F.lit("AB"), "season").alias("scheduled"),
    )


@plan("io2_swap_conditions", sql("""
SELECT strategy AS initial_strategy, season, round(avg(grain_tha), 6) AS grain_tha, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY strategy, season""", "harvest"))
def _swap_conditions(spark, folder):
    log = contract("sensitivity_output_strategyswap_grid_profit")
    logged = F.when(F.col("season") % 2 == 0, "threshold").otherwise(F.col("strategy"))
    rows = with_derived(views.harvest(spark, folder).withColumn("strategy", logged), log)
    keys = present_keys(rows, log)
    found = summaries.summarize(rows, [*keys, "season"], grain_tha=("grain_tha", "mean"), n_rows=("grain_tha", "count"))
    return found.select(*keys, "season", r6("grain_tha"), "n_rows")
