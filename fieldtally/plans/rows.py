"""Row-wise columns and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import economics, growth, keys, resistance, schedule
from fieldtally.operators.joins import with_compound
from fieldtally.operators.spatial import plot_position
from fieldtally.operators.summaries import summarize
from fieldtally.operators.windows import days_since_spray, growth_accumulation, heat_accumulation, spray_numbers
from fieldtally.plans.base import plan, r6, shifted6, sql
from fieldtally.sources import views

_PLOT = ("run_id", "season", "plot_x", "plot_y")

_STAGE_CASES = """
       CAST(CASE WHEN heat < 70 THEN 1 WHEN heat < 920 THEN 2 WHEN heat < 1350 THEN 3 ELSE 4 END AS INT) AS stage,
       CAST(CASE WHEN heat < 70 THEN 0.2 WHEN heat < 920 THEN 0.7 WHEN heat < 1350 THEN 0.9 ELSE 0.85 END AS DOUBLE)
           AS fapar,
       CAST(CASE WHEN heat < 70 THEN 0.7 WHEN heat < 920 THEN 0.6 WHEN heat < 1350 THEN 0.5 ELSE 0.3 END AS DOUBLE)
           AS weight"""
STAGED = f"SELECT *, {_STAGE_CASES} FROM heated"
GROWN = """
SELECT *, greatest(CAST(0.5 AS DOUBLE), 1 - weight * pest_load) AS k_pest,
       CAST(0.768 AS DOUBLE) * solar_rad * fapar AS potential
FROM staged"""


@plan("c01_net_profit", sql("""
SELECT run_id, season, plot_x, plot_y, grain_tha * 3000 - spray_count * cost_per_spray AS net_profit
FROM harvest""", "harvest"))
def _net_profit(spark, folder):
    return economics.with_net_profit(views.harvest(spark, folder)).select(*_PLOT, "net_profit")


@plan("c02_biomass_to_tha", sql("""
SELECT plot_id, day, round(sum(potential * k_pest) OVER w * 0.52 * 0.01 + 3.7e-10, 6) AS grain_tha,
       round(sum(potential - potential * k_pest) OVER w * 0.52 * 0.01 + 3.7e-10, 6) AS loss_tha
FROM grown WINDOW w AS (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "heated", staged=STAGED, grown=GROWN))
def _biomass_to_tha(spark, folder):
    grown = growth_accumulation(views.plotday(spark, folder))
    return grown.select(
        "plot_id",
        "day",
        shifted6(economics.to_tha("biomass"), "grain_tha"),
        shifted6(economics.to_tha("biomass_loss"), "loss_tha"),
    )


@plan("c03_revenue", sql("SELECT run_id, season, plot_x, plot_y, grain_tha * 3000 AS revenue FROM harvest", "harvest"))
def _revenue(spark, folder):
    return views.harvest(spark, folder).select(*_PLOT, economics.revenue().alias("revenue"))


@plan("c04_plot_position", sql("""
SELECT run_id, season, plot_x, plot_y,
       CASE WHEN plot_x IN (0, 9) AND plot_y IN (0, 9) THEN 'corner'
            WHEN plot_x IN (0, 9) OR plot_y IN (0, 9) THEN 'edge' ELSE 'interior' END AS plot_position
FROM harvest""", "harvest"))
def _plot_position(spark, folder):
    return views.harvest(spark, folder).select(*_PLOT, plot_position().alias("plot_position"))


@plan("c05_load_band", sql("""
SELECT plot_id, day, CASE WHEN day > 25 THEN 'fallow' WHEN pest_load < 0.1 THEN 'healthy'
       WHEN pest_load <= 0.4 THEN 'light' WHEN pest_load <= 0.7 THEN 'moderate' ELSE 'overwhelmed' END AS band
FROM daily""", "daily"))
def _load_band(spark, folder):
    days = views.daily(spark, folder)
    return days.select("plot_id", "day", growth.load_band("pest_load", F.col("day") <= 25).alias("band"))


@plan("c06_growth_stage", sql("SELECT plot_id, day, heat, stage, fapar, weight FROM staged", "heated", staged=STAGED))
def _growth_stage(spark, folder):
    return heat_accumulation(views.plotday(spark, folder)).select(
        "plot_id",
        "day",
        "heat",
        growth.growth_stage("heat").alias("stage"),
        growth.light_share("heat").alias("fapar"),
        growth.damage_weight("heat").alias("weight"),
    )


@plan("c07_daily_growth", sql("""
SELECT plot_id, day, round(k_pest + 3.7e-10, 6) AS k_pest, round(potential + 3.7e-10, 6) AS potential,
       round(potential * k_pest + 3.7e-10, 6) AS actual, round(potential - potential * k_pest + 3.7e-10, 6) AS loss
FROM grown""", "heated", staged=STAGED, grown=GROWN))
def _daily_growth(spark, folder):
    heated = heat_accumulation(views.plotday(spark, folder))
    factor = growth.growth_factor("pest_load", growth.damage_weight("heat"))
    potential = growth.potential_growth("solar_rad", growth.light_share("heat"))
    return heated.select(
        "plot_id",
        "day",
        shifted6(factor, "k_pest"),
        shifted6(potential, "potential"),
        shifted6(potential * factor, "actual"),
        shifted6(potential - potential * factor, "loss"),
    )


@plan("c08_heat_units", sql("""
SELECT plot_id, day, greatest(CAST(0 AS DOUBLE), t_mean - 10) AS heat_units FROM plotday""", "plotday"))
def _heat_units(spark, folder):
    return views.plotday(spark, folder).select("plot_id", "day", growth.heat_units().alias("heat_units"))


@plan("c09_infection_day", sql("""
SELECT plot_id, day, plot_id % 100 <> 44 AND humidity > 80 AND t_mean > 27 AS eligible FROM plotday""", "plotday"))
def _infection_day(spark, folder):
    source = F.col("plot_id") % 100 != 44
    return views.plotday(spark, folder).select(
        "plot_id", "day", growth.infection_day(is_source=source).alias("eligible")
    )


_POOLS = """
SELECT l.*, l.resistant_fraction AS pool_a, l.resistant_fraction / 2 AS pool_b,
       coalesce(c.efficacy, 0.8) AS efficacy, coalesce(c.selection_pressure, 0.02) AS selection_pressure
FROM ledger l LEFT JOIN compounds c ON l.pesticide_choice = c.compound"""
_MET = """
SELECT *, CASE pesticide_choice WHEN 'etofenprox' THEN least(1, pool_a + pool_b * 0.25)
               WHEN 'neonicotinoid' THEN least(1, pool_b + pool_a * 0.25)
               ELSE greatest(pool_a, pool_b) END AS effective_rf
FROM pools"""


@plan("c10_effective_rf", sql("""
SELECT run_id, plot_x, plot_y, season, pesticide_choice, effective_rf,
       round(efficacy * (1 - effective_rf) + 3.7e-10, 6) AS realized_efficacy,
       round(0.75 * (1 - efficacy * (1 - effective_rf)) + 3.7e-10, 6) AS load_after
FROM met""", "ledger", "compounds", pools=_POOLS, met=_MET))
def _effective_rf(spark, folder):
    rows = with_compound(views.ledger(spark, folder), views.compounds(spark))
    half = F.col("resistant_fraction") / 2
    rf = resistance.effective_rf("pesticide_choice", "resistant_fraction", half, 0.25)
    met = rows.withColumn("effective_rf", rf)
    realized = resistance.realized_efficacy("efficacy", "effective_rf")
    return met.select(
        "run_id", "plot_x", "plot_y", "season", "pesticide_choice", "effective_rf",
        shifted6(realized, "realized_efficacy"),
        shifted6(resistance.load_after_spray(0.75, realized), "load_after"),
    )


@plan("c11_resistance_increment", sql("""
SELECT plot_id, day, n AS lifetime_sprays,
       round(CAST(0.02 AS DOUBLE) * CASE WHEN n <= 3 THEN 0.5 WHEN n > 7 THEN 2.5 ELSE 1.0 END, 6) AS increment
FROM (SELECT plot_id, day, sprayed, CAST(sum(sprayed) OVER (PARTITION BY plot_id ORDER BY day
             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM daily) t
WHERE sprayed = 1""", "daily"))
def _increment(spark, folder):
    days = views.daily(spark, folder).withColumn("season", F.lit(1))
    return (
        spray_numbers(days)
        .filter("sprayed = 1")
        .select(
            "plot_id",
            "day",
            "lifetime_sprays",
            r6(resistance.resistance_increment(0.02, "lifetime_sprays"), "increment"),
        )
    )


@plan("c12_boundary_decay", sql("""
SELECT run_id, plot_x, plot_y, season,
       round(resistant_fraction * (1 - CAST(0.05 AS DOUBLE)) * (1 - CAST(0.01 AS DOUBLE)) + 3.7e-10, 6) AS pool_a,
       round(resistant_fraction / 2 * (1 - CAST(0.05 AS DOUBLE)) * (1 - CAST(0.01 AS DOUBLE)) + 3.7e-10, 6) AS pool_b,
       round(greatest(resistant_fraction, resistant_fraction / 2) * (1 - CAST(0.05 AS DOUBLE))
             * (1 - CAST(0.01 AS DOUBLE)) + 3.7e-10, 6) AS combined
FROM ledger""", "ledger"))
def _boundary_decay(spark, folder):
    a = resistance.boundary_decay("resistant_fraction", 0.05, 0.01)
    b = resistance.boundary_decay(F.col("resistant_fraction") / 2, 0.05, 0.01)
    return views.ledger(spark, folder).select(
        "run_id", "plot_x", "plot_y", "season",
        shifted6(a, "pool_a"), shifted6(b, "pool_b"), shifted6(F.greatest(a, b), "combined"),
    )


@plan("c13_scheduled_compound", sql("""
SELECT run_id, plot_x, plot_y, season, pesticide_choice,
       CASE WHEN substr('ABBB', (season - 1) % 4 + 1, 1) = 'B' THEN 'neonicotinoid' ELSE 'etofenprox' END AS scheduled
FROM ledger""", "ledger"))
def _scheduled(spark, folder):
    rows = views.ledger(spark, folder)
    return rows.select(
        "run_id", "plot_x", "plot_y", "season", "pesticide_choice",
        schedule.scheduled_compound(F.lit("ABBB"), "season").alias("scheduled"),
    )


SINCE = """
SELECT *, day - coalesce(max(CASE WHEN sprayed = 1 THEN day END) OVER (PARTITION BY plot_id ORDER BY day
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since
FROM daily"""


@plan("c14_spray_decision", sql("""
SELECT plot_id, day, since, CASE plot_id % 3 WHEN 0 THEN false WHEN 1 THEN since >= 14
       ELSE since >= 7 AND pest_load > 0.3 END AS should_spray
FROM since_days""", "daily", since_days=SINCE))
def _decision(spark, folder):
    days = days_since_spray(views.daily(spark, folder))
    strategy = (
        F.when(F.col("plot_id") % 3 == 0, "none").when(F.col("plot_id") % 3 == 1, "calendar").otherwise("threshold")
    )
    return days.select(
        "plot_id",
        "day",
        F.col("days_since_spray").alias("since"),
        schedule.should_spray(strategy, "days_since_spray", "pest_load").alias("should_spray"),
    )


@plan("c15_run_id_parts", sql("""
SELECT run_id, season, plot_x, plot_y, split_part(run_id, '_', 1) AS initial_strategy,
       CAST(split_part(run_id, '_', 2) AS INT) AS run_number
FROM harvest""", "harvest"))
def _run_parts(spark, folder):
    return views.harvest(spark, folder).select(
        *_PLOT,
        keys.run_strategy("run_id").alias("initial_strategy"),
        keys.run_number("run_id").alias("run_number"),
    )


@plan("c16_filters", sql("""
SELECT run_id, strategy, season, plot_x, plot_y, grain_tha, spray_count > 3 AS heavy
FROM harvest
WHERE strategy IN ('calendar', 'threshold') AND pesticide_choice = 'etofenprox' AND season <= 6
  AND immigration_rate = CAST(0.4 AS DOUBLE) AND (spray_count > 3) = true""", "harvest"))
def _filters(spark, folder):
    rows = views.harvest(spark, folder).withColumn("heavy", F.col("spray_count") > 3)
    return rows.filter(
        F.col("strategy").isin("calendar", "threshold")
        & (F.col("pesticide_choice") == "etofenprox")
        & (F.col("season") <= 6)
        & (F.col("immigration_rate") == 0.4)
        & (F.col("heavy") == F.lit(True))
    ).select("run_id", "strategy", "season", "plot_x", "plot_y", "grain_tha", "heavy")


@plan("c17_condition_keys", sql("""
SELECT round(immigration_rate + 0.0004, 1) AS immigration_key, CAST(season AS INT) AS season_key,
       CAST(count(*) AS BIGINT) AS n_rows, avg(grain_tha) AS grain_mean
FROM harvest GROUP BY 1, 2""", "harvest"))
def _condition_keys(spark, folder):
    return (
        views.harvest(spark, folder)
        .groupBy(
            keys.condition_key(F.col("immigration_rate") + 0.0004).alias("immigration_key"),
            keys.season_key("season").alias("season_key"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("grain_tha").alias("grain_mean"))
    )


@plan("c18_named_aggregates", sql("""
SELECT strategy, avg(grain_tha) AS grain_mean, round(stddev_samp(grain_tha), 6) AS grain_sd,
       max(season) AS last_season, CAST(sum(spray_count) AS BIGINT) AS sprays,
       CAST(count(grain_tha) AS BIGINT) AS n
FROM harvest GROUP BY strategy""", "harvest"))
def _named(spark, folder):
    named = summarize(
        views.harvest(spark, folder),
        ["strategy"],
        grain_mean=("grain_tha", "mean"),
        grain_sd=("grain_tha", "std"),
        last_season=("season", "max"),
        sprays=("spray_count", "sum"),
        n=("grain_tha", "count"),
    )
    return named.withColumn("grain_sd", r6("grain_sd"))


@plan("c19_yield_loss_share", sql("""
SELECT run_id, season, plot_x, plot_y,
       CASE WHEN grain_tha + pest_loss_tha <> 0 THEN pest_loss_tha / (grain_tha + pest_loss_tha) END AS loss_share
FROM harvest""", "harvest"))
def _loss_share(spark, folder):
    return views.harvest(spark, folder).select(*_PLOT, economics.yield_loss_share().alias("loss_share"))
