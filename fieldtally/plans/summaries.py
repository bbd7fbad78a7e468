"""Aggregates, sorting, first and last, unions and distinct conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.economics import with_net_profit
from fieldtally.operators import summaries as ops
from fieldtally.operators.analysis import analyze
from fieldtally.operators.spatial import outbreak_ring, plot_position, spatial_gradient
from fieldtally.operators.windows import best_and_worst
from fieldtally.plans.base import HARVEST_LOG, IDS, plan, r6, sql
from fieldtally.sources import views
from fieldtally.sources.contracts import present_keys
from fieldtally.sources.logs import union_logs

_FIX = "min(CASE WHEN resistant_fraction >= 0.99 THEN season END)"
_COND = "strategy, pesticide_choice, immigration_rate"


@plan("fixation_by_condition", sql(f"""
SELECT strategy, pesticide_choice, {_FIX} AS fixation_season, max(season) AS max_season,
       max_by(resistant_fraction, season) AS final_mean_rf
FROM seasons GROUP BY strategy, pesticide_choice ORDER BY fixation_season, strategy, pesticide_choice""", "seasons"))
def flagship(spark, folder):
    """When does each strategy and compound lose its pesticide?"""
    log = with_net_profit(views.harvest(spark, folder))
    found = ops.fixation(log, present_keys(log, HARVEST_LOG))
    return found.orderBy(F.asc_nulls_last("fixation_season"), *IDS)


@plan("analyze_log", sql(f"""
SELECT strategy, pesticide_choice, {_FIX} AS fixation_season, max(season) AS max_season,
       max_by(resistant_fraction, season) AS final_mean_rf, CAST(count(season) AS BIGINT) AS n_seasons,
       round(sum(net_profit), 6) AS cumulative_profit, round(stddev_pop(net_profit), 6) AS profit_sd,
       round(avg(net_profit), 6) AS mean_profit
FROM seasons GROUP BY strategy, pesticide_choice""", "seasons"))
def _analyze(spark, folder):
    found = analyze(views.harvest(spark, folder), IDS)
    both = found.fixation.join(found.profit, IDS)
    return both.select(
        *IDS, "fixation_season", "max_season", "final_mean_rf", "n_seasons",
        r6("cumulative_profit"), r6("profit_sd"), r6("mean_profit"),
    )


@plan("a1_season_summary", sql("""
SELECT strategy, pesticide_choice, season, grain_tha, pest_loss_tha, resistant_fraction, spray_count, cost_per_spray
FROM seasons""", "seasons"))
def _season_summary(spark, folder):
    log = views.harvest(spark, folder)
    return ops.season_summary(log, present_keys(log, HARVEST_LOG))


@plan("a2_mean_sd", sql("""
SELECT strategy, season, avg(grain_tha) AS grain_mean, round(stddev_samp(grain_tha), 6) AS grain_sd,
       avg(spray_count) AS spray_mean, round(stddev_samp(spray_count), 6) AS spray_sd
FROM harvest GROUP BY strategy, season""", "harvest"))
def _mean_sd(spark, folder):
    found = ops.mean_sd(
        views.harvest(spark, folder), ["strategy", "season"], {"grain_tha": "grain", "spray_count": "spray"}
    )
    return found.select("strategy", "season", "grain_mean", r6("grain_sd"), "spray_mean", r6("spray_sd"))


@plan("a3_fixation", sql(f"""
SELECT strategy, pesticide_choice, {_FIX} AS fixation_season, max(season) AS max_season,
       max_by(resistant_fraction, season) AS final_mean_rf
FROM seasons GROUP BY strategy, pesticide_choice""", "seasons"))
def _fixation(spark, folder):
    return ops.fixation(views.harvest(spark, folder), IDS)


def _rounded_profit(found, *keys):
    return found.select(
        *keys, "n_seasons", r6("cumulative_profit"), r6("profit_sd"), r6("mean_profit")
    )


_PROFIT = """CAST(count(season) AS BIGINT) AS n_seasons, round(sum(net_profit), 6) AS cumulative_profit,
       round(stddev_pop(net_profit), 6) AS profit_sd, round(avg(net_profit), 6) AS mean_profit"""


@plan("a4_profit_summary", sql(f"""
SELECT strategy, pesticide_choice, {_PROFIT} FROM seasons GROUP BY strategy, pesticide_choice""", "seasons"))
def _profit_summary(spark, folder):
    return _rounded_profit(ops.profit_summary(views.harvest(spark, folder), IDS), *IDS)


@plan("a5_balanced_profit", sql(f"""
SELECT strategy, pesticide_choice, {_PROFIT} FROM balanced GROUP BY strategy, pesticide_choice""", "balanced"))
def _balanced_profit(spark, folder):
    return _rounded_profit(ops.balanced_profit(views.harvest(spark, folder), IDS), *IDS)


@plan("a6_run_total", sql("SELECT run_id, strategy, immigration_rate, profit FROM run_profit", "run_profit"))
def _run_total(spark, folder):
    return ops.run_total(views.harvest(spark, folder), ["strategy", "immigration_rate"])


@plan("a7_run_means", sql("""
SELECT run_id, strategy, avg(grain_tha) AS grain_tha FROM harvest WHERE season = 4 GROUP BY run_id, strategy""",
    "harvest"))
def _run_means(spark, folder):
    return ops.run_means(views.harvest(spark, folder), ["strategy"], season=4)


@plan("a8_early_mean", sql("""
SELECT strategy, pesticide_choice, round(avg(g), 6) AS early_grain_tha
FROM (SELECT strategy, pesticide_choice, run_id, avg(grain_tha) AS g FROM harvest WHERE season <= 6 GROUP BY ALL) t
GROUP BY strategy, pesticide_choice""", "harvest"))
def _early_mean(spark, folder):
    found = ops.early_mean(views.harvest(spark, folder), IDS)
    return found.select(*IDS, r6("early_grain_tha"))


@plan("a9_terminal_mean", sql("""
SELECT strategy, pesticide_choice, max(season) AS season, max_by(grain_tha, season) AS terminal_grain_tha
FROM seasons GROUP BY strategy, pesticide_choice""", "seasons"))
def _terminal_mean(spark, folder):
    return ops.terminal_mean(views.harvest(spark, folder), IDS)


@plan("a9_fixed_season_mean", sql("""
SELECT strategy, pesticide_choice, season, grain_tha AS terminal_grain_tha FROM seasons WHERE season = 5""",
    "seasons"))
def _fixed_season(spark, folder):
    return ops.terminal_mean(views.harvest(spark, folder), IDS, season=5)


@plan("a10_condition_mean", sql("""
SELECT strategy, avg(grain_tha) AS grain_tha_mean, avg(spray_count) AS spray_count_mean
FROM harvest GROUP BY strategy""", "harvest"))
def _condition_mean(spark, folder):
    return ops.condition_mean(views.harvest(spark, folder), ["strategy"], ["grain_tha", "spray_count"])


@plan("a11_mean_of_season_sds", sql("""
SELECT strategy, (SELECT avg(spray_count) FROM harvest h WHERE h.strategy = t.strategy) AS spray_count_mean,
       round(avg(sd), 6) AS spray_count_mean_sd
FROM (SELECT strategy, season, stddev_samp(spray_count) AS sd FROM harvest GROUP BY strategy, season) t
GROUP BY strategy""", "harvest"))
def _mean_of_sds(spark, folder):
    found = ops.mean_of_season_sds(views.harvest(spark, folder), ["strategy"])
    return found.select("strategy", "spray_count_mean", r6("spray_count_mean_sd"))


@plan("a12_peak_rf", sql("""
SELECT strategy, pesticide_choice, max(resistant_fraction) AS peak_rf
FROM seasons GROUP BY strategy, pesticide_choice""", "seasons"))
def _peak_rf(spark, folder):
    return ops.peak_rf(views.harvest(spark, folder), IDS)


@plan("a13_run_inventory", sql("""
SELECT run_id, strategy, pesticide_choice, max(season) AS last_season, CAST(count(season) AS BIGINT) AS n_rows
FROM harvest GROUP BY run_id, strategy, pesticide_choice""", "harvest"))
def _run_inventory(spark, folder):
    return ops.run_inventory(views.harvest(spark, folder))


@plan("a14_distinct_counts", sql("""
SELECT CAST(count(DISTINCT run_id) AS BIGINT) AS n_run_id, CAST(count(DISTINCT strategy) AS BIGINT) AS n_strategy,
       CAST(count(DISTINCT immigration_rate) AS BIGINT) AS n_immigration_rate
FROM harvest""", "harvest"))
def _distinct_counts(spark, folder):
    return ops.distinct_counts(views.harvest(spark, folder), ["run_id", "strategy", "immigration_rate"])


@plan("a14_distinct_values", sql("SELECT DISTINCT immigration_rate FROM harvest", "harvest"))
def _distinct_values(spark, folder):
    return ops.distinct_values(views.harvest(spark, folder), "immigration_rate")


_SWEEP = """
SELECT spray_count, immigration_rate, season, avg(resistant_fraction) AS resistant_fraction
FROM harvest GROUP BY spray_count, immigration_rate, season"""
_PAIRS = f"""
SELECT spray_count, immigration_rate, {_FIX} AS fixation_season, max(resistant_fraction) AS peak_rf
FROM sweep GROUP BY spray_count, immigration_rate"""


@plan("a15_sweep_fixation", sql("SELECT * FROM pairs", "harvest", sweep=_SWEEP, pairs=_PAIRS))
def _sweep_fixation(spark, folder):
    return ops.sweep_fixation(views.harvest(spark, folder), "spray_count", "immigration_rate")


@plan("a15_sweep_matrix", sql("""
SELECT spray_count, max(CASE WHEN immigration_rate = 0.05 THEN fixation_season END) AS "immigration_rate_0.05",
       max(CASE WHEN immigration_rate = 0.2 THEN fixation_season END) AS "immigration_rate_0.2",
       max(CASE WHEN immigration_rate = 0.4 THEN fixation_season END) AS "immigration_rate_0.4",
       max(CASE WHEN immigration_rate = 0.7 THEN fixation_season END) AS "immigration_rate_0.7"
FROM pairs GROUP BY spray_count""", "harvest", sweep=_SWEEP, pairs=_PAIRS))
def _sweep_matrix(spark, folder):
    return ops.sweep_matrix(
        views.harvest(spark, folder), "spray_count", "immigration_rate", (0.05, 0.2, 0.4, 0.7)
    )


@plan("a16_fixation_free_frontier", sql("""
SELECT immigration_rate, min(CASE WHEN fixation_season IS NULL THEN spray_count END) AS min_spray_count
FROM pairs GROUP BY immigration_rate""", "harvest", sweep=_SWEEP, pairs=_PAIRS))
def _frontier(spark, folder):
    return ops.fixation_free_frontier(views.harvest(spark, folder), "spray_count", "immigration_rate")


@plan("a17_plot_choice_summary", sql("""
SELECT strategy AS plot_strategy, pesticide_choice AS plot_pesticide, season, grain_tha, pest_loss_tha,
       resistant_fraction, spray_count, cost_per_spray
FROM seasons""", "seasons"))
def _plot_choice(spark, folder):
    log = views.harvest(spark, folder).withColumnsRenamed(
        {"strategy": "plot_strategy", "pesticide_choice": "plot_pesticide"}
    )
    return ops.plot_choice_summary(log)


@plan("a18_position_gradient", sql("""
SELECT strategy, season, CASE WHEN plot_x IN (0, 9) AND plot_y IN (0, 9) THEN 'corner'
            WHEN plot_x IN (0, 9) OR plot_y IN (0, 9) THEN 'edge' ELSE 'interior' END AS place,
       avg(pest_loss_tha) AS mean_loss, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY 1, 2, 3""", "harvest"))
def _position_gradient(spark, folder):
    return spatial_gradient(views.harvest(spark, folder), ["strategy", "season"], plot_position())


@plan("a18_outbreak_gradient", sql("""
SELECT strategy, CASE WHEN greatest(abs(plot_x - 4), abs(plot_y - 4)) = 0 THEN 'centre'
            WHEN greatest(abs(plot_x - 4), abs(plot_y - 4)) = 1 THEN 'neighbour'
            WHEN plot_x IN (0, 9) AND plot_y IN (0, 9) THEN 'corner' ELSE 'other' END AS place,
       avg(pest_loss_tha) AS mean_loss, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY 1, 2""", "harvest"))
def _outbreak_gradient(spark, folder):
    return spatial_gradient(views.harvest(spark, folder), ["strategy"], outbreak_ring())


_DAILY_RF = """
SELECT *, least(CAST(1 AS DOUBLE), sum(sprayed) OVER (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)
       / CAST(8 AS DOUBLE)) AS resistant_fraction
FROM daily"""
MONITORS_SQL = """
SELECT day, avg(pest_load) AS mean_load, max(pest_load) AS max_load, avg(resistant_fraction) AS mean_rf,
       CAST(sum(sprayed) AS BIGINT) AS total_sprays, max(sprayed) AS any_spray
FROM daily_rf GROUP BY day"""


@plan("a19_daily_monitors", sql(MONITORS_SQL, "daily", daily_rf=_DAILY_RF))
def _daily_monitors(spark, folder):
    from fieldtally.operators.windows import spray_numbers

    days = spray_numbers(views.daily(spark, folder).withColumn("season", F.lit(1)))
    rf = F.least(F.lit(1.0), F.col("lifetime_sprays") / F.lit(8.0))
    return ops.daily_monitors(days.withColumn("resistant_fraction", rf))


@plan("a20_conservation", sql("""
SELECT strategy, pesticide_choice, min(grain_tha + pest_loss_tha) AS min_total,
       max(grain_tha + pest_loss_tha) AS max_total, round(max(grain_tha + pest_loss_tha) / 0.52, 6) AS max_biomass_tha,
       CAST(count(CASE WHEN abs(grain_tha + pest_loss_tha - 4.0075776) > 0.5 THEN 1 END) AS BIGINT) AS n_violations
FROM harvest GROUP BY strategy, pesticide_choice""", "harvest"))
def _conservation(spark, folder):
    found = ops.conservation(views.harvest(spark, folder), IDS, tolerance=0.5)
    return found.withColumn("max_biomass_tha", r6("max_biomass_tha"))


@plan("a20_conservation_violations", sql("""
SELECT run_id, season, plot_x, plot_y, grain_tha + pest_loss_tha AS total_tha
FROM harvest WHERE abs(grain_tha + pest_loss_tha - 4.0075776) > 0.5""", "harvest"))
def _conservation_violations(spark, folder):
    rows = ops.conservation_violations(views.harvest(spark, folder), tolerance=0.5)
    return rows.select("run_id", "season", "plot_x", "plot_y", "total_tha")


@plan("a21_duplicate_keys", sql("""
SELECT run_id, season, plot_x, plot_y, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY run_id, season, plot_x, plot_y HAVING count(*) > 1""", "harvest"))
def _duplicates(spark, folder):
    return ops.duplicate_keys(views.harvest(spark, folder), ["run_id", "season", "plot_x", "plot_y"])


@plan("a23_compound_comparison", sql(f"""
SELECT CASE pesticide_choice WHEN 'starfarm' THEN 'Default' ELSE pesticide_choice END AS compound, strategy, {_PROFIT}
FROM balanced GROUP BY 1, 2""", "balanced"))
def _compound_comparison(spark, folder):
    label = F.when(F.col("pesticide_choice") == "starfarm", "Default").otherwise(F.col("pesticide_choice"))
    labelled = views.harvest(spark, folder).withColumn("compound", label)
    return _rounded_profit(ops.balanced_profit(labelled, ["compound", "strategy"]), "compound", "strategy")


@plan("sr1_sorted_profit", sql(f"""
SELECT strategy, pesticide_choice, {_PROFIT} FROM seasons GROUP BY strategy, pesticide_choice
ORDER BY cumulative_profit DESC""", "seasons"))
def _sorted_profit(spark, folder):
    found = ops.profit_summary(views.harvest(spark, folder), IDS)
    return _rounded_profit(found, *IDS).orderBy(F.desc("cumulative_profit"), *IDS)


TOTALS = f"""
SELECT {_COND}, sum(np) AS cumulative_profit
FROM (SELECT {_COND}, season, avg(np) AS np
      FROM (SELECT {_COND}, run_id, season, avg(grain_tha * 3000 - spray_count * cost_per_spray) AS np
            FROM harvest GROUP BY ALL) a GROUP BY ALL) b
GROUP BY ALL"""
CONDITION = ["strategy", "pesticide_choice", "immigration_rate"]


@plan("sr2_best_and_worst", sql("""
SELECT b.strategy, b.pesticide_choice AS best_pesticide_choice, b.immigration_rate AS best_immigration_rate,
       round(b.cumulative_profit, 6) AS best_cumulative_profit, w.pesticide_choice AS worst_pesticide_choice,
       w.immigration_rate AS worst_immigration_rate, round(w.cumulative_profit, 6) AS worst_cumulative_profit
FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY cumulative_profit DESC, pesticide_choice,
                                   immigration_rate) AS p FROM totals) b
JOIN (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY cumulative_profit, pesticide_choice,
                                   immigration_rate) AS p FROM totals) w ON b.strategy = w.strategy
WHERE b.p = 1 AND w.p = 1""", "harvest", totals=TOTALS))
def _best_and_worst(spark, folder):
    totals = ops.balanced_profit(views.harvest(spark, folder), CONDITION)
    ends = best_and_worst(totals, ["strategy"], ["pesticide_choice", "immigration_rate"])
    return ends.withColumn("best_cumulative_profit", r6("best_cumulative_profit")).withColumn(
        "worst_cumulative_profit", r6("worst_cumulative_profit")
    )


@plan("sr2_top_conditions", sql("""
SELECT strategy, pesticide_choice, immigration_rate, round(cumulative_profit, 6) AS cumulative_profit
FROM totals ORDER BY cumulative_profit DESC LIMIT 5""", "harvest", totals=TOTALS))
def _top_conditions(spark, folder):
    totals = ops.balanced_profit(views.harvest(spark, folder), CONDITION)
    return (
        totals.orderBy(F.desc("cumulative_profit"), *CONDITION)
        .limit(5)
        .select(*CONDITION, r6("cumulative_profit"))
    )


@plan("so1_labelled_union", sql("""
SELECT strategy AS log, season, avg(grain_tha) AS grain_tha, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY strategy, season""", "harvest"))
def _labelled_union(spark, folder):
    log = views.harvest(spark, folder)
    parts = {name: log.filter(F.col("strategy") == name) for name in fixed.STRATEGIES}
    return (
        union_logs(parts, "log")
        .groupBy("log", "season")
        .agg(F.avg("grain_tha").alias("grain_tha"), F.count(F.lit(1)).alias("n_rows"))
    )


@plan("so2_distinct_conditions", sql(f"SELECT DISTINCT {_COND} FROM harvest", "harvest"))
def _distinct_conditions(spark, folder):
    return ops.distinct_conditions(views.harvest(spark, folder), CONDITION)
