"""Running and ordered columns, replays and adaptive rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import adaptive, replay, windows
from fieldtally.operators.joins import with_compound
from fieldtally.operators.summaries import balanced_profit, rf_plateau
from fieldtally.plans.base import IDS, plan, r6, shifted6, sql
from fieldtally.plans.rows import SINCE, GROWN, STAGED
from fieldtally.plans.summaries import TOTALS, CONDITION
from fieldtally.sources import views


@plan("w1_cumulative_exposure", sql("""
SELECT plot_id, day, pest_load, sum(pest_load) OVER (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)
       AS cumulative_exposure
FROM daily""", "daily"))
def _exposure(spark, folder):
    return windows.cumulative_exposure(views.daily(spark, folder)).drop("sprayed")


@plan("w2_days_above_threshold", sql("""
SELECT plot_id, day, CAST(sum(CASE WHEN pest_load > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY plot_id ORDER BY day
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS days_above_threshold
FROM daily""", "daily"))
def _days_above(spark, folder):
    return windows.days_above(views.daily(spark, folder)).select("plot_id", "day", "days_above_threshold")


@plan("w3_days_since_spray", sql("SELECT plot_id, day, since AS days_since_spray FROM since_days", "daily",
                                 since_days=SINCE))
def _days_since(spark, folder):
    return windows.days_since_spray(views.daily(spark, folder)).select("plot_id", "day", "days_since_spray")


@plan("w4_spray_numbers", sql("""
SELECT plot_id, season, day, CAST(sum(sprayed) OVER (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)
       AS BIGINT) AS lifetime_sprays,
       CAST(sum(sprayed) OVER (PARTITION BY plot_id, season ORDER BY day ROWS UNBOUNDED PRECEDING)
       AS BIGINT) AS season_sprays
FROM (SELECT *, CAST(floor((day - 1) / 10) + 1 AS INT) AS season FROM daily) d""", "daily"))
def _spray_numbers(spark, folder):
    days = views.daily(spark, folder).withColumn("season", (F.floor((F.col("day") - 1) / 10) + 1).cast("int"))
    return windows.spray_numbers(days).select("plot_id", "season", "day", "lifetime_sprays", "season_sprays")


@plan("w5_heat_accumulation", sql("""
SELECT plot_id, day, heat, min(CASE WHEN heat >= 1350 THEN day END) OVER (PARTITION BY plot_id) AS maturity_day
FROM heated""", "heated"))
def _heat(spark, folder):
    found = windows.heat_accumulation(views.plotday(spark, folder))
    return found.select("plot_id", "day", "heat", "maturity_day")


@plan("w6_growth_accumulation", sql("""
SELECT plot_id, day, round(sum(potential * k_pest) OVER w + 3.7e-10, 6) AS biomass,
       round(sum(potential - potential * k_pest) OVER w + 3.7e-10, 6) AS biomass_loss
FROM grown WINDOW w AS (PARTITION BY plot_id ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "heated", staged=STAGED, grown=GROWN))
def _growth(spark, folder):
    found = windows.growth_accumulation(views.plotday(spark, folder))
    return found.select("plot_id", "day", shifted6("biomass"), shifted6("biomass_loss"))


def _run_seasons(spark, folder):
    return windows.run_seasons(views.harvest(spark, folder), ["strategy"])


@plan("w7_profit_change", sql("""
SELECT run_id, season, profit, felt_profit, previous_profit, felt_profit - previous_profit AS profit_change, declined
FROM changes""", "changes"))
def _profit_change(spark, folder):
    found = windows.profit_change(_run_seasons(spark, folder))
    return found.select(
        "run_id", "season", "profit", "felt_profit", "previous_profit", "profit_change", "declined"
    )


@plan("w8_wallet", sql("""
SELECT run_id, season, revenue, spray_cost, 5000 + sum(revenue - spray_cost) OVER (PARTITION BY run_id ORDER BY season
       ROWS UNBOUNDED PRECEDING) AS end_money
FROM runs""", "runs"))
def _wallet(spark, folder):
    found = windows.wallet(_run_seasons(spark, folder))
    return found.select("run_id", "season", "revenue", "spray_cost", "end_money")


BACKOFF = """
SELECT run_id, strategy, season, declines_before,
       CAST(CASE WHEN strategy = 'calendar' THEN least(28, 14 + 2 * declines_before) ELSE 14 END AS INT)
           AS interval_in_force,
       CASE WHEN strategy = 'threshold' THEN least(CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE) + 0.05 * declines_before)
            ELSE CAST(0.3 AS DOUBLE) END AS threshold_in_force
FROM moves"""
_FORCE = ("run_id", "strategy", "season", "declines_before", "interval_in_force")


@plan("w9_backoff", sql("""
SELECT run_id, strategy, season, declines_before, interval_in_force,
       round(threshold_in_force, 6) AS threshold_in_force
FROM backoff""", "moves", backoff=BACKOFF))
def _backoff(spark, folder):
    return adaptive.backoff(_run_seasons(spark, folder)).select(*_FORCE, r6("threshold_in_force"))


@plan("w10_escalation", sql("""
SELECT run_id, strategy, season, declines_before,
       CAST(CASE WHEN strategy = 'calendar' THEN greatest(1, 14 - 2 * declines_before) ELSE 14 END AS INT)
           AS interval_in_force,
       round(CASE WHEN strategy = 'threshold'
                  THEN greatest(CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE) - 0.05 * declines_before)
                  ELSE CAST(0.3 AS DOUBLE) END, 6) AS threshold_in_force
FROM moves""", "moves"))
def _escalation(spark, folder):
    return adaptive.escalation(_run_seasons(spark, folder)).select(*_FORCE, r6("threshold_in_force"))


def _swap_sql(flag: str) -> str:
    return sql(f"""
SELECT run_id, strategy, season, swaps_before,
       CASE ((CASE strategy WHEN 'calendar' THEN 0 WHEN 'threshold' THEN 1 ELSE 2 END) + swaps_before) % 3
            WHEN 0 THEN 'calendar' WHEN 1 THEN 'threshold' ELSE 'none' END AS strategy_in_force
FROM (SELECT *, CAST(coalesce(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY season
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS swaps_before FROM changes) t""",
        "changes")


_SWAP = ("run_id", "strategy", "season", "swaps_before", "strategy_in_force")


@plan("w11_strategy_swaps_by_profit", _swap_sql("declined"))
def _swaps_by_profit(spark, folder):
    return adaptive.strategy_swaps(_run_seasons(spark, folder)).select(*_SWAP)


@plan("w11_strategy_swaps_by_resistance", _swap_sql("mean_rf * CAST(0.95 AS DOUBLE) > 0.5"))
def _swaps_by_resistance(spark, folder):
    trigger = adaptive.resistance_trigger()
    return adaptive.strategy_swaps(_run_seasons(spark, folder), trigger).select(*_SWAP)


# The replay as a recursive walk over each plot's seasons.
_DOSED = """
SELECT l.run_id, l.plot_x, l.plot_y, l.season, l.pesticide_choice, l.spray_count,
       coalesce(c.selection_pressure, 0.02) AS pressure,
       row_number() OVER (PARTITION BY l.run_id, l.plot_x, l.plot_y ORDER BY l.season) AS step,
       coalesce(sum(l.spray_count) OVER (PARTITION BY l.run_id, l.plot_x, l.plot_y ORDER BY l.season
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       l.season - lag(l.season) OVER (PARTITION BY l.run_id, l.plot_x, l.plot_y ORDER BY l.season) AS gap
FROM ledger l LEFT JOIN compounds c ON l.pesticide_choice = c.compound"""
_GAINS = """
SELECT *, pressure * (0.5 * (least(before + spray_count, 3) - least(before, 3))
                      + 2.5 * (greatest(before + spray_count, 7) - greatest(before, 7))
                      + (spray_count - (least(before + spray_count, 3) - least(before, 3))
                         - (greatest(before + spray_count, 7) - greatest(before, 7)))) AS gain,
       pow(CAST(0.95 AS DOUBLE), coalesce(gap, 0)) AS kept
FROM dosed"""
_POOL_WALK = """
SELECT run_id, plot_x, plot_y, season, step, pesticide_choice, spray_count,
       CAST(CASE WHEN pesticide_choice = 'neonicotinoid' THEN 0 ELSE least(1, gain) END AS DOUBLE) AS pool_a,
       CAST(CASE WHEN pesticide_choice = 'etofenprox' THEN 0 ELSE least(1, gain) END AS DOUBLE) AS pool_b
FROM gains WHERE step = 1
UNION ALL
SELECT g.run_id, g.plot_x, g.plot_y, g.season, g.step, g.pesticide_choice, g.spray_count,
       CAST(CASE WHEN g.pesticide_choice = 'neonicotinoid' THEN w.pool_a * g.kept
                 ELSE least(1, w.pool_a * g.kept + g.gain) END AS DOUBLE),
       CAST(CASE WHEN g.pesticide_choice = 'etofenprox' THEN w.pool_b * g.kept
                 ELSE least(1, w.pool_b * g.kept + g.gain) END AS DOUBLE)
FROM walk w JOIN gains g ON g.run_id = w.run_id AND g.plot_x = w.plot_x AND g.plot_y = w.plot_y
     AND g.step = w.step + 1"""
_REPLAYED = {"dosed": _DOSED, "gains": _GAINS, "walk": _POOL_WALK}


def _pools(spark, folder):
    return replay.replay_rf(with_compound(views.ledger(spark, folder), views.compounds(spark)))


@plan("w12_reactive_compound", sql("""
SELECT run_id, season, round(mean_a + 3.7e-10, 6) AS mean_a, round(mean_b + 3.7e-10, 6) AS mean_b,
       CASE WHEN lag(round(mean_b, 9)) OVER (PARTITION BY run_id ORDER BY season)
                 < lag(round(mean_a, 9)) OVER (PARTITION BY run_id ORDER BY season)
            THEN 'neonicotinoid' ELSE 'etofenprox' END AS reactive_choice
FROM (SELECT run_id, season, avg(pool_a) AS mean_a, avg(pool_b) AS mean_b FROM walk GROUP BY run_id, season) m""",
    "ledger", "compounds", recursive=True, **_REPLAYED))
def _reactive(spark, folder):
    found = replay.reactive_compound(_pools(spark, folder))
    return found.select("run_id", "season", shifted6("mean_a"), shifted6("mean_b"), "reactive_choice")


@plan("w13_replay_rf", sql("""
SELECT run_id, plot_x, plot_y, season, pesticide_choice, spray_count, round(pool_a + 3.7e-10, 6) AS pool_a,
       round(pool_b + 3.7e-10, 6) AS pool_b,
       round(3.7e-10 + CASE WHEN spray_count = 0 OR pesticide_choice = 'starfarm' THEN greatest(pool_a, pool_b)
                  WHEN pesticide_choice = 'etofenprox' THEN pool_a ELSE pool_b END, 6) AS resistant_fraction
FROM walk""", "ledger", "compounds", recursive=True, **_REPLAYED))
def _replay(spark, folder):
    found = _pools(spark, folder)
    return found.select(
        "run_id", "plot_x", "plot_y", "season", "pesticide_choice", "spray_count",
        shifted6("pool_a"), shifted6("pool_b"), shifted6("resistant_fraction"),
    )


@plan("w14_rank_by_profit", sql("""
SELECT strategy, pesticide_choice, immigration_rate, round(cumulative_profit, 6) AS cumulative_profit,
       CAST(row_number() OVER (PARTITION BY strategy ORDER BY cumulative_profit DESC) AS INT) AS place
FROM totals""", "harvest", totals=TOTALS))
def _rank(spark, folder):
    totals = balanced_profit(views.harvest(spark, folder), CONDITION)
    ranked = windows.rank_by_profit(totals, ["strategy"], ["pesticide_choice", "immigration_rate"])
    return ranked.select(*CONDITION, r6("cumulative_profit"), "place")


@plan("w16_minimum_spacing", sql("""
SELECT plot_id, day, CAST(n AS INT) AS spray_number FROM walk""", "daily", recursive=True,
    candidates="SELECT plot_id, day FROM daily WHERE pest_load > 0.3",
    walk="""
SELECT plot_id, min(day) AS day, 1 AS n FROM candidates WHERE day >= 7 GROUP BY plot_id
UNION ALL
SELECT plot_id, day, n FROM (
    SELECT w.plot_id, c.day, w.n + 1 AS n, row_number() OVER (PARTITION BY w.plot_id ORDER BY c.day) AS r
    FROM walk w JOIN candidates c ON c.plot_id = w.plot_id AND c.day >= w.day + 7) t
WHERE r = 1"""))
def _spacing(spark, folder):
    return replay.spaced_days(views.daily(spark, folder), F.col("pest_load") > 0.3)


@plan("w17_trajectory", sql("""
SELECT strategy, pesticide_choice, season, resistant_fraction FROM seasons WHERE strategy = 'threshold'
ORDER BY strategy, pesticide_choice, season""", "seasons"))
def _trajectory(spark, folder):
    log = views.harvest(spark, folder).filter(F.col("strategy") == "threshold")
    return windows.trajectory(log, IDS)


@plan("w18_rf_growth", sql("""
SELECT strategy, pesticide_choice, season, resistant_fraction, round(resistant_fraction - lag(resistant_fraction)
       OVER (PARTITION BY strategy, pesticide_choice ORDER BY season), 6) AS rf_change
FROM seasons""", "seasons"))
def _rf_growth(spark, folder):
    found = windows.rf_growth(views.harvest(spark, folder), IDS)
    return found.select(*IDS, "season", "resistant_fraction", r6("rf_change"))


@plan("w18_rf_plateau", sql("""
SELECT strategy, pesticide_choice, last_season, final_rf, round(mean_change, 6) AS mean_change,
       mean_change > 0.005 AS still_climbing
FROM (SELECT strategy, pesticide_choice, max(season) AS last_season, max_by(resistant_fraction, season) AS final_rf,
             (max_by(resistant_fraction, season) - min_by(resistant_fraction, season)) / (count(*) - 1) AS mean_change
      FROM (SELECT *, row_number() OVER (PARTITION BY strategy, pesticide_choice ORDER BY season DESC) AS r
            FROM seasons) s WHERE r <= 4 GROUP BY strategy, pesticide_choice) t""", "seasons"))
def _rf_plateau(spark, folder):
    found = rf_plateau(views.harvest(spark, folder), IDS)
    return found.withColumn("mean_change", r6("mean_change"))
