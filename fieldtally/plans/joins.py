"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import joins, spatial
from fieldtally.operators.design import completeness, design
from fieldtally.operators.inference import mann_whitney, welch
from fieldtally.operators.summaries import season_summary
from fieldtally.operators.windows import heat_accumulation
from fieldtally.plans.base import plan, r6, shifted6, sql
from fieldtally.plans.inference import NORMAL_P, T_P, U_TEST, WELCH
from fieldtally.sources import views

# Reported figures by strategy and season: grain, sprays, resistance (fixed values);
# season 99 stands for rows that no log has.
REPORTED_ROWS = (
    ("none", 1, 2.314, 0.0, 0.000), ("none", 2, 2.316, 0.0, 0.000), ("none", 3, 2.314, 0.0, 0.000),
    ("calendar", 1, 3.293, 5.00, 0.070), ("calendar", 2, 3.129, 5.00, 0.255), ("calendar", 3, 2.747, 5.00, 0.486),
    ("threshold", 1, 3.516, 8.19, 0.173), ("threshold", 2, 3.205, 9.53, 0.637), ("threshold", 3, 2.454, 9.74, 0.989),
    ("calendar", 99, 3.293, 5.00, 0.070),
)
REPORTED_SQL = "SELECT CAST(s AS VARCHAR) AS strategy, CAST(n AS INT) AS season, CAST(g AS DOUBLE) AS grain_tha, " \
    "CAST(c AS DOUBLE) AS spray_count, CAST(r AS DOUBLE) AS resistant_fraction FROM (VALUES " + ", ".join(
        f"('{s}', {n}, {g}, {c}, {r})" for s, n, g, c, r in REPORTED_ROWS) + ") t(s, n, g, c, r)"
COMPUTED_SQL = """
SELECT strategy, season, avg(grain_tha) AS grain_tha, avg(spray_count) AS spray_count,
       avg(resistant_fraction) AS resistant_fraction
FROM harvest GROUP BY strategy, season"""
MEASURES = ("grain_tha", "spray_count", "resistant_fraction")


def reported(spark):
    return spark.createDataFrame(
        REPORTED_ROWS,
        "strategy string, season int, grain_tha double, spray_count double, resistant_fraction double",
    )


def computed(spark, folder):
    return season_summary(views.harvest(spark, folder), ["strategy"], MEASURES)


@plan("j1_compound_lookup", sql("""
SELECT h.run_id, h.season, h.plot_x, h.plot_y, h.pesticide_choice, coalesce(c.efficacy, 0.8) AS efficacy,
       coalesce(c.selection_pressure, 0.02) AS selection_pressure, coalesce(c.cost, 100.0) AS cost
FROM harvest h LEFT JOIN compounds c ON h.pesticide_choice = c.compound""", "harvest", "compounds"))
def _compound_lookup(spark, folder):
    rows = views.harvest(spark, folder).select("run_id", "season", "plot_x", "plot_y", "pesticide_choice")
    return joins.with_compound(rows, views.compounds(spark))


@plan("j2_reconcile", sql("""
SELECT strategy, season, c.grain_tha AS computed_grain, r.grain_tha AS reported_grain
FROM computed c JOIN reported r USING (strategy, season)""", "harvest", computed=COMPUTED_SQL, reported=REPORTED_SQL))
def _reconcile(spark, folder):
    told = reported(spark).select("strategy", "season", F.col("grain_tha").alias("reported_grain"))
    found = computed(spark, folder).select("strategy", "season", F.col("grain_tha").alias("computed_grain"))
    return joins.reconcile(found, told, ["strategy", "season"])


@plan("j3_unmatched", sql("""
SELECT strategy, season, CASE WHEN c.grain_tha IS NULL THEN 'reported only' ELSE 'computed only' END AS side
FROM computed c FULL JOIN reported r USING (strategy, season)
WHERE c.grain_tha IS NULL OR r.grain_tha IS NULL""", "harvest", computed=COMPUTED_SQL, reported=REPORTED_SQL))
def _unmatched(spark, folder):
    return joins.unmatched(computed(spark, folder), reported(spark), ["strategy", "season"])


@plan("j4_profit_lead", sql("""
SELECT season, round(max(CASE WHEN strategy = 'threshold' THEN np END), 6) AS ahead,
       round(max(CASE WHEN strategy = 'calendar' THEN np END), 6) AS behind,
       round(max(CASE WHEN strategy = 'threshold' THEN np END) - max(CASE WHEN strategy = 'calendar' THEN np END), 6)
           AS lead
FROM (SELECT strategy, season, avg(np) AS np
      FROM (SELECT strategy, run_id, season, avg(grain_tha * 3000 - spray_count * cost_per_spray) AS np
            FROM harvest GROUP BY 1, 2, 3) a GROUP BY 1, 2) b
WHERE strategy <> 'none' GROUP BY season""", "harvest"))
def _profit_lead(spark, folder):
    lead = joins.profit_lead(views.harvest(spark, folder))
    return lead.select("season", r6("ahead"), r6("behind"), r6("lead"))


_LOGS = """
SELECT 'rotation' AS log, run_id, avg(grain_tha) AS grain_tha FROM harvest
WHERE season = (SELECT max(season) FROM harvest) AND strategy = 'calendar' AND pesticide_choice <> 'starfarm' GROUP BY run_id
UNION ALL
SELECT 'single', run_id, avg(grain_tha) FROM harvest
WHERE season = (SELECT max(season) FROM harvest) AND strategy = 'calendar' AND pesticide_choice = 'starfarm' GROUP BY run_id"""


def _labelled(spark, folder):
    log = views.harvest(spark, folder).filter(F.col("strategy") == "calendar")
    parts = {
        "rotation": log.filter(F.col("pesticide_choice") != "starfarm"),
        "single": log.filter(F.col("pesticide_choice") == "starfarm"),
    }
    return joins.labelled_run_means(parts)


@plan("j5_cross_log_comparison", sql("SELECT * FROM logs", "harvest", logs=_LOGS))
def _cross_log(spark, folder):
    return _labelled(spark, folder)


@plan("j5_cross_log_test", sql(f"""
SELECT w.n_a, w.n_b, round(w.mean_diff, 6) AS mean_diff, round(w.t, 6) AS t, round(w.p, 6) + 0.0 AS p,
       u.u, round(u.z, 6) AS z, round(u.p, 6) + 0.0 AS p_rank
FROM ({T_P.format(source='welch')}) w, ({NORMAL_P.format(source='u_test')}) u""",
    "harvest", logs=_LOGS,
    welch=WELCH.format(by="1", group="log", a="rotation", b="single", value="grain_tha", source="logs"),
    u_test=U_TEST.format(by="1", group="log", a="rotation", b="single", value="grain_tha", source="logs")))
def _cross_log_test(spark, folder):
    # A key that is no literal, so that the tests below meet by an equality join.
    means = _labelled(spark, folder).withColumn("test", F.least(F.length("run_id"), F.lit(1)))
    by_t = welch(means, "log", "rotation", "single", "grain_tha", ["test"])
    by_rank = mann_whitney(means, "log", "rotation", "single", "grain_tha", ["test"])
    pair = by_t.select("test", "n_a", "n_b", r6("mean_diff"), r6("t"), r6("p")).join(
        by_rank.select("test", "u", r6("z"), r6("p", "p_rank")), "test"
    )
    return pair.drop("test")


@plan("j6_neighbour_mean", sql("""
SELECT s.run_id, s.season, s.plot_x, s.plot_y, s.pest_load, round(avg(n.pest_load), 6) AS neighbour_value,
       CAST(count(n.pest_load) AS BIGINT) AS n_neighbours
FROM grids s LEFT JOIN grids n ON s.run_id = n.run_id AND s.season = n.season AND abs(s.plot_x - n.plot_x) <= 1
     AND abs(s.plot_y - n.plot_y) <= 1 AND NOT (s.plot_x = n.plot_x AND s.plot_y = n.plot_y)
GROUP BY s.run_id, s.season, s.plot_x, s.plot_y, s.pest_load""", "grids"))
def _neighbours(spark, folder):
    found = spatial.neighbour_agg(views.grids(spark, folder), "pest_load", ("run_id", "season"))
    return found.select("run_id", "season", "plot_x", "plot_y", "pest_load", r6("neighbour_value"), "n_neighbours")


@plan("j7_stage_lookup", sql("""
SELECT h.plot_id, h.day, h.heat, s.stage, s.fapar, s.weight
FROM heated h JOIN stages s ON h.heat >= s.lo AND h.heat < s.hi""", "heated", "stages"))
def _stage_lookup(spark, folder):
    heated = heat_accumulation(views.plotday(spark, folder)).select("plot_id", "day", "heat")
    return joins.with_stage(heated)


_DESIGN_SQL = """
SELECT s AS strategy, p AS pesticide_choice, CAST(n AS INT) AS season, m AS immigration_rate
FROM (VALUES ('none'), ('calendar'), ('threshold')) a(s),
     (VALUES ('starfarm'), ('etofenprox'), ('copper')) b(p),
     (VALUES (CAST(0.05 AS DOUBLE)), (0.2), (0.4), (0.9)) c(m), range(1, 31) d(n)"""


@plan("j8_design_completeness", sql("""
SELECT strategy, pesticide_choice, immigration_rate, season, CAST(coalesce(n, 0) AS BIGINT) AS n_rows,
       CASE WHEN d.planned IS NULL THEN 'outside design' ELSE 'missing' END AS problem
FROM (SELECT strategy, pesticide_choice, immigration_rate, season, count(*) AS n FROM harvest GROUP BY ALL) h
FULL JOIN (SELECT *, true AS planned FROM cells) d USING (strategy, pesticide_choice, immigration_rate, season)
WHERE d.planned IS NULL OR n IS NULL""", "harvest", cells=_DESIGN_SQL))
def _completeness(spark, folder):
    cells = design(
        spark,
        {
            "strategy": ("none", "calendar", "threshold"),
            "pesticide_choice": ("starfarm", "etofenprox", "copper"),
            "immigration_rate": (0.05, 0.2, 0.4, 0.9),
        },
        repeat=1,
        seasons=30,
    )
    keys = ["strategy", "pesticide_choice", "immigration_rate", "season"]
    return completeness(views.harvest(spark, folder), cells, keys)


@plan("j9_diffusion_step", sql("""
SELECT s.run_id, s.plot_x, s.plot_y, round(coalesce(r.received, 0) + 3.7e-10, 6) AS received,
       round(least(1, s.pest_load - s.pest_load * 0.1 + coalesce(r.received, 0)) + 3.7e-10, 6) AS load_after
FROM snapshot s LEFT JOIN (
    SELECT t.run_id, t.plot_x, t.plot_y, sum(n.pest_load * CAST(0.1 AS DOUBLE) /
           (CASE WHEN n.plot_x IN (0, 9) AND n.plot_y IN (0, 9) THEN 3
                 WHEN n.plot_x IN (0, 9) OR n.plot_y IN (0, 9) THEN 5 ELSE 8 END)) AS received
    FROM snapshot t JOIN snapshot n ON t.run_id = n.run_id AND abs(t.plot_x - n.plot_x) <= 1
         AND abs(t.plot_y - n.plot_y) <= 1 AND NOT (t.plot_x = n.plot_x AND t.plot_y = n.plot_y)
    GROUP BY t.run_id, t.plot_x, t.plot_y) r USING (run_id, plot_x, plot_y)""", "snapshot"))
def _diffusion(spark, folder):
    after = spatial.diffuse(views.snapshot(spark, folder))
    return after.select("run_id", "plot_x", "plot_y", shifted6("received"), shifted6("load_after"))
