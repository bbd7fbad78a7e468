"""Audits of reported figures and logged decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import adaptive, audit
from fieldtally.operators.windows import run_seasons
from fieldtally.plans.base import plan, r6, sql
from fieldtally.plans.joins import COMPUTED_SQL, MEASURES, REPORTED_SQL, computed, reported
from fieldtally.plans.windows import BACKOFF
from fieldtally.sources import views

_KEYS = ["strategy", "season"]
_TOLERANCES = {"grain_tha": 0.3, "spray_count": 0.05, "resistant_fraction": 0.05}

_CHECKS = " UNION ALL ".join(
    f"""
SELECT strategy, season, '{m}' AS measure, r.{m} AS reported, c.{m} AS computed, abs(r.{m} - c.{m}) AS difference,
       CASE {"WHEN true THEN abs(r." + m + " - c." + m + ") < 0.5" if m == "spray_count" else ""}
            WHEN abs(c.{m}) < 1e-6 THEN abs(r.{m}) < {t}
            ELSE abs(r.{m} - c.{m}) / greatest(abs(c.{m}), 1e-6) < {t} END AS ok
FROM computed c JOIN reported r USING (strategy, season)"""
    for m, t in _TOLERANCES.items()
)
_AUDIT = {"computed": COMPUTED_SQL, "reported": REPORTED_SQL, "checks": _CHECKS}


def _checks(spark, folder):
    return audit.check(computed(spark, folder), reported(spark), _KEYS, _TOLERANCES, whole=["spray_count"])


@plan("q1_tolerance_check", sql("""
SELECT strategy, season, measure, reported, computed, round(difference, 6) AS difference, ok FROM checks""",
    "harvest", **_AUDIT))
def _tolerance_check(spark, folder):
    return _checks(spark, folder).withColumn("difference", r6("difference"))


@plan("q2_discrepancies", sql("""
SELECT strategy, season, measure, reported, computed, round(difference, 6) AS difference, ok
FROM checks WHERE NOT ok""", "harvest", **_AUDIT))
def _discrepancies(spark, folder):
    return audit.discrepancies(_checks(spark, folder)).withColumn("difference", r6("difference"))


@plan("q2_audit_verdict", sql("""
SELECT CAST(count(*) AS BIGINT) AS n_checks, CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) AS n_discrepancies,
       round(max(difference), 6) AS max_difference, bool_and(ok) AS passed
FROM checks""", "harvest", **_AUDIT))
def _audit_verdict(spark, folder):
    found = audit.audit_verdict(_checks(spark, folder))
    return found.withColumn("max_difference", r6("max_difference"))


@plan("q3_absolute_differences", sql("SELECT strategy, season, " + ", ".join(
    f"r.{m} AS {m}_reported, c.{m} AS {m}_computed, round(abs(r.{m} - c.{m}), 6) AS {m}_difference" for m in MEASURES
) + " FROM computed c JOIN reported r USING (strategy, season)", "harvest",
    computed=COMPUTED_SQL, reported=REPORTED_SQL))
def _differences(spark, folder):
    found = audit.absolute_differences(computed(spark, folder), reported(spark), _KEYS, MEASURES)
    for m in MEASURES:
        found = found.withColumn(f"{m}_difference", r6(f"{m}_difference"))
    return found


_LOGGED = """
SELECT run_id, strategy, season, CASE WHEN strategy = 'calendar' THEN least(28, 12 + 2 * season) ELSE 14 END
       AS calendar_interval,
       CASE WHEN strategy = 'threshold' THEN CAST(0.3 AS DOUBLE) + CASE WHEN season % 2 = 0 THEN 0.05 ELSE 0 END
            ELSE CAST(0.3 AS DOUBLE) END AS pesticide_threshold
FROM runs"""


@plan("q4_policy_audit", sql("""
SELECT run_id, season, CAST(calendar_interval AS INT) AS calendar_interval,
       round(pesticide_threshold, 6) AS pesticide_threshold, interval_in_force AS calendar_interval_replayed,
       round(threshold_in_force, 6) AS pesticide_threshold_replayed
FROM logged JOIN backoff USING (run_id, season)
WHERE calendar_interval <> interval_in_force OR abs(pesticide_threshold - threshold_in_force) > 1e-9""",
    "moves", backoff=BACKOFF, logged=_LOGGED))
def _policy_audit(spark, folder):
    seasons = run_seasons(views.harvest(spark, folder), ["strategy"])
    season, strategy = F.col("season"), F.col("strategy")
    bump = F.when(season % 2 == 0, 0.05).otherwise(0.0)
    logged = seasons.select(
        "run_id",
        "season",
        F.when(strategy == "calendar", F.least(F.lit(28), F.lit(12) + F.lit(2) * season))
        .otherwise(14)
        .alias("calendar_interval"),
        F.when(strategy == "threshold", F.lit(0.3) + bump).otherwise(0.3).alias("pesticide_threshold"),
    )
    wrong = audit.policy_audit(
        logged,
        adaptive.backoff(seasons),
        ["run_id", "season"],
        {"calendar_interval": "interval_in_force", "pesticide_threshold": "threshold_in_force"},
    )
    return wrong.select(
        "run_id", "season", "calendar_interval", r6("pesticide_threshold"),
        "calendar_interval_replayed", r6("pesticide_threshold_replayed"),
    )


@plan("q5_vacuous_tolerances", sql("""
SELECT strategy, season, c.grain_tha AS computed, r.grain_tha AS reported, tolerance,
       abs(r.grain_tha - c.grain_tha) / greatest(abs(c.grain_tha), 1e-6) < tolerance AS would_pass
FROM computed c JOIN (SELECT *, CAST(CASE season WHEN 1 THEN 0.02 WHEN 2 THEN 5 ELSE 50 END AS DOUBLE) AS tolerance
                      FROM reported) r USING (strategy, season)
WHERE tolerance >= 1""", "harvest", computed=COMPUTED_SQL, reported=REPORTED_SQL))
def _vacuous(spark, folder):
    limit = F.when(F.col("season") == 1, 0.02).when(F.col("season") == 2, 5.0).otherwise(50.0)
    told = reported(spark).select(
        "strategy", "season", F.col("grain_tha").alias("reported"), limit.alias("tolerance")
    )
    found = computed(spark, folder).select("strategy", "season", F.col("grain_tha").alias("computed"))
    loose = audit.vacuous_tolerances(told)
    pairs = audit.reconcile(found, loose, _KEYS)
    return pairs.withColumn("would_pass", audit.within_tolerance("reported", "computed", F.col("tolerance")))
