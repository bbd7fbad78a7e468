"""Experiment designs against the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.keys import run_number
from fieldtally.operators import design
from fieldtally.plans.base import plan, sql
from fieldtally.sources import views

_CELLS = """
SELECT s AS strategy, CAST(r AS INT) AS repeat, CAST(n AS INT) AS season, CAST(100 AS BIGINT) AS expected_rows
FROM (VALUES ('none'), ('calendar'), ('threshold')) a(s), range(0, 40) b(r), range(1, 9) c(n)"""


def _cells(spark):
    return design.design(spark, {"strategy": ("none", "calendar", "threshold")}, repeat=40, seasons=8, plots=100)


@plan("m1_factorial_design", sql("""
SELECT strategy, repeat, season, expected_rows, CAST(coalesce(n, 0) AS BIGINT) AS logged_rows
FROM cells LEFT JOIN (SELECT strategy, CAST(split_part(run_id, '_', 2) AS INT) AS repeat, season, count(*) AS n
                      FROM harvest GROUP BY ALL) h USING (strategy, repeat, season)""", "harvest", cells=_CELLS))
def _factorial(spark, folder):
    counts = views.harvest(spark, folder).groupBy("strategy", "run_id", "season").agg(
        F.count(F.lit(1)).alias("logged_rows")
    )
    logged = counts.select("strategy", run_number("run_id").alias("repeat"), "season", "logged_rows")
    filled = _cells(spark).join(logged, ["strategy", "repeat", "season"], "left")
    return filled.withColumn("logged_rows", F.coalesce("logged_rows", F.lit(0)))


@plan("a22_balance", sql("""
SELECT strategy, season, CAST(coalesce(n, 0) AS BIGINT) AS n_rows, CAST(coalesce(e, 0) AS BIGINT) AS expected_rows,
       CAST(coalesce(n, 0) - coalesce(e, 0) AS BIGINT) AS surplus, coalesce(n, 0) = coalesce(e, 0) AS balanced
FROM (SELECT strategy, season, count(*) AS n FROM harvest GROUP BY ALL) h
FULL JOIN (SELECT strategy, season, sum(expected_rows) AS e FROM cells GROUP BY ALL) c USING (strategy, season)""",
    "harvest", cells=_CELLS))
def _balance(spark, folder):
    return design.balance(views.harvest(spark, folder), _cells(spark), ["strategy", "season"])


# The patterns again, by another rule: all texts of two letters, constant and repeating ones struck out.
_ENUMERATED = """
SELECT p AS rotation_pattern FROM (
    SELECT a || b AS p FROM letters x(a), letters y(b)
    UNION ALL SELECT a || b || c FROM letters x(a), letters y(b), letters z(c)
    UNION ALL SELECT a || b || c || d FROM letters x(a), letters y(b), letters z(c), letters w(d)) t
WHERE contains(p, 'A') AND contains(p, 'B') AND p <> repeat(substr(p, 1, 2), 2)"""


@plan("m2_rotation_patterns", sql("""
SELECT rotation_pattern, CAST(sum(n) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(CASE WHEN pesticide_choice = CASE WHEN substr(rotation_pattern,
            CAST((season - 1 + 12) % length(rotation_pattern) + 1 AS INT), 1) = 'B'
            THEN 'neonicotinoid' ELSE 'etofenprox' END THEN n END), 0) AS BIGINT) AS n_agree
FROM patterns, (SELECT season, pesticide_choice, count(*) AS n FROM harvest GROUP BY ALL) h
GROUP BY rotation_pattern""", "harvest", letters="SELECT * FROM (VALUES ('A'), ('B')) t(l)", patterns=_ENUMERATED))
def _patterns(spark, folder):
    return design.pattern_agreement(views.harvest(spark, folder))
