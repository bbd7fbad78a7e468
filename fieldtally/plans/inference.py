"""Hypothesis tests.

The SQL side computes tail probabilities on its own, by Simpson's rule over the
density, so it also checks the p-values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.keys import run_number
from fieldtally.operators import inference
from fieldtally.operators.ranks import average_rank
from fieldtally.operators.summaries import run_means, run_season_means, run_total
from fieldtally.plans.base import plan, r6, sql
from fieldtally.session import durable
from fieldtally.sources import views

WELCH = """
SELECT {by} AS test, n_a, n_b, mean_a, mean_b, mean_a - mean_b AS mean_diff,
       (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS t,
       pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df
FROM (SELECT {by}, CAST(count(CASE WHEN {group} = '{a}' THEN {value} END) AS BIGINT) AS n_a,
             CAST(count(CASE WHEN {group} = '{b}' THEN {value} END) AS BIGINT) AS n_b,
             avg(CASE WHEN {group} = '{a}' THEN {value} END) AS mean_a,
             avg(CASE WHEN {group} = '{b}' THEN {value} END) AS mean_b,
             var_samp(CASE WHEN {group} = '{a}' THEN {value} END) AS va,
             var_samp(CASE WHEN {group} = '{b}' THEN {value} END) AS vb
      FROM {source} GROUP BY ALL) x"""

U_TEST = """
SELECT {by} AS test, n_a, n_b, r - n_a * (n_a + 1) / 2 AS u,
       (r - n_a * (n_a + 1) / 2 - n_a * n_b / 2 - 0.5)
       / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z
FROM (SELECT {by}, CAST(count(CASE WHEN grp = '{a}' THEN 1 END) AS DOUBLE) AS n_a,
             CAST(count(CASE WHEN grp = '{b}' THEN 1 END) AS DOUBLE) AS n_b,
             sum(CASE WHEN grp = '{a}' THEN place END) AS r, sum(CAST(m * m - 1 AS DOUBLE)) AS ties
      FROM (SELECT {by}, {group} AS grp, count(*) OVER (PARTITION BY {by}, {value}) AS m,
                   rank() OVER (PARTITION BY {by} ORDER BY {value})
                   + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 AS place
            FROM {source} WHERE {group} IN ('{a}', '{b}') AND {value} IS NOT NULL) y
      GROUP BY ALL) x"""

# Simpson's rule with 4000 steps between 0 and the statistic.
T_P = """
SELECT s.*, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * area) AS p
FROM {source} s JOIN (
    SELECT test AS k, least(abs(t), 100) / 4000 / 3 * sum(
               (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * pow(1 + pow(least(abs(t), 100) * i / 4000, 2) / df, -(df + 1) / 2)) AS area
    FROM {source}, range(0, 4001) g(i) GROUP BY test, t, df) q ON s.test = q.k"""

NORMAL_P = """
SELECT s.*, greatest(0, 0.5 - sign(z) * area / sqrt(2 * pi())) AS p
FROM {source} s JOIN (
    SELECT test AS k, least(abs(z), 40) / 4000 / 3 * sum(
               (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * exp(-pow(least(abs(z), 40) * i / 4000, 2) / 2)) AS area
    FROM {source}, range(0, 4001) g(i) GROUP BY test, z) q ON s.test = q.k"""

SPEARMAN = """
SELECT test, CAST(n AS BIGINT) AS n, rho, CAST(n - 2 AS DOUBLE) AS df, rho * sqrt((n - 2) / (1 - rho * rho)) AS t
FROM (SELECT test, count(*) AS n, corr(rx, ry) AS rho
      FROM (SELECT {by} AS test,
                   rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0
                       AS rx,
                   rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2.0
                       AS ry
            FROM {source}) r GROUP BY test) c"""

_BY_SEASON = {
    "by": "season", "group": "strategy", "a": "threshold", "b": "calendar", "value": "grain_tha",
    "source": "run_season",
}
_PAIR = ("strategy", "threshold", "calendar")


def _run_seasons(spark, folder):
    return run_season_means(views.harvest(spark, folder), ["strategy"], ["grain_tha"])


@plan("t1_welch", sql(f"""
SELECT test AS season, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(df, 6) AS df,
       round(p, 6) + 0.0 AS p
FROM ({T_P.format(source='tests')}) f""", "run_season", tests=WELCH.format(**_BY_SEASON)))
def _welch(spark, folder):
    tests = inference.welch(_run_seasons(spark, folder), *_PAIR, "grain_tha", ["season"])
    return tests.select(
        "season", "n_a", "n_b", r6("mean_a"), r6("mean_b"), r6("mean_diff"), r6("t"), r6("df"), r6("p")
    )


@plan("t2_mann_whitney", sql(f"""
SELECT test AS season, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(u AS DOUBLE) AS u,
       round(z, 6) AS z, round(p, 6) + 0.0 AS p
FROM ({NORMAL_P.format(source='tests')}) f""", "run_season", tests=U_TEST.format(**_BY_SEASON)))
def _mann_whitney(spark, folder):
    tests = inference.mann_whitney(_run_seasons(spark, folder), *_PAIR, "grain_tha", ["season"])
    return tests.select("season", "n_a", "n_b", "u", r6("z"), r6("p"))


_RHO = SPEARMAN.format(by="strategy", x="immigration_rate", y="profit", source="run_profit")


@plan("t3_spearman", sql(f"""
SELECT test AS strategy, n, round(rho, 6) AS rho, df, round(t, 6) AS t, round(p, 6) + 0.0 AS p
FROM ({T_P.format(source='tests')}) f""", "run_profit", tests=_RHO))
def _spearman(spark, folder):
    runs = run_total(views.harvest(spark, folder), ["strategy", "immigration_rate"])
    tests = inference.spearman(runs, "immigration_rate", "profit", ["strategy"])
    return tests.select("strategy", "n", r6("rho"), "df", r6("t"), r6("p"))


_VERDICT = "CASE WHEN p < 0.05 THEN 'reject' WHEN p IS NOT NULL THEN 'fail to reject' END"


@plan("t4_verdicts", sql(f"""
SELECT 'welch' AS test, CAST(season AS VARCHAR) AS claim, round(effect, 6) AS effect, verdict FROM (
    SELECT test AS season, mean_diff AS effect, {_VERDICT} AS verdict FROM ({T_P.format(source='welch')}) f) a
UNION ALL
SELECT 'mann-whitney', CAST(test AS VARCHAR), round(u / (n_a * n_b), 6), {_VERDICT}
FROM ({NORMAL_P.format(source='u_test')}) g
UNION ALL
SELECT 'spearman', test, round(rho, 6), {_VERDICT} FROM ({T_P.format(source='rho_test')}) h""",
    "run_season", "run_profit", welch=WELCH.format(**_BY_SEASON), u_test=U_TEST.format(**_BY_SEASON),
    rho_test=_RHO))
def _verdicts(spark, folder):
    # Two tests read the run means, so they are written once.
    seasons = durable(_run_seasons(spark, folder))
    runs = run_total(views.harvest(spark, folder), ["strategy", "immigration_rate"])
    welch = inference.welch(seasons, *_PAIR, "grain_tha", ["season"])
    ranks = inference.mann_whitney(seasons, *_PAIR, "grain_tha", ["season"])
    rho = inference.spearman(runs, "immigration_rate", "profit", ["strategy"])

    def shown(tests, name, claim, effect):
        return inference.with_verdict(tests).select(
            F.lit(name).alias("test"), F.col(claim).cast("string").alias("claim"), r6(effect, "effect"), "verdict"
        )

    return (
        shown(welch, "welch", "season", F.col("mean_diff"))
        .unionByName(shown(ranks, "mann-whitney", "season", F.col("u") / (F.col("n_a") * F.col("n_b"))))
        .unionByName(shown(rho, "spearman", "strategy", F.col("rho")))
    )


# Four claims, each from plot rows to its verdict.
_FIRST = "SELECT 1 AS test, strategy, avg(grain_tha) AS g FROM harvest WHERE season = 1 GROUP BY run_id, strategy"


def _claim_sql(tests: str, ranks: str) -> str:
    return f"""
SELECT CAST(t.n_a AS BIGINT) AS n_a, CAST(t.n_b AS BIGINT) AS n_b, round(t.mean_diff, 6) AS mean_diff,
       round(t.p, 6) + 0.0 AS p, {_VERDICT.replace('p ', 't.p ')} AS verdict,
       round(u.p, 6) + 0.0 AS p_rank, {_VERDICT.replace('p ', 'u.p ')} AS verdict_rank
FROM ({T_P.format(source=tests)}) t, ({NORMAL_P.format(source=ranks)}) u"""


def _claim(runs, group, a, b, value):
    """Welch and rank test of one claim, on one row per run."""
    runs = durable(runs.withColumn("claim", F.lit(1)))
    t = inference.with_verdict(inference.welch(runs, group, a, b, value, ["claim"]))
    u = inference.with_verdict(inference.mann_whitney(runs, group, a, b, value, ["claim"]))
    return (
        t.select("claim", "n_a", "n_b", r6("mean_diff"), r6("p"), "verdict")
        .join(u.select("claim", r6("p", "p_rank"), F.col("verdict").alias("verdict_rank")), "claim")
        .drop("claim")
    )


_GRAIN = {"by": "test", "group": "strategy", "a": "threshold", "b": "calendar", "value": "g", "source": "first"}


@plan("h1a_threshold_grain", sql(_claim_sql("w", "m"), "harvest", first=_FIRST, w=WELCH.format(**_GRAIN),
                                 m=U_TEST.format(**_GRAIN)))
def _threshold_grain(spark, folder):
    runs = run_means(views.harvest(spark, folder), ["strategy"], season=1)
    return _claim(runs, *_PAIR, "grain_tha")


_MODES = """
SELECT 1 AS test, CASE WHEN mode THEN 'on' ELSE 'off' END AS mode, profit
FROM (SELECT run_id, CAST(split_part(run_id, '_', 2) AS INT) % 2 = 0 AS mode,
             sum(grain_tha * 3000 - spray_count * cost_per_spray) AS profit
      FROM harvest WHERE strategy = 'calendar' GROUP BY run_id) r"""
_MODE = {"by": "test", "group": "mode", "a": "on", "b": "off", "value": "profit", "source": "modes"}


@plan("h1b_backoff_profit", sql(_claim_sql("w", "m"), "harvest", modes=_MODES, w=WELCH.format(**_MODE),
                                m=U_TEST.format(**_MODE)))
def _backoff_profit(spark, folder):
    log = views.harvest(spark, folder).filter(F.col("strategy") == "calendar")
    log = log.withColumn("adaptive_profit_mode", run_number("run_id") % 2 == 0)
    runs = run_total(log, ["adaptive_profit_mode"])
    return _claim(runs, "adaptive_profit_mode", True, False, "profit")


# The claim as it is made: only runs that are calendar and rotate when resistance shows, of a
# log that holds both flags.
_REACTIVE_MODES = """
SELECT 1 AS test, CASE WHEN n % 2 = 0 THEN 'on' ELSE 'off' END AS mode, profit
FROM (SELECT run_id, CAST(split_part(run_id, '_', 2) AS INT) AS n,
             sum(grain_tha * 3000 - spray_count * cost_per_spray) AS profit
      FROM harvest WHERE strategy = 'calendar' GROUP BY run_id) r
WHERE n // 2 % 2 = 0"""


@plan("h1b_reactive_backoff_profit", sql(_claim_sql("w", "m"), "harvest", modes=_REACTIVE_MODES,
                                         w=WELCH.format(**_MODE), m=U_TEST.format(**_MODE)))
def _reactive_backoff_profit(spark, folder):
    number = run_number("run_id")
    log = views.harvest(spark, folder).withColumns(
        {"adaptive_profit_mode": number % 2 == 0, "rotation_reactive": F.floor(number / 2) % 2 == 0}
    )
    log = log.filter((F.col("strategy") == "calendar") & F.col("rotation_reactive"))
    return _claim(run_total(log, ["adaptive_profit_mode"]), "adaptive_profit_mode", True, False, "profit")


@plan("h1d_immigration_profit", sql(f"""
SELECT n, round(rho, 6) AS rho, round(p, 6) + 0.0 AS p, {_VERDICT} AS verdict
FROM ({T_P.format(source='rho_test')}) f""", "run_profit", all_runs="SELECT 1 AS one, * FROM run_profit",
    rho_test=SPEARMAN.format(by="one", x="immigration_rate", y="profit", source="all_runs")))
def _immigration_profit(spark, folder):
    runs = run_total(views.harvest(spark, folder), ["immigration_rate"])
    tests = inference.with_verdict(inference.spearman(runs, "immigration_rate", "profit"))
    return tests.select("n", r6("rho"), r6("p"), "verdict")


@plan("t5_replication_unit", sql("""
SELECT run_id, strategy, season, CAST(count(*) AS BIGINT) AS n_rows
FROM harvest GROUP BY run_id, strategy, season HAVING count(*) > 1""", "harvest"))
def _replication_unit(spark, folder):
    # What the tests refuse: the log itself, whose rows are plots and not runs.
    return inference.repeated_runs(views.harvest(spark, folder), ["strategy", "season"])


@plan("w15_average_rank", sql("""
SELECT strategy, run_id, season, plot_x, plot_y, grain_tha,
       rank() OVER (PARTITION BY strategy ORDER BY grain_tha)
       + (count(*) OVER (PARTITION BY strategy, grain_tha) - 1) / CAST(2 AS DOUBLE) AS rank
FROM harvest""", "harvest"))
def _average_rank(spark, folder):
    rows = views.harvest(spark, folder).select("strategy", "run_id", "season", "plot_x", "plot_y", "grain_tha")
    return average_rank(rows, ["strategy"], "grain_tha")
