"""Registry of plans and the SQL text of the log views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.sources.contracts import Contract

Plan = Callable[[SparkSession, str], DataFrame]

#: Contract of the harvest view.
HARVEST_LOG = Contract(
    "harvest_view",
    ("run_id", "strategy", "pesticide_choice", "immigration_rate", "season", "plot_x", "plot_y", "grain_tha",
     "pest_loss_tha", "spray_count", "resistant_fraction", "cost_per_spray"),
    ("strategy", "pesticide_choice"),
)
IDS = list(HARVEST_LOG.id_columns)


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(function: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"plan {name!r} is registered twice")
        REGISTRY[name] = Entry(name, function, sql)
        return function

    return keep


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six places: for results whose last bits depend on the order of
    addition."""
    source = F.col(column) if isinstance(column, str) else column
    rounded = F.round(source, 6)
    return rounded.alias(name or column) if (name or isinstance(column, str)) else rounded


#: Products of short decimals may lie right between two roundings; a small shift
#: on both sides keeps them clear of that.
SHIFT = 3.7e-10


def shifted6(column: str | Column, name: str | None = None) -> Column:
    """As :func:`r6`, for sums and products of short decimals."""
    source = F.col(column) if isinstance(column, str) else column
    return F.round(source + F.lit(SHIFT), 6).alias(name or column)


# Each view: the views it reads, then its text.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "harvest": ((), """
SELECT concat(strategy, '_', CAST(run_no AS VARCHAR)) AS run_id, strategy, pesticide_choice,
       immigration_rate, season, plot_x, plot_y, grain_tha, pest_loss_tha,
       CAST(CASE WHEN strategy = 'none' THEN 0 ELSE ln END AS INT) AS spray_count,
       CAST(floor(1024 * CASE strategy WHEN 'none' THEN CAST(0 AS DOUBLE)
            WHEN 'calendar' THEN least(CAST(1 AS DOUBLE), season * (CAST(0.18 AS DOUBLE) + disc / 10) * cmult)
            ELSE least(CAST(1 AS DOUBLE), season * (CAST(0.34 AS DOUBLE) + disc / 10) * cmult) END) / 1024
            AS DOUBLE) AS resistant_fraction,
       CAST(CASE WHEN pesticide_choice = 'etofenprox' THEN 110.625 ELSE 100.0 END AS DOUBLE) AS cost_per_spray
FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'calendar' ELSE 'threshold' END AS strategy,
             CAST(l_suppkey % 40 AS INT) AS run_no,
             CASE l_suppkey % 3 WHEN 0 THEN 'starfarm' WHEN 1 THEN 'etofenprox' ELSE 'neonicotinoid' END
                 AS pesticide_choice,
             CAST(CASE l_suppkey % 3 WHEN 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS cmult,
             CAST(CASE l_suppkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 ELSE 0.7 END AS DOUBLE)
                 AS immigration_rate,
             CAST(year(l_shipdate) - 1994 AS INT) AS season,
             CAST(l_partkey % 10 AS INT) AS plot_x,
             CAST(floor((l_partkey % 100) / 10) AS INT) AS plot_y,
             CAST(floor(l_extendedprice / 20000 * 1024) / 1024 AS DOUBLE) AS grain_tha,
             CAST(floor(l_tax * 20 * 1024) / 1024 AS DOUBLE) AS pest_loss_tha,
             l_linenumber AS ln, l_discount AS disc
      FROM lineitem) t"""),
    "daily": ((), """
SELECT user_id AS plot_id, CAST(dayofyear(ts) AS INT) AS day,
       CAST(least(1024, floor(max(value) / 200 * 1024)) / 1024 AS DOUBLE) AS pest_load,
       CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS sprayed
FROM events GROUP BY user_id, dayofyear(ts)"""),
    "plotday": (("daily",), """
SELECT plot_id, day, pest_load, sprayed,
       CAST(40 + plot_id % 25 + day % 5 AS DOUBLE) AS t_mean,
       CAST(18 AS DOUBLE) AS solar_rad,
       CAST(70 + (plot_id * 7 + day) % 25 AS DOUBLE) AS humidity
FROM daily"""),
    "heated": (("plotday",), """
SELECT *, sum(greatest(CAST(0 AS DOUBLE), t_mean - 10)) OVER (PARTITION BY plot_id ORDER BY day
       ROWS UNBOUNDED PRECEDING) AS heat
FROM plotday"""),
    "ledger": (("harvest",), """
SELECT run_id, strategy, plot_x, plot_y, season,
       min(pesticide_choice) AS pesticide_choice, max(spray_count) AS spray_count,
       avg(grain_tha) AS grain_tha, max(resistant_fraction) AS resistant_fraction,
       max(cost_per_spray) AS cost_per_spray
FROM harvest GROUP BY run_id, strategy, plot_x, plot_y, season"""),
    "snapshot": (("harvest",), """
SELECT run_id, plot_x, plot_y,
       CAST(least(1024, floor(max(pest_loss_tha) / 2 * 1024)) / 1024 AS DOUBLE) AS pest_load
FROM harvest WHERE season = 3 GROUP BY run_id, plot_x, plot_y"""),
    "grids": (("harvest",), """
SELECT run_id, season, plot_x, plot_y,
       CAST(least(1024, floor(max(pest_loss_tha) / 2 * 1024)) / 1024 AS DOUBLE) AS pest_load
FROM harvest GROUP BY run_id, season, plot_x, plot_y"""),
    "compounds": ((), """
SELECT CAST(c AS VARCHAR) AS compound, CAST(e AS DOUBLE) AS efficacy, CAST(s AS DOUBLE) AS selection_pressure,
       CAST(k AS DOUBLE) AS cost
FROM (VALUES ('etofenprox', 0.7, 0.015, 110.6), ('neonicotinoid', 0.8, 0.025, 100.0)) t(c, e, s, k)"""),
    "stages": ((), """
SELECT CAST(n AS INT) AS stage, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(f AS DOUBLE) AS fapar,
       CAST(w AS DOUBLE) AS weight
FROM (VALUES (1, 0, 70, 0.2, 0.7), (2, 70, 920, 0.7, 0.6), (3, 920, 1350, 0.9, 0.5),
             (4, 1350, 1000000000, 0.85, 0.3)) t(n, lo, hi, f, w)"""),
    "seasons": (("harvest",), """
SELECT strategy, pesticide_choice, season, avg(grain_tha) AS grain_tha, avg(pest_loss_tha) AS pest_loss_tha,
       avg(resistant_fraction) AS resistant_fraction, avg(spray_count) AS spray_count,
       avg(cost_per_spray) AS cost_per_spray,
       avg(grain_tha * 3000 - spray_count * cost_per_spray) AS net_profit
FROM harvest GROUP BY strategy, pesticide_choice, season"""),
    "balanced": (("harvest",), """
SELECT strategy, pesticide_choice, season, avg(np) AS net_profit
FROM (SELECT strategy, pesticide_choice, run_id, season,
             avg(grain_tha * 3000 - spray_count * cost_per_spray) AS np
      FROM harvest GROUP BY strategy, pesticide_choice, run_id, season) t
GROUP BY strategy, pesticide_choice, season"""),
    "runs": (("harvest",), """
SELECT run_id, strategy, season, sum(grain_tha * 3000) AS revenue, sum(spray_count * cost_per_spray) AS spray_cost,
       sum(grain_tha * 3000 - spray_count * cost_per_spray) AS profit, avg(resistant_fraction) AS mean_rf
FROM harvest GROUP BY run_id, strategy, season"""),
    "felt": (("runs",), """
SELECT *, profit + CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY season) = 1
                        THEN 5000 ELSE 0 END AS felt_profit
FROM runs"""),
    "changes": (("felt",), """
SELECT *, felt_profit < previous_profit AS declined
FROM (SELECT *, coalesce(lag(felt_profit) OVER (PARTITION BY run_id ORDER BY season), 0) AS previous_profit
      FROM felt) t"""),
    "moves": (("changes",), """
SELECT *, CAST(coalesce(sum(CASE WHEN declined THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY season
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS declines_before
FROM changes"""),
    "run_season": (("harvest",), """
SELECT run_id, strategy, season, avg(grain_tha) AS grain_tha FROM harvest GROUP BY run_id, strategy, season"""),
    "run_profit": (("harvest",), """
SELECT run_id, strategy, immigration_rate, sum(grain_tha * 3000 - spray_count * cost_per_spray) AS profit
FROM harvest GROUP BY run_id, strategy, immigration_rate"""),
}


def sql(body: str, *views: str, recursive: bool = False, **extra: str) -> str:
    """``body`` under the named views and the views those read; ``extra`` adds
    further named subqueries after them."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in parts:
            return
        before, text = _VIEWS[name]
        for other in before:
            need(other)
        parts[name] = text.strip()

    for view in views:
        need(view)
    parts.update({name: text.strip() for name, text in extra.items()})
    if not parts:
        return body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + body.strip()
