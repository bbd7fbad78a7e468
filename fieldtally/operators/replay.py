"""Ordered replays: columns whose every step depends on the last one.

The history of one plot is folded inside an array expression.  Such an array
holds one entry per season or per day of a plot, since the rows are reduced to
that first, so its length is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.resistance import effective_rf, season_factor


def season_ledger(
    log: DataFrame, plot: Sequence[str] = ("run_id", "strategy", "plot_x", "plot_y")
) -> DataFrame:
    """One row per plot and season, the form that the replays take.

    A log may repeat a plot and season; partial aggregates shrink the repeats
    before anything is shuffled.  The least compound name is found by its place
    among the sorted names that the log itself holds (a scalar subquery, so it is
    found once, as part of the same query): a minimum of strings would make Spark
    sort all rows instead of hashing them.
    """
    names = log.select(F.sort_array(F.collect_set("pesticide_choice"))).scalar()
    place = F.min(F.nullif(F.array_position(names, F.col("pesticide_choice")), F.lit(0)))
    found = log.groupBy(*plot, "season").agg(
        place.alias("_place"),
        F.max("spray_count").alias("spray_count"),
        F.avg("grain_tha").alias("grain_tha"),
        F.max("resistant_fraction").alias("resistant_fraction"),
        F.max("cost_per_spray").alias("cost_per_spray"),
    )
    compound = F.get(names, (F.col("_place") - 1).cast("int")).alias("pesticide_choice")
    return found.select(
        *plot, "season", compound, "spray_count", "grain_tha", "resistant_fraction", "cost_per_spray"
    )


def replay_rf(
    ledger: DataFrame,
    plot: Sequence[str] = ("run_id", "plot_x", "plot_y"),
    immigration: float = fixed.IMMIGRATION_RATE,
    fitness_cost: float = fixed.FITNESS_COST,
    spillover: float = fixed.SPILLOVER,
    reactive: bool = False,
) -> DataFrame:
    """Both resistance pools and the logged resistance after each season.

    ``ledger`` has one row per plot and season, as :func:`season_ledger` gives,
    with ``pesticide_choice``, ``selection_pressure`` and ``spray_count``.  Pools decay at every season
    boundary, also at those of seasons that were not logged.  With ``reactive``
    the compound of a season is chosen from the plot's own pools, the lower one
    winning and the first at a tie; that is exact where all plots of a run are
    sprayed alike.

    What does not depend on the pools (decay since the last row, gain of the
    season) is computed beforehand by windows over the same plots, so the fold
    itself is one multiplication, one sum and one cap per pool and the rows are
    shuffled once.
    """
    order = Window.partitionBy(*plot).orderBy("season")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    kept = (1.0 - immigration) * (1.0 - fitness_cost)
    before = F.coalesce(F.sum("spray_count").over(earlier), F.lit(0))
    gap = F.coalesce(F.col("season") - F.lag("season").over(order), F.lit(0))
    dosed = ledger.withColumns({"_before": before, "_gap": gap}).select(
        *plot,
        F.col("season").cast("int").alias("season"),
        F.col("pesticide_choice").alias("compound"),
        F.col("spray_count").cast("int").alias("sprays"),
        (F.col("selection_pressure") * season_factor("_before", "spray_count")).alias("gain"),
        F.pow(F.lit(kept), F.col("_gap").cast("double")).alias("kept"),
    )
    history = dosed.groupBy(*plot).agg(
        F.array_sort(F.collect_list(F.struct("season", "compound", "sprays", "gain", "kept"))).alias("_history")
    )
    line_type = "struct<season:int,compound:string,sprays:int,a:double,b:double>"
    start = F.array().cast(f"array<{line_type}>")

    def step(lines: Column, entry: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        a = F.coalesce(last["a"], F.lit(0.0)) * entry["kept"]
        b = F.coalesce(last["b"], F.lit(0.0)) * entry["kept"]
        compound = F.when(b < a, fixed.COMPOUND_B).otherwise(fixed.COMPOUND_A) if reactive else entry["compound"]
        line = F.struct(
            entry["season"].alias("season"),
            compound.alias("compound"),
            entry["sprays"].alias("sprays"),
            F.when(compound == fixed.COMPOUND_B, a).otherwise(F.least(F.lit(1.0), a + entry["gain"])).alias("a"),
            F.when(compound == fixed.COMPOUND_A, b).otherwise(F.least(F.lit(1.0), b + entry["gain"])).alias("b"),
        )
        return F.concat(lines, F.array(line))

    lines = history.select(*plot, F.explode(F.aggregate("_history", start, step)).alias("_line")).select(
        *plot, "_line.*"
    )
    met = effective_rf("compound", "a", "b", spillover)
    if immigration > 0.0 or fitness_cost > 0.0:
        # Decay sets the logged value to the larger pool; without sprays it stays there.
        logged = F.when(F.col("sprays") > 0, met).otherwise(F.greatest("a", "b"))
    else:
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sprayed = F.last(F.when(F.col("sprays") > 0, met), ignorenulls=True).over(so_far)
        logged = F.coalesce(sprayed, F.lit(0.0))
    return lines.select(
        *plot,
        "season",
        F.col("compound").alias("pesticide_choice"),
        F.col("sprays").alias("spray_count"),
        F.col("a").alias("pool_a"),
        F.col("b").alias("pool_b"),
        logged.alias("resistant_fraction"),
    )


def reactive_compound(pools: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Compound a reactive farmer takes in each season: the one whose mean pool
    over the field was lower at the end of the season before; the first at a tie
    and in the first season.  Decay scales both pools alike and changes nothing."""
    seasons = pools.groupBy(*run, "season").agg(
        F.avg("pool_a").alias("mean_a"), F.avg("pool_b").alias("mean_b")
    )
    order = Window.partitionBy(*run).orderBy("season")
    lower_b = F.lag("mean_b").over(order) < F.lag("mean_a").over(order)
    return seasons.withColumn(
        "reactive_choice", F.when(lower_b, fixed.COMPOUND_B).otherwise(fixed.COMPOUND_A)
    )


def spaced_days(
    df: DataFrame,
    candidate: Column,
    plot: Sequence[str] = ("plot_id",),
    day: str = "day",
    spacing: int = fixed.SPRAY_COOLDOWN,
    sown: int = 0,
) -> DataFrame:
    """Candidate days that lie at least ``spacing`` days after the last one taken,
    counted from sowing for the first."""
    days = (
        df.filter(candidate)
        .groupBy(*plot)
        .agg(F.sort_array(F.collect_set(F.col(day).cast("int"))).alias("_days"))
    )
    start = F.struct(F.lit(sown).alias("last"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, value: Column) -> Column:
        take = value - state["last"] >= spacing
        return F.struct(
            F.when(take, value).otherwise(state["last"]).alias("last"),
            F.when(take, F.concat(state["taken"], F.array(value))).otherwise(state["taken"]).alias("taken"),
        )

    taken = F.aggregate("_days", start, step, lambda s: s["taken"])
    return days.select(*plot, F.posexplode(taken).alias("_pos", day)).select(
        *plot, day, (F.col("_pos") + 1).alias("spray_number")
    )
