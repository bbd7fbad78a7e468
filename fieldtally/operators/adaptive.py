"""Rules by which a farmer changes plans from season to season.

A log row shows the value in force *during* its season, so a trigger at the end
of a season shows in the next row, and the trigger of the last season nowhere.
The rules only ever move one way (or round a cycle), so the value in force
follows from the number of triggers so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.operators.windows import profit_change


def _triggers_before(flag: Column, run: Sequence[str]) -> Column:
    earlier = Window.partitionBy(*run).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(earlier), F.lit(0))


def _moved(start: float | int, moves: Column, step: float | int, limit: float | int) -> Column:
    """``start`` moved by signed steps, not beyond ``limit`` in that direction."""
    value = F.lit(start) + F.lit(step) * moves
    if step > 0:
        return F.lit(start) if start >= limit else F.least(F.lit(limit), value)
    return F.lit(start) if start <= limit else F.greatest(F.lit(limit), value)


def _trajectory(
    seasons: DataFrame,
    run: Sequence[str],
    start_interval: int,
    start_threshold: float,
    interval_step: int,
    interval_limit: int,
    threshold_step: float,
    threshold_limit: float,
) -> DataFrame:
    moves = profit_change(seasons, run).withColumn("declines_before", _triggers_before(F.col("declined"), run))
    n = F.col("declines_before")
    interval = _moved(start_interval, n, interval_step, interval_limit)
    threshold = _moved(start_threshold, n, threshold_step, threshold_limit)
    return moves.withColumn(
        "interval_in_force",
        F.when(F.col("strategy") == "calendar", interval).otherwise(F.lit(start_interval)).cast("int"),
    ).withColumn(
        "threshold_in_force",
        F.when(F.col("strategy") == "threshold", threshold).otherwise(F.lit(start_threshold)),
    )


def backoff(
    seasons: DataFrame,
    run: Sequence[str] = ("run_id",),
    start_interval: int = fixed.SPRAY_INTERVAL,
    start_threshold: float = fixed.SPRAY_THRESHOLD,
) -> DataFrame:
    """Interval and threshold of a farmer who eases off after each decline.

    ``seasons`` has one row per run and season, as ``run_seasons`` gives, with
    the run's strategy.
    """
    return _trajectory(
        seasons, run, start_interval, start_threshold,
        fixed.INTERVAL_STEP, fixed.INTERVAL_CAP, fixed.THRESHOLD_STEP, fixed.THRESHOLD_CAP,
    )


def escalation(
    seasons: DataFrame,
    run: Sequence[str] = ("run_id",),
    start_interval: int = fixed.SPRAY_INTERVAL,
    start_threshold: float = fixed.SPRAY_THRESHOLD,
) -> DataFrame:
    """Interval and threshold of a farmer who sprays harder after each decline."""
    return _trajectory(
        seasons, run, start_interval, start_threshold,
        -fixed.INTERVAL_STEP, fixed.INTERVAL_FLOOR, -fixed.THRESHOLD_STEP, fixed.THRESHOLD_FLOOR,
    )


def resistance_trigger(
    rf: str = "mean_rf",
    limit: float = fixed.SWAP_RF,
    immigration: float = fixed.IMMIGRATION_RATE,
    fitness_cost: float = fixed.FITNESS_COST,
) -> Column:
    """Whether the field's mean resistance exceeds the limit.

    The rule looks after the decay of the season boundary, the log shows the
    value before it.
    """
    return F.col(rf) * F.lit((1.0 - immigration) * (1.0 - fitness_cost)) > F.lit(limit)


def strategy_swaps(
    seasons: DataFrame,
    trigger: Column | None = None,
    run: Sequence[str] = ("run_id",),
    start: str = "strategy",
) -> DataFrame:
    """Strategy in force when each trigger moves the farmer one place on in the
    cycle calendar, threshold, none.  The trigger defaults to a profit decline."""
    moves = profit_change(seasons, run)
    flag = F.col("declined") if trigger is None else trigger
    counted = moves.withColumn("swaps_before", _triggers_before(flag, run))
    cycle = F.array(*[F.lit(s) for s in fixed.SWAP_CYCLE])
    first = F.array_position(cycle, F.col(start)) - 1
    place = F.pmod(first + F.col("swaps_before"), F.lit(len(fixed.SWAP_CYCLE)))
    return counted.withColumn("strategy_in_force", F.element_at(cycle, (place + 1).cast("int")))
