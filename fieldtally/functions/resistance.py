"""Resistance pools: growth per spray, decay between seasons, effect on a spray.

``pool_a`` belongs to the first rotation compound and ``pool_b`` to the second;
the default compound drives both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import as_column


def spray_factor(number) -> Column:
    """Weight of a spray by its lifetime number on the plot."""
    n = as_column(number)
    return (
        F.when(n <= fixed.EARLY_SPRAYS, fixed.EARLY_FACTOR)
        .when(n > fixed.LATE_SPRAYS, fixed.LATE_FACTOR)
        .otherwise(fixed.MIDDLE_FACTOR)
    )


def resistance_increment(pressure, number) -> Column:
    return as_column(pressure) * spray_factor(number)


def season_factor(before, sprays) -> Column:
    """Summed weight of ``sprays`` further sprays after ``before`` earlier ones."""
    start = as_column(before)
    end = start + as_column(sprays)
    early = F.least(end, F.lit(fixed.EARLY_SPRAYS)) - F.least(start, F.lit(fixed.EARLY_SPRAYS))
    late = F.greatest(end, F.lit(fixed.LATE_SPRAYS)) - F.greatest(start, F.lit(fixed.LATE_SPRAYS))
    middle = as_column(sprays) - early - late
    return (
        early * F.lit(fixed.EARLY_FACTOR) + middle * F.lit(fixed.MIDDLE_FACTOR) + late * F.lit(fixed.LATE_FACTOR)
    )


def effective_rf(compound, pool_a, pool_b, spillover: float = fixed.SPILLOVER) -> Column:
    """Resistance that a spray of ``compound`` meets."""
    a, b, name = as_column(pool_a), as_column(pool_b), as_column(compound)
    return (
        F.when(name == fixed.COMPOUND_A, F.least(F.lit(1.0), a + b * F.lit(spillover)))
        .when(name == fixed.COMPOUND_B, F.least(F.lit(1.0), b + a * F.lit(spillover)))
        .otherwise(F.greatest(a, b))
    )


def realized_efficacy(efficacy, rf) -> Column:
    return as_column(efficacy) * (F.lit(1.0) - as_column(rf))


def load_after_spray(load, realized) -> Column:
    return as_column(load) * (F.lit(1.0) - as_column(realized))


def boundary_decay(rf, immigration=fixed.IMMIGRATION_RATE, fitness_cost=fixed.FITNESS_COST) -> Column:
    """A pool after one season boundary."""
    return (
        as_column(rf)
        * (F.lit(1.0) - as_column(immigration))
        * (F.lit(1.0) - as_column(fitness_cost))
    )
