"""Crop stage, daily growth and pest pressure of a plot day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import as_column, as_measure


def heat_units(t_mean="t_mean", base: float = fixed.BASE_TEMPERATURE) -> Column:
    return F.greatest(F.lit(0.0), as_column(t_mean) - F.lit(base))


def growth_stage(heat, rows=fixed.STAGE_ROWS) -> Column:
    """Stage number of accumulated heat units; a stage starts at its lower bound."""
    total = as_measure(heat)
    first, *later = rows
    stage = F.when(total.isNotNull(), F.lit(first[0]))
    for row in later:
        stage = F.when(total >= F.lit(row[1]), F.lit(row[0])).otherwise(stage)
    return stage


def _by_stage(heat, position: int) -> Column:
    total = as_measure(heat)
    value = F.when(total.isNotNull(), F.lit(fixed.STAGE_ROWS[-1][position]))
    for row in reversed(fixed.STAGE_ROWS[:-1]):
        value = F.when(total < F.lit(row[2]), F.lit(row[position])).otherwise(value)
    return value


def light_share(heat) -> Column:
    return _by_stage(heat, 3)


def damage_weight(heat) -> Column:
    return _by_stage(heat, 4)


def growth_factor(load, weight, floor: float = fixed.MIN_GROWTH) -> Column:
    return F.greatest(F.lit(floor), F.lit(1.0) - as_column(weight) * as_column(load))


def potential_growth(radiation, share, light_use: float = fixed.LIGHT_USE) -> Column:
    return F.lit(light_use) * as_column(radiation) * as_column(share)


def load_band(load="pest_load", has_crop=True) -> Column:
    """Named band of pest load; the healthy band excludes its upper limit, the
    light and moderate bands include theirs.  A missing load has no band."""
    value = as_measure(load)
    return (
        F.when(~as_column(has_crop), "fallow")
        .when(value < fixed.BAND_HEALTHY, "healthy")
        .when(value <= fixed.BAND_LIGHT, "light")
        .when(value <= fixed.BAND_MODERATE, "moderate")
        .when(value > fixed.BAND_MODERATE, "overwhelmed")
    )


def infection_day(humidity="humidity", t_mean="t_mean", is_source=True) -> Column:
    """Whether the weather lets a source plot gain new pest load."""
    return (
        as_column(is_source)
        & (as_column(humidity) > fixed.HUMIDITY_LIMIT)
        & (as_column(t_mean) > fixed.TEMPERATURE_LIMIT)
    )
