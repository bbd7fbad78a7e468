"""Which compound is scheduled, and whether a day is sprayed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import as_column, as_measure


def scheduled_compound(
    pattern, season, compound_a: str = fixed.COMPOUND_A, compound_b: str = fixed.COMPOUND_B
) -> Column:
    """Compound of a season under a repeating pattern of ``A`` and ``B``.

    A reactive plan starts with the first compound; what it takes later depends
    on the pools (see ``reactive_compound``) and is null here.
    """
    text, number = as_column(pattern), as_column(season)
    position = F.pmod(number - F.lit(1), F.length(text)) + F.lit(1)
    letter = F.substring(text, position.cast("int"), F.lit(1))
    cycled = F.when(letter == "B", compound_b).when(letter == "A", compound_a)
    return F.when(text != fixed.REACTIVE, cycled).when(number == 1, compound_a)


def should_spray(
    strategy,
    days_since,
    load,
    interval=fixed.SPRAY_INTERVAL,
    threshold=fixed.SPRAY_THRESHOLD,
    cooldown=fixed.SPRAY_COOLDOWN,
) -> Column:
    """Spray decision of a plot day.  The calendar rule has no cooldown.

    Null without a known strategy, and where the threshold rule lacks the load."""
    plan, since = as_column(strategy), as_column(days_since)
    return (
        F.when(plan == "none", F.lit(False))
        .when(plan == "calendar", since >= as_column(interval))
        .when(plan == "threshold", (since >= as_column(cooldown)) & (as_measure(load) > as_column(threshold)))
    )
