"""Average ranks of ties, at any size of a test.

A window ordered by value would put a whole test into one task.  Here values
are first counted (so ties and repeated values shrink to one row each), the
counts are split by range, and only per-range totals are added up in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.keys import with_values
from fieldtally.session import durable

#: A value is hot if it holds more than this share of all rows; there can be
#: at most 1 / HOT_SHARE such values, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def prefix_counts(hist: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """Add ``before``: how many rows of the test have a smaller value, and ``_size``: how
    many rows the test has.

    ``hist`` has one row per test and value.  The range split is written once
    and read by both the totals and the final pass, so that they agree even if
    a task is run again elsewhere.
    """
    spread = durable(
        hist.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("_range", F.spark_partition_id())
    )
    totals = spread.groupBy(*by, "_range").agg(F.sum(count).alias("_total"))
    # One row per test and range: bounded by the number of ranges.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_total").over(Window.partitionBy(*by)).alias("_size"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.join(offsets, [*by, "_range"])
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .drop("_range", "_offset")
    )


def value_ranks(hist: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """Add ``rank``: the mean of the places that the rows of a value take.  Written
    once, as rank plans are long and their result is read several times."""
    return durable(
        prefix_counts(hist, by, value, count).withColumn(
            "rank", F.col("before") + (F.col(count) + F.lit(1)) / F.lit(2.0)
        )
    )


def join_ranks(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], count: str, extra: Sequence[str]) -> DataFrame:
    """Attach ``extra`` columns of ``ranks`` (unique on ``keys``, written) to ``rows``.

    Hot values are few by construction, so their ranks are broadcast and their rows
    stay where they are; all other rows meet their ranks by shuffle.
    """
    total = ranks.agg(F.sum(count)).first()[0] or 0
    limit = F.lit(int(total * HOT_SHARE))
    entries = ranks.select(*keys, *extra, count)
    hot = F.broadcast(entries.filter(F.col(count) > limit).drop(count))
    cold = entries.filter(F.col(count) <= limit).drop(count)
    popular = rows.join(hot, list(keys))
    others = rows.join(hot.select(*keys), list(keys), "left_anti").join(cold, list(keys))
    return popular.unionByName(others)


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rank of every row's value within its test, ties sharing their mean place.

    Rows without a value have no rank and are left out.
    """
    rows = with_values(df, value)
    hist = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = value_ranks(hist, by, value, "_n").withColumnRenamed("rank", name)
    return join_ranks(rows, ranked, [*by, value], "_n", [name])
