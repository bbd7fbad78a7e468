"""Hypothesis tests, one result row per test, many tests at once.

The unit of replication is the run: reduce plot rows to one row per run (with
``run_total`` or ``run_means``) before testing.  Every test checks that as part of
its own plan: a run that has several rows on one side of one test makes the query
fail when it runs, without a job beforehand.  Rows without a run identifier have no
unit and are left out.  A frame without the column ``run`` names is taken to hold one
row per run.  All heavy work is aggregation; Python sees one row per test, for the
tail probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally import fixed
from fieldtally.functions.keys import measure, with_values
from fieldtally.functions.tails import normal_upper_p, student_two_sided_p
from fieldtally.operators.ranks import join_ranks, value_ranks
from fieldtally.session import durable


def repeated_runs(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs that have more than one row."""
    return df.groupBy("run_id", *keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def require_run_unit(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Refuse a frame whose unit is finer than the run."""
    example = repeated_runs(df, keys).head(1)
    if example:
        raise ValueError(f"run {example[0]['run_id']!r} has several rows: reduce to one row per run first")
    return df


def checked_runs(df: DataFrame, keys: Sequence[str], values: Sequence[str], run: str | None = "run_id") -> DataFrame:
    """``keys`` and ``values`` of each run.  A run with several rows in one key is
    refused inside the plan, by the aggregate that brings its rows together; where the
    frame was reduced by the same keys before, that needs no further exchange."""
    if run is None or run not in df.columns:
        return df.select(*keys, *values)
    rows = df.filter(F.col(run).isNotNull()).groupBy(*keys, F.col(run).alias("_run")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(v).alias(v) for v in values]
    )
    several = F.raise_error(
        F.concat(F.lit("run '"), F.col("_run").cast("string"), F.lit("' has several rows in one test: reduce to one row per run first"))
    )
    return rows.select(*keys, *[F.when(F.col("_rows") == 1, F.col(v)).otherwise(several).alias(v) for v in values])


def _one_test(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key where there is a single test."""
    if by:
        return df, list(by)
    return df.withColumn("_test", F.lit(1)), ["_test"]


def _done(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df if by else df.drop("_test")


def welch_statistics(
    df: DataFrame, group_col: str, a, b, value: str, by: Sequence[str] = (), run: str | None = "run_id"
) -> DataFrame:
    """Sizes, means, difference, t and degrees of freedom of Welch's test.

    Both sides come from one conditional aggregate, so there is no self-join.
    """
    rows = checked_runs(df.filter(F.col(group_col).isin(a, b)), [*by, group_col], [value], run)
    rows, keys = _one_test(rows, by)

    def side(name) -> Column:
        return F.when(F.col(group_col) == F.lit(name), measure(value))

    parts = rows.groupBy(*keys).agg(
        F.count(side(a)).alias("n_a"),
        F.count(side(b)).alias("n_b"),
        F.avg(side(a)).alias("mean_a"),
        F.avg(side(b)).alias("mean_b"),
        F.var_samp(side(a)).alias("_va"),
        F.var_samp(side(b)).alias("_vb"),
    )
    sa, sb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    spread = sa + sb
    freedom = spread * spread / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    result = (
        parts.withColumn("mean_diff", F.col("mean_a") - F.col("mean_b"))
        .withColumn("t", F.when(spread > 0, F.col("mean_diff") / F.sqrt(spread)))
        .withColumn("df", F.when(spread > 0, freedom))
        .drop("_va", "_vb")
    )
    return _done(result, by)


def welch(
    df: DataFrame, group_col: str, a, b, value: str, by: Sequence[str] = (), run: str | None = "run_id"
) -> DataFrame:
    """Welch's t test of ``a`` against ``b``, two-sided."""
    return welch_statistics(df, group_col, a, b, value, by, run).withColumn("p", student_two_sided_p("t", "df"))


def mann_whitney_statistics(
    df: DataFrame, group_col: str, a, b, value: str, by: Sequence[str] = (), run: str | None = "run_id"
) -> DataFrame:
    """U of ``a`` and its normal score under the alternative that ``a`` is greater.

    Ranks are needed per value only: values are counted per side, and the rank
    sum of a side is its counts times the ranks.
    """
    chosen = checked_runs(df.filter(F.col(group_col).isin(a, b)), [*by, group_col], [value], run)
    rows, keys = _one_test(with_values(chosen, value), by)

    def members(name) -> Column:
        return F.count(F.when(F.col(group_col) == F.lit(name), 1))

    hist = rows.groupBy(*keys, value).agg(members(a).alias("_a"), members(b).alias("_b"))
    ranked = value_ranks(hist.withColumn("_n", F.col("_a") + F.col("_b")), keys, value, "_n")
    ties = F.col("_n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_a").alias("n_a"),
        F.sum("_b").alias("n_b"),
        F.sum(F.col("_a") * F.col("rank")).alias("_rank_sum"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    variance = na * nb / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    result = (
        sums.withColumn("u", F.col("_rank_sum") - na * (na + 1) / 2)
        .withColumn("z", F.when(variance > 0, (F.col("u") - na * nb / 2 - F.lit(0.5)) / F.sqrt(variance)))
        .drop("_rank_sum", "_ties")
    )
    return _done(result, by)


def mann_whitney(
    df: DataFrame, group_col: str, a, b, value: str, by: Sequence[str] = (), run: str | None = "run_id"
) -> DataFrame:
    """Mann-Whitney U test, one-sided: ``a`` tends to be greater than ``b``."""
    return mann_whitney_statistics(df, group_col, a, b, value, by, run).withColumn("p", normal_upper_p("z"))


def spearman_statistics(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), run: str | None = "run_id"
) -> DataFrame:
    """Rank correlation of ``x`` and ``y``, and its t score with n - 2 degrees.

    Values are counted by side, and both sides go through one ranking: a row of the
    counts is a value of either side, so one range split, one pass of prefix sums and
    one table of ranks serve both.  The counted pairs take their ranks from that table,
    first those of ``y``, then those of ``x`` with the sums over ``y`` already formed.
    Ranks are centred, which keeps the sums small.
    """
    checked = checked_runs(df, list(by), [x, y], run)
    rows, keys = _one_test(with_values(checked, x, y), by)
    # Written once: the ranking and the final sums read the pairs, not the log.
    pairs = durable(
        rows.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(
            F.count(F.lit(1)).alias("_n")
        )
    )
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_value")) for c in ("_x", "_y")]))
    hist = pairs.select(*keys, "_n", sides.alias("_s")).groupBy(*keys, "_s._side", "_s._value").agg(F.sum("_n").alias("_m"))
    ranks = value_ranks(hist, [*keys, "_side"], "_value", "_m")

    place = F.col("rank") - (F.col("_size") + 1) / F.lit(2.0)

    def side(name: str) -> DataFrame:
        return ranks.filter(F.col("_side") == name).select(
            *keys, F.col("_value").alias(name), "_m", place.alias(f"_place{name}")
        )

    by_x = (
        join_ranks(pairs, side("_y"), [*keys, "_y"], "_m", ["_place_y"])
        .groupBy(*keys, "_x")
        .agg(F.sum(F.col("_n") * F.col("_place_y")).alias("_sum_y"))
    )
    squares = ranks.groupBy(*keys).agg(
        F.max("_size").alias("n"),
        *[
            F.sum(F.when(F.col("_side") == c, F.col("_m") * place * place)).alias(f"_square{c}") for c in ("_x", "_y")
        ],
    )
    products = (
        side("_x").join(by_x, [*keys, "_x"]).groupBy(*keys).agg(F.sum(F.col("_place_x") * F.col("_sum_y")).alias("_product"))
    )
    xy, xx, yy = (F.col(c) for c in ("_product", "_square_x", "_square_y"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(xx * yy)))
    result = (
        squares.join(products, keys)
        .withColumn("rho", F.when((xx > 0) & (yy > 0), rho))
        .withColumn("df", (F.col("n") - 2).cast("double"))
        .withColumn(
            "t",
            F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt(F.col("df") / (F.lit(1.0) - F.col("rho") * F.col("rho"))))
            .when(F.abs("rho") >= 1, F.signum("rho") * F.lit(float("inf"))),
        )
        .drop("_product", "_square_x", "_square_y")
    )
    return _done(result, by)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), run: str | None = "run_id") -> DataFrame:
    """Spearman's rank correlation, two-sided."""
    return spearman_statistics(df, x, y, by, run).withColumn("p", student_two_sided_p("t", "df"))


def verdict(p: str | Column = "p", alpha: float = fixed.ALPHA) -> Column:
    value = F.col(p) if isinstance(p, str) else p
    return F.when(value < alpha, "reject").when(value.isNotNull(), "fail to reject")


def with_verdict(tests: DataFrame, alpha: float = fixed.ALPHA) -> DataFrame:
    """Add the verdict of each test beside its effect size."""
    return tests.withColumn("verdict", verdict("p", alpha))
