"""Audits: reported figures against recomputed ones, logged decisions against
the rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.keys import as_column
from fieldtally.operators.joins import reconcile

#: Below this a computed value counts as zero and the tolerance is absolute.
ZERO = 1e-6


def within_tolerance(reported, computed, tolerance: float | Column, whole: bool = False) -> Column:
    """Whether a reported figure agrees with the computed one.

    Whole numbers must agree to the unit.  Others may differ by a relative
    tolerance, or absolutely where the computed value is nearly zero.
    """
    told, found = as_column(reported), as_column(computed)
    if whole:
        return F.abs(told - found) < 0.5
    limit = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    relative = F.abs(told - found) / F.greatest(F.abs(found), F.lit(ZERO))
    return F.when(F.abs(found) < ZERO, F.abs(told) < limit).otherwise(relative < limit)


def check(
    computed: DataFrame,
    reported: DataFrame,
    keys: Sequence[str],
    tolerances: Mapping[str, float],
    whole: Sequence[str] = (),
) -> DataFrame:
    """One row per matched key and measure: reported, computed, difference, ok.

    Both frames name their measures alike; ``tolerances`` lists the measures to
    check.
    """
    told = reported.select(*keys, *[F.col(m).cast("double").alias(f"{m}__told") for m in tolerances])
    pairs = reconcile(computed, told, keys)

    def entry(name: str) -> Column:
        found = F.col(name).cast("double")
        return F.struct(
            F.lit(name).alias("measure"),
            F.col(f"{name}__told").alias("reported"),
            found.alias("computed"),
            F.abs(F.col(f"{name}__told") - found).alias("difference"),
            within_tolerance(f"{name}__told", found, tolerances[name], name in whole).alias("ok"),
        )

    lines = pairs.select(*keys, F.explode(F.array(*[entry(m) for m in tolerances])).alias("_line"))
    return lines.select(*keys, "_line.*")


def discrepancies(checks: DataFrame) -> DataFrame:
    """Checks that failed; a figure that cannot be compared has failed too."""
    return checks.filter(~F.coalesce(F.col("ok"), F.lit(False)))


def audit_verdict(checks: DataFrame) -> DataFrame:
    """One row: how many checks, how many failed, the largest difference."""
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count(F.when(failed, 1)).alias("n_discrepancies"),
        F.max("difference").alias("max_difference"),
        F.coalesce(F.bool_and(~failed), F.lit(True)).alias("passed"),
    )


def absolute_differences(
    computed: DataFrame, reported: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Reported, computed and absolute difference of each measure, side by side."""
    told = reported.select(*keys, *[F.col(m).cast("double").alias(f"{m}_reported") for m in measures])
    pairs = reconcile(computed, told, keys)
    columns = []
    for m in measures:
        columns += [
            F.col(f"{m}_reported"),
            F.col(m).alias(f"{m}_computed"),
            F.abs(F.col(f"{m}_reported") - F.col(m)).alias(f"{m}_difference"),
        ]
    return pairs.select(*keys, *columns)


def vacuous_tolerances(reported: DataFrame, tolerance: str = "tolerance", whole: str | None = None) -> DataFrame:
    """Reported figures whose relative tolerance accepts nearly anything."""
    loose = F.col(tolerance) >= 1
    return reported.filter(loose if whole is None else loose & ~F.col(whole))


def policy_audit(
    logged: DataFrame,
    replayed: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    tolerance: float = 1e-9,
) -> DataFrame:
    """Rows whose logged decision differs from the replayed rule.

    ``columns`` maps each logged column to its replayed counterpart; numbers are
    compared within ``tolerance``, other values exactly.
    """
    kinds = dict(logged.dtypes)
    right = replayed.select(*keys, *[F.col(r).alias(f"{c}_replayed") for c, r in columns.items()])
    pairs = logged.select(*keys, *columns).join(right, list(keys))

    def differs(name: str) -> Column:
        seen, rule = F.col(name), F.col(f"{name}_replayed")
        if kinds[name] in ("double", "float"):
            return F.coalesce(F.abs(seen - rule) > tolerance, seen.isNull() != rule.isNull())
        return ~seen.eqNullSafe(rule)

    wrong = None
    for name in columns:
        wrong = differs(name) if wrong is None else wrong | differs(name)
    return pairs.filter(wrong)
