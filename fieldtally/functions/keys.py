"""Keys, run identifiers and missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(value) -> Column:
    """Strings name columns; numbers and booleans become literals."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def measure(name: str) -> Column:
    """A measure with NaN read as missing, so that it is skipped by aggregates."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def as_measure(value) -> Column:
    """As :func:`measure`, of a column, a name or a number."""
    known = as_column(value).cast("double")
    return F.when(~F.isnan(known), known)


def with_values(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is missing."""
    kinds = dict(df.dtypes)
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
        if kinds[name] in ("double", "float"):
            df = df.filter(~F.isnan(name))
    return df


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by null in the floating columns (all of them by default)."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = set(floating if columns is None else columns)
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in chosen and c in floating else F.col(c) for c in df.columns]
    )


def condition_key(value, places: int = 1) -> Column:
    """A floating condition value rounded, so that it can serve as a join key."""
    return F.round(as_column(value).cast("double"), places)


def season_key(value) -> Column:
    return as_column(value).cast("int")


def run_number(run_id) -> Column:
    """Number at the end of a run identifier such as ``calendar_17``; null if
    there is none."""
    return F.substring_index(as_column(run_id), "_", -1).try_cast("int")


def run_strategy(run_id) -> Column:
    """Initial strategy in a run identifier: what stands before its number."""
    text = as_column(run_id)
    tail = F.length(F.substring_index(text, "_", -1)) + F.lit(1)
    return F.when(run_number(text).isNotNull(), F.left(text, F.length(text) - tail))
