"""Experiment designs, and whether a log holds what its design calls for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.schedule import scheduled_compound
from fieldtally.sources.contracts import Contract, pattern_names


def design(spark: SparkSession, params: Mapping[str, Sequence], repeat: int, seasons: int, plots: int = 1) -> DataFrame:
    """All cells of a factorial design: every combination of the swept values,
    repeat and season, with the rows expected in it.

    Values are unfolded from literals row by row, so the plan holds no join.
    """
    cells = spark.range(repeat).select(F.col("id").cast("int").alias("repeat"))
    for name, values in params.items():
        cells = cells.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name), "*")
    every = F.sequence(F.lit(1), F.lit(seasons))
    return cells.select(
        *params, "repeat", F.explode(every).alias("season"), F.lit(plots).cast("bigint").alias("expected_rows")
    )


def contract_design(spark: SparkSession, log: Contract) -> DataFrame:
    return design(spark, log.sweep, log.repeats, log.seasons, log.plots)


def rotation_patterns(spark: SparkSession, longest: int = 4) -> DataFrame:
    """All patterns of two compounds up to a length that use both and do not
    repeat a shorter pattern."""
    return spark.createDataFrame([(p, len(p)) for p in pattern_names(longest)], "rotation_pattern string, length int")


def with_patterns(df: DataFrame, longest: int = 4) -> DataFrame:
    """Every row once per rotation pattern, with the compound it schedules."""
    names = F.array(*[F.lit(p) for p in pattern_names(longest)])
    spread = df.withColumn("rotation_pattern", F.explode(names))
    return spread.withColumn("scheduled", scheduled_compound("rotation_pattern", "season"))


def pattern_agreement(df: DataFrame, longest: int = 4) -> DataFrame:
    """How many rows of a log were sprayed with the compound each pattern schedules.

    Rows are counted per season and compound before patterns are unfolded.
    """
    counts = df.groupBy("season", "pesticide_choice").agg(F.count(F.lit(1)).alias("n"))
    agree = F.col("pesticide_choice") == F.col("scheduled")
    return (
        with_patterns(counts, longest)
        .groupBy("rotation_pattern")
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(agree, F.col("n"))), F.lit(0)).alias("n_agree"),
        )
    )


def completeness(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells the design has and the log lacks, and the other way round."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    planned = cells.select(*keys).distinct().withColumn("_planned", F.lit(True))
    both = seen.join(planned, list(keys), "full")
    return both.filter(F.col("_planned").isNull() | F.col("n_rows").isNull()).select(
        *keys,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("_planned").isNull(), "outside design").otherwise("missing").alias("problem"),
    )


def balance(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each condition against the rows its design calls for."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    planned = cells.groupBy(*keys).agg(F.sum("expected_rows").alias("expected_rows"))
    both = seen.join(planned, list(keys), "full")
    rows, expected = F.coalesce("n_rows", F.lit(0)), F.coalesce("expected_rows", F.lit(0))
    return both.select(
        *keys,
        rows.alias("n_rows"),
        expected.alias("expected_rows"),
        (rows - expected).alias("surplus"),
        (rows == expected).alias("balanced"),
    )
