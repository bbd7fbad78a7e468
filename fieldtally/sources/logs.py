"""Readers and writers of logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.keys import as_column, nan_to_null
from fieldtally.session import BROADCAST_ROWS
from fieldtally.sources.contracts import Contract, conform, require_columns, with_derived

CORRUPT = "_corrupt_record"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of a CSV log."""
    lines = spark.read.text(path).limit(1).collect()
    return lines[0][0].strip().split(",") if lines else []


def read_log(spark: SparkSession, path: str, log: Contract, required: Sequence[str] | None = None) -> DataFrame:
    """Scan a CSV log under its contract.

    The header is checked for ``required`` columns (all of the contract's by
    default); types come from the contract and are never inferred.  NaN is read
    as missing.  Conditions that only run identifiers spell out become columns.
    """
    header = header_of(spark, path)
    missing = [c for c in (log.columns if required is None else required) if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in log.schema.fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType()), True) for c in header])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", "NaN")
        .csv(path)
    )
    return with_derived(nan_to_null(rows), log)


def read_dirty_log(spark: SparkSession, path: str, log: Contract) -> DataFrame:
    """Scan a CSV log whose appends may have gone wrong.

    Every line is parsed once, against the contract.  ``kind`` says what it is: ``good``,
    ``repeated header`` or ``malformed``; lines that do not fit keep their text in
    ``_corrupt_record`` and have no values.  All that follows (:func:`clean_log`,
    :func:`quarantine`, sums by kind) reads that one parse.
    """
    schema = log.schema.add(CORRUPT, T.StringType(), True)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_csv(F.col("value"), schema.simpleString()[len("struct<"):-1].replace(":", " "), options)
    # The parse is named and then only read, so that it runs once a line.
    rows = spark.read.text(path).select(parsed.alias("_row")).select("_row.*")
    kind = F.when(F.col(CORRUPT).isNull(), "good").when(_header_line(log), "repeated header").otherwise("malformed")
    good = F.col(CORRUPT).isNull()
    return rows.select(*[F.when(good, F.col(c)).alias(c) for c in log.columns], CORRUPT, kind.alias("kind"))


def _header_line(log: Contract) -> Column:
    return F.col(CORRUPT) == F.lit(",".join(log.columns))


def clean_log(raw: DataFrame) -> DataFrame:
    """Rows that fit the contract."""
    return raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "kind")


def quarantine(raw: DataFrame, log: Contract) -> DataFrame:
    """Lines that do not fit, each with its reason."""
    return raw.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.col("kind").alias("reason"))


def observe_kinds(raw: DataFrame, name: str = "lines") -> tuple[DataFrame, Observation]:
    """The same lines, and counts of their kinds (``good``, ``repeated_header``,
    ``malformed``) that are known once an action has run over them: writing the clean
    rows then also tells how many lines were refused, without a second scan."""
    seen = Observation(name)
    counts = [
        F.count(F.when(F.col("kind") == kind, 1)).alias(kind.replace(" ", "_")) for kind in ("good", "repeated header", "malformed")
    ]
    return raw.observe(seen, *counts), seen


def union_logs(parts: Mapping[str, DataFrame], label: str = "source") -> DataFrame:
    """One frame from several logs; columns a log lacks become nulls and
    ``label`` names the log a row came from."""
    labelled = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    result = labelled[0]
    for df in labelled[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


# A configuration's name: of a file, of the folder it lies in, or of a routed dataset's folder.
_CONFIG = r"^(?:.*/)?(?:[^/=]+=)?sensitivity_output_([a-z]+)_eff(\d+)_inc(\d+)_cost(\d+)(?:\.csv)?(?:/[^/]*)?$"
FILE_COLUMNS = ("file_compound", "file_efficacy_pct", "file_increment_pct", "file_cost")


def with_file_config(df: DataFrame, path: Column | str | None = None) -> DataFrame:
    """Add the run configuration that a file name spells out.

    ``path`` defaults to the file each row was read from, which may lie in a folder of
    that name; names that do not follow the pattern give nulls.  For whole logs use
    :func:`read_config_logs`, which parses once a file.
    """
    source = F.col("_metadata.file_path") if path is None else as_column(path)
    # One pattern match per row, kept in a column of its own so that it is not
    # repeated for each part; a name that does not match stays in one piece.
    parts = F.split(F.regexp_replace(source, _CONFIG, "$1,$2,$3,$4"), ",")

    def part(index: int) -> Column:
        return F.when(F.size("_parts") == 4, F.get("_parts", F.lit(index)))

    return df.withColumn("_parts", parts).select(
        *df.columns,
        part(0).alias("file_compound"),
        part(1).cast("int").alias("file_efficacy_pct"),
        part(2).cast("int").alias("file_increment_pct"),
        part(3).cast("int").alias("file_cost"),
    )


def config_files(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """The data files below ``path``, one row each: ``path`` to read it by, ``file_path``
    as rows name it, and its configuration.  Contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("_metadata.file_path").alias("file_path"))
    )
    files = with_file_config(listed, "file_path")
    return files if where is None else files.filter(where)


def read_config_logs(spark: SparkSession, path: str, log: Contract, where: Column | str | None = None) -> DataFrame:
    """CSV logs below ``path`` with the configurations that their names spell out.

    Names are parsed once a file, never once a row; ``where`` is a condition on the
    configuration and picks the files, so that others are not opened.  Each row meets
    its file's configuration by ``_metadata.file_path``.  Only the list of files passes
    through the driver, as for any scan.
    """
    files = config_files(spark, path, where).collect()
    told = spark.createDataFrame(
        [(r["file_path"], *(r[c] for c in FILE_COLUMNS)) for r in files],
        "_file string, file_compound string, file_efficacy_pct int, file_increment_pct int, file_cost int",
    )
    if not files:
        return spark.createDataFrame([], T.StructType([*log.schema.fields, *told.drop("_file").schema.fields]))
    rows = (
        spark.read.schema(log.schema).option("header", True).option("nanValue", "NaN").csv([r["path"] for r in files])
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    return nan_to_null(rows).join(F.broadcast(told) if len(files) <= BROADCAST_ROWS else told, "_file").drop("_file")


#: Names that a report spells out for each column; how many there are is counted for all.
LISTED = 100


def distinct_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every distinct value of the naming columns as a row: ``column``, ``value`` and how
    many rows hold it.  Missing values are left out."""
    names = [c for c in names if c in df.columns]
    inventory = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]))
    rows = inventory.select(each.alias("_c"), "n").select("_c.column", "_c.value", "n").filter(F.col("value").isNotNull())
    return rows.groupBy("column", "value").agg(F.sum("n").alias("n_rows"))


def name_sketches(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A distinct-count sketch of each naming column, by key: a few kilobytes however many
    names there are, and mergeable over keys, days or logs (:func:`sketched_counts`)."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string")).alias(c) for c in names])


def sketched_counts(sketches: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Estimated numbers of distinct names from sketches, merged over all but ``keys``.
    Exact up to a few hundred names, within a few percent beyond."""
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in names])


def source_report(
    df: DataFrame, names: Sequence[str] = ("strategy", "pesticide_choice"), listed: int = LISTED
) -> DataFrame:
    """One row about a log: its rows, runs, last season, and the distinct values of its
    naming columns, the first ``listed`` of them in order (all as rows:
    :func:`distinct_names`).

    Rows are first counted per run and naming columns, so only that inventory is
    shuffled.  Names become rows and each column's first ones are picked before anything
    is gathered, so no array grows with the data.
    """
    names = [c for c in names if c in df.columns]
    inventory = df.groupBy("run_id", *names).agg(F.count(F.lit(1)).alias("n"), F.max("season").alias("last"))
    each = F.explode(
        F.array(*[F.struct(F.lit(i).alias("of"), F.col(c).cast("string").alias("value")) for i, c in enumerate(("run_id", *names))])
    )
    found = (
        inventory.select(each.alias("_c"), "n", "last").select("_c.of", "_c.value", "n", "last")
        .groupBy("of", "value").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    )
    first = Window.partitionBy("of").orderBy("value")
    shown = (
        found.filter((F.col("of") > 0) & F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= listed)
        .select("of", F.col("value").alias("name"))
    )
    runs = F.col("of") == 0
    return found.filter(runs).unionByName(shown, allowMissingColumns=True).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("value").alias("n_runs"),
        F.max("last").alias("max_season"),
        *[
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("of") == i, F.col("name")))), ",").alias(f"{c}_values")
            for i, c in enumerate(names, start=1)
        ],
    )


# Routing rules: condition of a row, then the log it belongs to; the first rule
# that holds wins (fixed values, in order).
ROUTES = (
    ("interval_sweep_mode", "sensitivity_output_interval_grid"),
    ("threshold_sweep_mode", "sensitivity_output_threshold_grid"),
    ("threshold_sweep_mode_etofenprox", "sensitivity_output_threshold_grid_etofenprox"),
    ("threshold_sweep_mode_neonic", "sensitivity_output_threshold_grid_neonic"),
    ("compound_baseline_etofenprox", "harvest_grid_output_etofenprox"),
    ("compound_baseline_neonic", "harvest_grid_output_neonic"),
    ("longterm_mode", "harvest_grid_output_longterm"),
    ("interval_sweep_mode_rotation", "sensitivity_output_interval_grid_rotation"),
    ("threshold_sweep_mode_rotation", "sensitivity_output_threshold_grid_rotation"),
    ("rotation_immigration_sweep_mode", "sensitivity_output_rotation_immigration_grid"),
    ("sequence_sweep_mode_calendar", "sensitivity_output_compound_sequence_grid_calendar"),
    ("sequence_sweep_mode_threshold", "sensitivity_output_compound_sequence_grid_threshold"),
    ("adaptive_farmer_sweep_mode", "sensitivity_output_adaptive_farmer_grid"),
    ("adaptive_farmer_immigration_sweep_mode", "sensitivity_output_adaptive_farmer_immigration_grid"),
    ("adaptive_farmer_longhorizon_mode", "sensitivity_output_adaptive_farmer_longhorizon"),
    ("adaptive_farmer_rotation_sweep_mode", "sensitivity_output_adaptive_farmer_rotation_grid"),
    ("adaptive_escalate_sweep_mode", "sensitivity_output_adaptive_farmer_escalate_grid"),
    ("strategyswap_resistance_sweep_mode", "sensitivity_output_strategyswap_grid_resistance"),
    ("strategyswap_profit_sweep_mode", "sensitivity_output_strategyswap_grid_profit"),
    ("rotation_mode", "harvest_grid_output_rotation"),
    ("heterogeneous_mode", "harvest_grid_output_heterogeneous"),
    ("log_plot_position", "harvest_grid_output_spatial"),
    ("sweep_immigration_mode", "sensitivity_output_immigration_grid"),
    ("sweep_immigration_mode_extended", "sensitivity_output_immigration_grid_extended"),
    ("sweep_decay_mode", "sensitivity_output_decay_grid"),
    ("sweep_reproduction_mode", "sensitivity_output_reproduction_grid"),
    ("interval_immigration_sweep_mode", "sensitivity_output_interval_immigration_grid"),
    ("threshold_immigration_sweep_mode", "sensitivity_output_threshold_immigration_grid"),
    ("batch_mode", "harvest_grid_output"),
)


def route(df: DataFrame, rules: Iterable[tuple[Column | str, str]] = ROUTES) -> DataFrame:
    """Add ``dataset``: the log each row is to be written to, or null for none.

    A rule given as a name that the frame lacks never holds.
    """
    target = None
    for condition, name in rules:
        if isinstance(condition, str):
            if condition not in df.columns:
                continue
            condition = F.col(condition)
        target = F.when(condition, name) if target is None else target.when(condition, name)
    return df.withColumn("dataset", F.lit(None).cast("string") if target is None else target)


def write_routed(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", rebalance: bool = False
) -> None:
    """Write every routed row below ``path``, one folder per dataset.

    Unrouted rows are not written.  By default rows are not shuffled: each task
    appends to the datasets it holds rows of.  Where tasks hold rows of many
    datasets that leaves many small files; ``rebalance`` then gathers datasets
    first, and Spark splits those that are too large for one task.
    """
    require_columns(df, ["dataset"])
    rows = df.filter(F.col("dataset").isNotNull())
    if rebalance:
        rows = rows.hint("rebalance", F.col("dataset"))
    writer = rows.write.mode(mode).partitionBy("dataset")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_dataset(spark: SparkSession, path: str, log: Contract) -> DataFrame:
    """One dataset of a routed Parquet store; only its folder is read."""
    rows = spark.read.parquet(path).filter(F.col("dataset") == log.name)
    return conform(rows.drop("dataset"), log)


def write_summary(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a summary; ``overwrite`` replaces what is there, ``append`` adds."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
