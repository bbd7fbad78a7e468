"""Summaries that keep up with logs still being written.

Logs are append-only files, so a file stream sees each row once.  Rows carry no
event time, hence no watermark: after all files are read, results equal those
of the batch operators, which are the very same functions.

Results are published: each batch writes a version of its own, and readers take the
newest complete one, so nobody meets half a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtally.functions.keys import nan_to_null
from fieldtally.operators.summaries import daily_monitors, season_summary
from fieldtally.session import new_folder
from fieldtally.sources.contracts import Contract


def stream_log(spark: SparkSession, path: str, log: Contract, files_per_trigger: int = 100) -> DataFrame:
    """CSV log files of one contract as they arrive in a folder."""
    return nan_to_null(
        spark.readStream.schema(log.schema)
        .option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
    )


def stream_parquet(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100
) -> DataFrame:
    """Parquet log files as they arrive; ``path`` may be a folder or a glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def season_summary_stream(rows: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    return season_summary(rows, id_cols)


def daily_monitors_stream(rows: DataFrame, keys: Sequence[str] = ("day",)) -> DataFrame:
    return daily_monitors(rows, keys)


def _finish(query) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


#: Published versions that stay: the current one, and the one before it for readers
#: that began on it.
KEPT = 2


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, out: str) -> list[str]:
    """Names of the published versions of a table, oldest first.

    A version is a folder of its own, and published by the marker that Spark's writer
    leaves last; a folder without it is still being written, or was given up.
    """
    files, pattern = _files(spark, f"{out}/v*/_SUCCESS")
    return sorted(status.getPath().getParent().getName() for status in files.globStatus(pattern) or [])


def current(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest published version; what is being written beside it is not seen."""
    known = versions(spark, out)
    return spark.read.parquet(f"{out}/{known[-1]}") if known else None


def publish(batch: DataFrame, out: str, label: str, kept: int = KEPT) -> bool:
    """Write ``batch`` as the next version of the table at ``out``.

    ``label`` names what it holds: if that is the newest version already, as when a
    batch is repeated after a failure, nothing is written.  Versions before the last
    ``kept`` are removed, so what is stored does not grow with the number of batches.
    """
    spark = batch.sparkSession
    known = versions(spark, out)
    if known and known[-1].split("-", 1)[1] == label:
        return False
    number = int(known[-1].split("-", 1)[0][1:]) + 1 if known else 0
    batch.write.mode("overwrite").parquet(f"{out}/v{number:012d}-{label}")
    for name in versions(spark, out)[:-kept]:
        files, place = _files(spark, f"{out}/{name}")
        files.delete(place, True)
    return True


def _run(summary: DataFrame, mode: str, checkpoint: str | None, each) -> None:
    state = checkpoint or new_folder(summary.sparkSession, "stream")
    # Batches of different streams have different labels.
    stream = hashlib.sha256(state.encode()).hexdigest()[:12]
    query = (
        summary.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: each(batch, f"{stream}-{number}"))
        .start()
    )
    _finish(query)


def run_complete(summary: DataFrame, out: str, checkpoint: str | None = None) -> DataFrame:
    """Work off all files that are there; every batch publishes a version of the whole
    table at ``out``, which readers find by :func:`current`."""
    _run(summary, "complete", checkpoint, lambda batch, label: publish(batch, out, label))
    return current(summary.sparkSession, out)


def fold(table: DataFrame | None, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A keyed table with the rows of ``changed`` in place of those it had for their keys.
    One pass over either side, by one aggregate."""
    if table is None:
        return changed
    values = [c for c in changed.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(changed.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.max_by(c, "_new").alias(c) for c in values]).select(*changed.columns)


def run_update(summary: DataFrame, keys: Sequence[str], out: str, checkpoint: str | None = None) -> DataFrame:
    """Work off all files that are there; a batch brings only the rows it changed.

    They are folded into the current version of the table at ``out``, one row a key, and
    the result is published; so a reader reads one row a key however many batches there
    were.
    """
    spark = summary.sparkSession

    def each(batch: DataFrame, label: str) -> None:
        publish(fold(current(batch.sparkSession, out), batch, keys), out, label)

    _run(summary, "update", checkpoint, each)
    return current(spark, out)
