"""Intermediate tables in the shared folder."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.session import new_folder

#: Has Spark remove a query's shuffle files once the query is done.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Most words of 64 bits that :func:`likely` broadcasts.
FILTER = 1 << 19

#: Bytes of tables read that a file of a table written with ``few`` stands for.
FILE = 8 << 20

#: Folders written so far by the innermost call of a :func:`releasing` function.
_WRITTEN: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)


def files_for(df: DataFrame) -> int:
    """Files for a table made of others without becoming much larger than they are: one for
    each ``FILE`` bytes that they hold, and two for each core at least."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    held = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    # Spark takes a size that it does not know for one beyond all bounds.
    return min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-held // FILE)), 2**31 - 1)


def stored(df: DataFrame, label: str = "stage", compression: str | None = None, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Survives lost executors, and Spark then knows the size, so that it broadcasts only
    what is small.  The shuffle files that led there go at once.  ``few`` is for tables that
    may be small: a file takes its time to make, whatever it holds, so they get no more than
    :func:`files_for` says, however many partitions a shuffle has.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(files_for(df))
    path = new_folder(spark, label)
    written = _WRITTEN.get()
    if written is not None:
        written.append((spark, path))
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def releasing(make: Callable[..., DataFrame], few: bool = False) -> Callable[..., DataFrame]:
    """Have a function write its result, and then remove all that it stored on the way.

    The result's files are complete by then, so whatever a lost executor takes with it is
    read from them.  Frames made inside must not leave the function by another way.
    ``few`` holds for the result as in :func:`stored`.
    """

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        written: list[tuple[SparkSession, str]] = []
        outer = _WRITTEN.set(written)
        try:
            made = make(*args, **kwargs)
            _WRITTEN.reset(outer)
            outer = None
            return stored(made, make.__name__.strip("_"), few=few)
        finally:
            if outer is not None:
                _WRITTEN.reset(outer)
            for spark, path in written:
                _remove(spark, path)

    return run


def likely(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys ``wanted`` has, and few others: for a join by shuffle
    that finds few of many wide rows.

    The keys' hashes set bits, which are broadcast.  Beyond some ten million keys
    the bits fill up and more rows pass, but never fewer than the join needs.
    """
    place, word, bits = (unused(df, n) for n in ("place", "word", "bits"))
    at = F.pmod(F.xxhash64(*keys), F.lit(64 * FILTER))
    words = wanted.select(at.alias(place)).groupBy(F.floor(F.col(place) / 64).alias(word)).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(`{place}` % 64 AS INT))")).alias(bits)
    )
    found = df.withColumn(place, at).withColumn(word, F.floor(F.col(place) / 64)).join(F.broadcast(stored(words, "likely", few=True)), word)
    return found.where(F.getbit(F.col(bits), (F.col(place) % 64).cast("int")) == 1).select(*df.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
