"""Target-distribution importance resampling over hashed n-grams, by prefix CRCs.

A feature is a run of consecutive words, joined by one space, and its bucket the CRC-32 of
its bytes modulo the number of buckets.  A text is brought to normal form (words joined by
one space) and read once: the running CRC is kept at each word's edges.  With R the CRC
register, which is linear over GF(2), the register of bytes from a to b is
``R(b) xor shift(R(a), b - a)``, where ``shift`` runs a register over so many zero bytes; so
the CRC of any n-gram comes from two kept values, whatever its length, without reading its
bytes again.  ``shift`` is a product of matrices for powers of two, each four tables.

The bucket counts of all documents and of the target give each bucket a gain (the log of the
smoothed ratio of shares); a document's weight is the mean of its features' gains, rounded
down, and its score adds Gumbel noise drawn from its id.  The highest scores among documents
of ``LEAST_WORDS`` words or more are drawn, ``PERCENT`` of them: a sample without
replacement in proportion to the weights' exponentials.

The draw takes no window over all rows: scores are split by range, the ranges' sizes summed
in order, and only ranges that hold drawn rows are numbered.

Rows of one id are documents of their own (with equal noise); among equal scores the smaller
id is drawn first, a null id last, and its noise is that of an empty id.  Null and empty
texts have no features: weight 0, never drawn.  With an empty target gains come from the
documents' counts alone; empty documents give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored
from fieldtally.llm.text import LOWER, blocks, word_bounds

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Reflected generator polynomial of CRC-32 (fixed value), and its register's first and last xor.
POLYNOMIAL, EDGE = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes of a lane: running CRCs go down all lanes of a text at once.
LANE = 64

APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x61:0x7B] = APART[0x80:] = False


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return value


TABLE = _byte_table()


def _apply(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by its images of each byte of the register."""
    out = tables[0][value & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ tables[i][(value >> np.uint32(8 * i)) & np.uint32(255)]
    return out


class Shifts:
    """Registers run over zero bytes; matrices for 1, 2, 4, 8, ... bytes, as needed."""

    def __init__(self) -> None:
        value = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.powers = [(value >> np.uint32(8)) ^ TABLE[value & np.uint32(255)]]

    def power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            self.powers.append(_apply(self.powers[-1], self.powers[-1]))
        return self.powers[k]

    def by(self, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = value.copy()
        for k in range(int(length.max(initial=0)).bit_length()):
            which = np.flatnonzero((length >> k) & 1)
            out[which] = _apply(self.power(k), out[which])
        return out


class Running:
    """Registers (begun at 0) after any number of the bytes of ``data``."""

    def __init__(self, data: np.ndarray, shifts: Shifts) -> None:
        self.shifts = shifts
        lanes = -(-len(data) // LANE)
        rows = np.zeros(lanes * LANE, np.uint8)
        rows[: len(data)] = data
        rows = np.ascontiguousarray(rows.reshape(lanes, LANE).T)
        self.within = np.empty((LANE, lanes), np.uint32)
        state = np.zeros(lanes, np.uint32)
        for j in range(LANE):
            state = (state >> np.uint32(8)) ^ TABLE[(state ^ rows[j]) & np.uint32(255)]
            self.within[j] = state
        # Registers at the lanes' ends, by doubling.
        step, k = 1, LANE.bit_length() - 1
        while step < lanes:
            state = np.concatenate([state[:step], state[step:] ^ _apply(shifts.power(k), state[:-step])])
            step, k = 2 * step, k + 1
        self.before = np.concatenate([np.zeros(1, np.uint32), state])

    def after(self, count: np.ndarray) -> np.ndarray:
        last = np.maximum(count - 1, 0)
        lane, place = last // LANE, last % LANE
        value = self.within[place, lane] ^ self.shifts.by(self.before[lane], place + 1)
        return np.where(count > 0, value, np.uint32(0))


def feature_crcs(data: np.ndarray, at: np.ndarray, longest: int, shifts: Shifts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and text of each feature, in order of texts; the number of words of each text."""
    start, end, text = word_bounds(data, at, APART)
    rows = len(at) - 1
    words = np.bincount(text, minlength=rows)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), words
    # Normal form: each word with one space after it.
    size = end - start
    to = np.cumsum(size + 1) - size - 1
    normal = np.full(int(to[-1] + size[-1] + 1), 0x20, np.uint8)
    own = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    normal[np.repeat(to, size) + own] = data[np.repeat(start, size) + own]
    running = Running(normal, shifts)
    first, last = running.after(to) ^ EDGE, running.after(to + size)
    crcs, owners = [], []
    for n in range(1, longest + 1):
        many = len(to) - n + 1
        if many <= 0:
            break
        whole = np.flatnonzero(text[:many] == text[n - 1 :])
        length = to[whole + n - 1] + size[whole + n - 1] - to[whole]
        crcs.append(last[whole + n - 1] ^ shifts.by(first[whole], length) ^ EDGE)
        owners.append(text[whole])
    crc, owner = np.concatenate(crcs), np.concatenate(owners)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        crc, owner = crc[order], owner[order]
    return crc, owner, words


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the bucket of each feature, repeats included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                crc, owner, words = feature_crcs(LOWER[data], at, longest, shifts)
                offsets = pa.array(np.searchsorted(owner, np.arange(last - first + 1)), pa.int32())
                found = pa.ListArray.from_arrays(offsets, pa.array((crc % np.uint32(buckets)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(words), found], ["doc_id", "n_words", "buckets"])

    rows = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    # One row a bucket.
    for r in found.select("buckets").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    own, wanted = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * own / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist())], np.int64
    )


def weighed(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            at = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(at)
            running = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            weight = (running[at[1:] - at[0]] - running[at[:-1] - at[0]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
            )

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = found.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: the place of a drawn document, null for the others."""
    may = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # The row number keeps rows apart that share score and id, so that no range is hot.
    rows = scored.withColumn("row", F.monotonically_increasing_id())
    ranged = stored(rows.where(may).repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id()), "ranged")
    before, start = 0, []
    # One row a range.
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        start.append((r["part"], before))
        before += r["count"]
    wanted = percent * before // 100
    starts = scored.sparkSession.createDataFrame([s for s in start if s[1] < wanted], "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order, "row"))
    drawn = ranged.join(F.broadcast(starts), "part").withColumn("rank", F.when(place <= wanted, place))
    none = F.lit(None).cast("long").alias("rank")
    others = ranged.where(F.col("part") >= sum(s[1] < wanted for s in start)).select(*scored.columns, none)
    short = scored.where(~may).select(*scored.columns, none)
    return drawn.select(*scored.columns, "rank").unionByName(others).unionByName(short)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; ``target`` has a text."""
    found = stored(features(docs, longest, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    return draw(stored(weighed(found, gain, seed), "weighed"), percent, least_words)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank")
