"""Suffix-array deduplication of byte sequences by a distributed merge sort.

A repeat of 100 bytes is found from an anchor inside it: of the 32-byte grams in the
100 bytes, the leftmost of those with the smallest hash.  Equal strings have equal anchors, so only
suffixes that start at anchors are sorted (one byte in 35 or so), and of these only
those whose gram occurs twice or more: Spark counts the grams first, which is the
prefix-doubling filter of distributed string sorters.

Each task sorts its suffixes, front-codes the sorted run and sends it to the tasks that
merge, dealt by gram.  These merge the runs with a loser tree that compares no
known prefix again and so also gives the lengths of common prefixes of neighbours.  A
string of 100 bytes that begins ``o`` bytes before its anchor is its last 100 - ``o`` bytes as a
common prefix of neighbours in that order, and ``o`` bytes to the left; for each ``o``, the
sorted suffixes fall into groups of equal strings, and all but the first of a group go.

Equal suffixes with equal left sides are sent once a run.  A gram with more
occurrences than a merging group gets on average is dealt over as many groups as that makes,
by document; the firsts of their strings are then brought together by fingerprint.  Left sides and fingerprints are
64-bit hashes.

Null text is an empty text; a null doc_id takes nothing and loses nothing.  Equal rows that share a
doc_id are one document: the same place in both is no repeat.  Different texts under one doc_id are
parts of it in an order of their own (by 31 bits of a hash), and each loses its own repeats.  An empty table gives an
empty result.  Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.merging import Run, front_code, merge
from fieldtally.llm.repeats import shared_names
from fieldtally.llm.tables import releasing, stored
from fieldtally.llm.text import BASE, Hasher, blocks, mix, signed

LENGTH = 100
GRAM = 32
#: Places of a gram in a string.
PLACES = LENGTH - GRAM + 1
#: Suffixes of a run, and of what one merging group gets on average.
RUN = 1 << 16
MERGED = 40_000

_PLACE = np.uint64(30)
_PLACES = np.uint64((1 << 30) - 1)
#: Bits of a place that stand for the part of a document; less than 2^31 is left for the place in it.
_PART = 31


def _fill(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ranges in a row and the places they hold."""
    which = np.repeat(np.arange(len(at)), size)
    return which, at[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


class Anchors:
    """Anchors of a block of texts: their place, gram, text, and the first and last start of
    the strings they stand for."""

    def __init__(self, hasher: Hasher, data: np.ndarray, at: np.ndarray) -> None:
        none = np.zeros(0, np.int64)
        self.place = self.first = self.last = self.text = none
        self.gram = none.astype(np.uint64)
        if len(data) < LENGTH:
            return
        sums = hasher.sums(data)
        start = np.arange(len(data) - GRAM + 1)
        gram = hasher.ranges(sums, start, start + GRAM)
        # Smallest (hash, place) of PLACES in a row, by doubling.
        low = (gram >> _PLACE << _PLACE) | start.astype(np.uint64)
        width = 1
        while 2 * width <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = PLACES - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        anchor = (low & _PLACES).astype(np.int64)
        # Strings within one text.
        whole = np.zeros(len(anchor), bool)
        number = np.maximum(np.diff(at) - LENGTH + 1, 0)
        owner, inside = _fill(at[:-1], number)
        whole[inside] = True
        text = np.full(len(anchor), -1)
        text[inside] = owner
        new = whole.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        self.first = np.flatnonzero(new)
        ends = whole.copy()
        ends[:-1] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        self.last = np.flatnonzero(ends)
        self.place, self.text = anchor[self.first], text[self.first]
        self.gram = gram[self.place]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the grams of its anchors."""
    hasher = Hasher()
    for batch in batches:
        for first, last, data, at in blocks(batch.column("text")):
            found = Anchors(hasher, data, at)
            cuts = np.searchsorted(found.text, np.arange(last - first + 1)).astype(np.int32)
            names = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(found.gram)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), names], ["doc_id", "names"])


#: Columns of a suffix beside its bytes.
_FIELDS = ("size", "left_size", "nearest", "doc", "place")


class Suffixes:
    """Suffixes of a task until they make a run: up to 100 bytes from the anchor on, the
    bytes to its left back to the first string's start, and numbers."""

    def __init__(self) -> None:
        self.right, self.left, self.numbers, self.gram, self.spread = [], [], [], [], []
        self.size = 0

    def add(self, data: np.ndarray, at: np.ndarray, found: Anchors, which: np.ndarray, ids: np.ndarray, part: np.ndarray, spread: np.ndarray) -> None:
        place, text = found.place[which], found.text[which]
        size = np.minimum(LENGTH, at[text + 1] - place)
        left = place - found.first[which]
        far = np.arange(LENGTH)
        right = data[np.minimum(place[:, None] + far, len(data) - 1)]
        right[far >= size[:, None]] = 0
        # Bytes to the left, the nearest first.
        near = np.arange(1, PLACES)
        before = data[np.maximum(place[:, None] - near, 0)]
        before[near > left[:, None]] = 0
        self.right.append(right)
        self.left.append(before)
        self.numbers.append(np.stack([size, left, place - found.last[which], ids[text], place - at[text] + (part[text] << _PART)]))
        self.gram.append(found.gram[which])
        self.spread.append(spread)
        self.size += len(which)

    def run(self, number: int, buckets: int) -> tuple[dict, dict]:
        """The sorted run, cut by the group that merges it, and the strings of suffixes
        that equal another of the run."""
        right, left = np.concatenate(self.right), np.concatenate(self.left)
        size, left_size, nearest, doc, place = np.concatenate(self.numbers, axis=1)
        gram = np.concatenate(self.gram)
        spread = np.concatenate(self.spread)
        bucket = (mix(gram, 51) % np.uint64(buckets)).astype(np.int64)
        salt = mix(doc.view(np.uint64), 52) % spread.astype(np.uint64)
        salted = (mix(gram ^ mix(salt, 53)) >> np.uint64(2)).astype(np.int64) + buckets
        bucket = np.where(spread > 1, salted, bucket)
        words = np.zeros((len(right), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = right
        keys = words.view(">u8").astype(np.uint64)
        side = _rolled(left)[np.arange(len(left)), left_size]
        order = np.lexsort((place, doc, nearest, left_size, side, size, *(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), bucket))
        right, left, keys, side, bucket = right[order], left[order], keys[order], side[order], bucket[order]
        numbers = np.stack([size, left_size, nearest, doc, place])[:, order]
        same = np.zeros(len(order), bool)
        same[1:] = (keys[1:] == keys[:-1]).all(axis=1) & (side[1:] == side[:-1]) & (bucket[1:] == bucket[:-1])
        same[1:] &= (numbers[:3, 1:] == numbers[:3, :-1]).all(axis=0)
        # The same place of two rows of one document is no repeat.
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        later = same & ((numbers[3] != numbers[3][head]) | (numbers[4] != numbers[4][head]))
        gone = _ranges(numbers[3][later], numbers[4][later] - numbers[1][later], numbers[4][later] - numbers[2][later])
        right, left, bucket, numbers = right[~same], left[~same], bucket[~same], numbers[:, ~same]
        rows = {n: [] for n in ("bucket", "run", "shared", "rest", "left", "numbers")}
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            shared, rest = front_code(right[a:b], numbers[0, a:b])
            rows["bucket"].append(int(bucket[a]))
            rows["run"].append(number)
            rows["shared"].append(shared.astype(np.uint8).tobytes())
            rows["rest"].append(rest)
            rows["left"].append(left[a:b][np.arange(PLACES - 1) < numbers[1, a:b, None]].tobytes())
            rows["numbers"].append(np.ascontiguousarray(numbers[:, a:b]).astype("<i8").tobytes())
        self.__init__()
        return rows, gone


def _rolled(left: np.ndarray) -> np.ndarray:
    """Hashes of the bytes to the left, ``[suffix, how many]``."""
    out = np.zeros((len(left), left.shape[1] + 1), np.uint64)
    for o in range(left.shape[1]):
        out[:, o + 1] = (out[:, o] + left[:, o].astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    return out


def _ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc": doc, "start": start, "end": end}


_COLUMNS = {
    "bucket": pa.int64(), "run": pa.int64(), "shared": pa.binary(), "rest": pa.binary(), "left": pa.binary(), "numbers": pa.binary(),
    "doc": pa.int64(), "start": pa.int64(), "end": pa.int64(), "print": pa.int64(),
}
_SCHEMA = "bucket long, run long, shared binary, rest binary, left binary, numbers binary, doc long, start long, end long, print long"


def _batch(rows: dict) -> pa.RecordBatch:
    size = len(next(iter(rows.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[n], t) if n in rows else pa.nulls(size, t) for n, t in _COLUMNS.items()], list(_COLUMNS)
    )


def _sorter(buckets: int):
    """Runs of suffixes at shared grams, and the strings found repeated in a run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, held = Hasher(), Suffixes()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text"), 1 << 19):
                found = Anchors(hasher, data, at)
                names = batch.column("shared").slice(first, last - first)
                ids, part_of = (batch.column(c).slice(first, last - first).to_numpy() for c in ("doc_id", "part"))
                cuts = np.searchsorted(found.text, np.arange(last - first + 1))
                for i in range(last - first):
                    told = names[i].values
                    gram = told.field("name").to_numpy().view(np.uint64)
                    order = np.argsort(gram)
                    gram, spread = gram[order], told.field("spread").to_numpy()[order]
                    part = found.gram[cuts[i] : cuts[i + 1]]
                    place = np.minimum(np.searchsorted(gram, part), len(gram) - 1)
                    hit = np.flatnonzero(gram[place] == part)
                    for some in np.array_split(hit, max(1, -(-len(hit) // RUN))):
                        if len(some):
                            held.add(data, at, found, cuts[i] + some, ids, part_of, spread[place[some]])
                        if held.size >= RUN:
                            yield from map(_batch, held.run(number, buckets))
                            number += 1
        if held.size:
            yield from map(_batch, held.run(number, buckets))

    return work


def merged(table: pa.Table) -> dict:
    """The runs of one bucket as sorted suffixes: shared (bytes in common with the one
    before), left, strings, and the numbers."""
    runs, lefts, numbers = [], [], []
    near = np.arange(PLACES - 1)
    for row in table.sort_by("run").to_pylist():
        told = np.frombuffer(row["numbers"], "<i8").reshape(len(_FIELDS), -1)
        left = np.zeros((told.shape[1], PLACES - 1), np.uint8)
        left[near < told[1][:, None]] = np.frombuffer(row["left"], np.uint8)
        runs.append(Run(np.frombuffer(row["shared"], np.uint8).astype(np.int64), told[0], row["rest"]))
        lefts.append(left)
        numbers.append(told)
    order, shared, strings = merge(runs)
    order = np.array(order, np.int64)
    # Each run's suffixes come in their own order.
    at = np.empty(len(order), np.int64)
    by_run = np.argsort(order, kind="stable")
    at[by_run] = np.arange(len(order))
    return {"shared": np.array(shared, np.int64), "left": np.concatenate(lefts)[at], "strings": strings, "numbers": np.concatenate(numbers, axis=1)[:, at]}


def _merger(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        salted = table.column("bucket")[0].as_py() >= buckets
        found = merged(table)
        size, left_size, nearest, doc, place = found["numbers"]
        rank = np.lexsort((place, doc))
        ordinal = np.empty(len(rank), np.int64)
        ordinal[rank] = np.cumsum(np.concatenate([[0], (doc[rank][1:] != doc[rank][:-1]) | (place[rank][1:] != place[rank][:-1])]))
        side, gone = np.zeros(len(doc), np.uint64), np.zeros((len(doc), PLACES + 1), bool)
        out = {"doc": [], "start": [], "end": [], "print": []}
        begin = _prefix_prints(found["strings"]) if salted else None
        for o in range(PLACES):
            if o:
                side = (side + found["left"][:, o - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
            group = np.cumsum(found["shared"] < LENGTH - o)
            member = rank[(nearest[rank] <= o) & (left_size[rank] >= o)]
            if not len(member):
                continue
            key = mix(mix(group[member].astype(np.uint64)) ^ side[member])
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            row = member[order]
            gone[row, o] = ordinal[row] > ordinal[row[head]]
            if salted:
                firsts = row[new]
                out["doc"].append(doc[firsts])
                out["start"].append(place[firsts] - o)
                out["print"].append(signed(mix(begin[firsts, LENGTH - o - 1] ^ mix(side[firsts], o + 1))))
        # Strings that go, as ranges of their starts: a place further left is a larger o.
        edge = np.diff(np.concatenate([np.zeros((len(doc), 1), np.int8), gone.astype(np.int8)], axis=1), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        told = {"doc": doc[row], "start": place[row] - high + 1, "end": place[row] - low, "print": np.zeros(len(row), np.int64)}
        table = pa.table({k: pa.array(v, pa.int64()) for k, v in told.items()} | {"first": pa.array(np.zeros(len(row), bool))})
        if salted and out["doc"]:
            more = {k: np.concatenate(out[k]) for k in ("doc", "start", "print")}
            more["end"] = more["start"]
            firsts = pa.table({k: pa.array(more[k], pa.int64()) for k in ("doc", "start", "end", "print")} | {"first": pa.array(np.ones(len(more["doc"]), bool))})
            table = pa.concat_tables([table, firsts])
        return table

    return work


def _prefix_prints(strings: list[bytes]) -> np.ndarray:
    """Fingerprints of all prefixes, ``[string, length - 1]``."""
    right = np.frombuffer(b"".join(t.ljust(LENGTH, b"\0") for t in strings), np.uint8).reshape(-1, LENGTH)
    powers = np.full(LENGTH, BASE, np.uint64)
    return np.cumsum((right.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers), axis=1, dtype=np.uint64)


def in_parts(plain: DataFrame) -> DataFrame:
    """doc_id, text and part: 0, or a number of the text if its id has several texts."""
    hashed = plain.withColumn("hash", F.xxhash64("text"))
    several = hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    several = stored(several.where("low != high").select(F.col("doc_id").alias("several")), "several")
    part = F.when(F.col("several").isNull(), F.lit(0)).otherwise(F.pmod("hash", F.lit((1 << _PART) - 1)) + 1)
    return hashed.join(several, F.col("doc_id") == F.col("several"), "left").select("doc_id", "text", part.cast("long").alias("part"))


@releasing
def repeated(plain: DataFrame) -> DataFrame:
    """r_doc, r_part and ranges (first and last start) of its strings that start earlier as well;
    ``plain`` has doc_id, text and part."""
    plain = plain.where("doc_id is not null")
    named = stored(plain.select("doc_id", "text").mapInArrow(_named, "doc_id long, names array<long>"), "names")
    shared, total = shared_names(named, MERGED)
    buckets = max(1, -(-total // MERGED))
    told = stored(
        plain.join(shared, plain.doc_id == shared.s_doc).select("doc_id", "text", "part", "shared").mapInArrow(_sorter(buckets), _SCHEMA), "runs"
    )
    runs = told.where("bucket is not null").select("bucket", "run", "shared", "rest", "left", "numbers")
    found = stored(
        runs.groupBy("bucket").applyInArrow(_merger(buckets), "doc long, start long, end long, print long, first boolean"), "merged"
    )
    firsts = found.where("first").select("doc", "start", "print")
    earliest = stored(firsts.groupBy("print").agg(F.min(F.struct("doc", "start")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "low"), "earliest")
    late = firsts.join(earliest, "print").where(F.struct("doc", "start") > F.col("low")).select("doc", "start", F.col("start").alias("end"))
    gone = told.where("doc is not null").select("doc", "start", "end").union(found.where("not first").select("doc", "start", "end")).union(late)
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << _PART) - 1)).alias(c)
    return gone.groupBy(F.col("doc").alias("r_doc"), F.shiftright("start", _PART).alias("r_part")).agg(
        F.collect_list(F.struct(place("start"), place("end"))).alias("ranges")
    )


def dedupe(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept
    bytes (which may cut a character)."""
    plain = in_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ranges = repeated(plain)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                told = batch.column("ranges").slice(first, last - first)
                rows = []
                for i in range(last - first):
                    raw = data[at[i] : at[i + 1]]
                    removed = np.zeros(len(raw) + 2, np.int64)
                    if told[i].is_valid:
                        start, end = (told[i].values.field(n).to_numpy() for n in ("start", "end"))
                        np.add.at(removed, start + 1, 1)
                        np.subtract.at(removed, end + LENGTH + 1, 1)
                    removed = np.cumsum(removed[:-1]) > 0
                    kept = raw[~removed[1:]].tobytes()
                    rows.append((len(raw), int(removed.sum()), int((removed[1:] & ~removed[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array(c) for c in zip(*rows)][: len(names) - 1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], names)

    found = plain.join(ranges, (plain.doc_id == ranges.r_doc) & (plain.part == ranges.r_part), "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return found.mapInArrow(work, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
