"""Best-fit packing of token sequences.

A document's ids, closed by an end id, are one piece if they fit a sequence; a longer
one is cut so that only its first piece may be short.  Pieces are packed best-fit
decreasing: the longest first, each into the tightest open sequence it fits, found in
a segment tree over remaining capacities.

Best-fit decreasing looks at lengths only, so it runs on how many pieces there are of
each length: at most ``capacity`` numbers, whatever the corpus size.  Pieces of equal
length and sequences of equal remaining capacity are alike; they move together, as
ranges of ranks and of sequence numbers.  Pieces get their rank among those of their
length from a global sort that splits popular lengths over many tasks, and find their
range by binary search.

Null text is an empty text, which is one piece of the end id.  Repeated rows are packed
each by itself; equal doc_ids are ordered by their content.  An empty table gives an empty result.  Other columns of
the input are not carried along.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.session import durable

CAPACITY = 2048
END = 0
#: How this vocabulary splits text before merging: fixed value.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Reads the vocabulary of a byte-level BPE file of the tokenizers library and encodes
    with tiktoken, which gives the same ids (tests compare both) several times faster:
    rank is id, as merges are numbered in the order of the vocabulary.  With ``special``, as
    that library does by default, the file's added tokens inside a text are one id each.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        # Byte-level vocabularies write each byte as a printable character.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain}
        byte |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in told["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.special = list(added) if special else []

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        return array("I", self.encoding.encode_ordinary(text)).tobytes()


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, on
    request, the ids."""
    path = vocabulary or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, special=True)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                rows = []
                names = some.column("doc_id").to_pylist()
                for doc, text in zip(names, pc.fill_null(some.column("text"), "").to_pylist()):
                    ids = encode(text) + end
                    size = len(ids) // 4
                    cuts = [0, *range(size % capacity or capacity, size + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(part), *([part] if with_ids else [])))
                columns = list(zip(*rows)) if rows else [[]] * (5 + with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                fields = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


class TightestFit:
    """A segment tree over remaining capacities 0 to ``capacity``: is any sequence
    open at this capacity?  Finds the smallest open capacity from a given one on."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.width)

    def set(self, at: int, value: bool) -> None:
        at += self.width
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def find(self, least: int) -> int | None:
        at = least + self.width
        if self.any[at]:
            return least
        # Up to the first right sibling that holds something, then down its left side.
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on piece counts by length.

    Rows (length, first rank, ranks, first sequence, sequences' first offset, pieces
    per sequence): ranks go to consecutive sequences, some pieces to each.  A step either
    uses up a length or a range of sequences, and a range loses capacity each time, so
    the number of rows is bounded by the capacity, not by the pieces.
    """
    open_ranges: dict[int, list[tuple[int, int]]] = {}
    tree = TightestFit(capacity)
    plan, sequences = [], 0

    def give(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            open_ranges.setdefault(room, []).append((first, number))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                # As many new sequences as this length fills.
                per = capacity // length
                first, number = sequences, -(-left // per)
                sequences += number
                room = capacity
            else:
                first, number = open_ranges[room].pop()
                if not open_ranges[room]:
                    tree.set(room, False)
                # The sequence just used is the tightest while it still fits.
                per = room // length
            full = min(number, left // per)
            if full:
                plan.append((length, rank, full * per, first, capacity - room, per))
                rank, left = rank + full * per, left - full * per
                give(room - per * length, first, full)
            if full < number:
                if left and left < per:
                    plan.append((length, rank, left, first + full, capacity - room, per))
                    give(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                give(room, first + full, number - full)
    return np.array(plan, np.int64).reshape(len(plan), 6)


def pack(found: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length."""
    spark = found.sparkSession
    found = durable(found)  # the sort below reads it twice, to learn the ranges and to deal
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    ranged = durable(found.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = ranged.withColumn("part", F.spark_partition_id())
    # Ranges of one sort: at most parts + capacity rows.
    seen = numbered.groupBy("part", "length").count().orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in seen:
        before[r["part"], r["length"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    plan = best_fit(counts, capacity)
    most = max(counts.values(), default=0) + 1
    keys = plan[:, 0] * most + plan[:, 1]
    sort = np.argsort(keys)
    plan, keys = plan[sort], keys[sort]
    names = found.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            part = batch.column("part")[0].as_py()
            # Rows come sorted by length: each length is a run.
            first = np.concatenate([[0], np.flatnonzero(length[1:] != length[:-1]) + 1])
            sizes = np.diff(np.append(first, len(length)))
            start = np.empty(len(first), np.int64)
            for i, (ell, size) in enumerate(zip(length[first].tolist(), sizes.tolist())):
                start[i] = at.get(ell, before[part, ell])
                at[ell] = int(start[i]) + size
            rank = np.repeat(start - first, sizes) + np.arange(len(length))
            row = plan[np.searchsorted(keys, length * most + rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 3] + within // row[:, 5]
            offset = row[:, 4] + within % row[:, 5] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(work, schema)


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed pieces with their ids: sort by sequence_id and offset to read them."""
    return pack(pieces(docs, vocabulary, capacity, with_ids=True), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
