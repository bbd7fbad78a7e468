"""Substring deduplication of word sequences by recompression.

A text is a string of words.  A recompression round replaces each run of equal symbols by
one symbol, then each pair of a left and a right symbol by one (a bit of the symbol's own name
tells which it is).  Whether two neighbours join depends on those two alone, so equal
substrings get equal symbols all over the corpus, except at their edges.  Names are
64-bit fingerprints of what a symbol stands for, so all tasks give the same names; with
each symbol goes the stretch of words that settles its parse, and its name is that
stretch's.

Every window of 13 words is marked by the greatest name of the highest level that its
own words settle: equal windows have equal marks, wherever they stand.  Spark counts the
marks of all texts; only windows whose mark occurs again can be repeats, and these are
verified: their fingerprints are grouped to the smallest doc_id that has them.

Fingerprints of different word sequences are equal with a probability of 2^-64 a pair.
Null and empty texts, and texts under 13 words, have no windows and keep all their words.
Rows that share a doc_id are one document: none removes words of the other.  A row with a null
doc_id loses nothing and takes nothing.  An empty table gives an empty result.
Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.repeats import shared_names
from fieldtally.llm.tables import releasing, stored
from fieldtally.llm.text import Hasher, blocks, covered, mix, shingles, signed, word_bounds

WINDOW = 13
LEVELS = 2


class Parse:
    """Symbols of a block of texts: name, the words that settle them, and text."""

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        place = np.arange(len(words))
        self.name, self.text = words, text
        #: First word and word after the last that settle a symbol; at a text's edge one
        #: beyond it, as what would stand there is unknown.
        self.low, self.high = place, place + 1
        change = np.flatnonzero(text[1:] != text[:-1]) + 1
        self.first = np.concatenate([[0], change])[np.cumsum(np.concatenate([[0], text[1:] != text[:-1]]))]
        self.last = np.concatenate([change, [len(words)]])[np.cumsum(np.concatenate([[0], text[1:] != text[:-1]]))]

    def _take(self, at: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high = name, low, high
        self.text, self.first, self.last = self.text[at], self.first[at], self.last[at]

    def _before(self, at: np.ndarray) -> np.ndarray:
        """Where the symbol before begins to be settled."""
        known = (at > 0) & (self.text[at] == self.text[at - 1])
        return np.where(known, self.low[at - 1], self.first[at] - 1)

    def _after(self, at: np.ndarray) -> np.ndarray:
        next_ = np.minimum(at + 1, len(self.name) - 1)
        known = (at + 1 < len(self.name)) & (self.text[at] == self.text[next_])
        return np.where(known, self.high[next_], self.last[at] + 1)

    def runs(self) -> None:
        """Each run of equal symbols becomes one; a run is known by what ends it."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(new)) - 1
        length = (end - at + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[at] ^ mix(length), 21), self.name[at])
        self._take(at, name, self._before(at), self._after(end))

    def pairs(self, turn: int) -> None:
        """Each left symbol and the right symbol after it become one."""
        left = (mix(self.name, 31 + turn) >> np.uint64(40)) & np.uint64(1) == 0
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(len(left), bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(~second)
        paired, is_left = pair[at], left[at]
        next_ = np.minimum(at + 1, len(left) - 1)
        name = np.where(paired, mix(self.name[at] ^ mix(self.name[next_], 22), 23 + turn), self.name[at])
        # Alone, a left symbol is so by the one after it, a right symbol by the one before.
        low = np.where(paired | is_left, self.low[at], self._before(at))
        high = np.where(paired, self.high[next_], np.where(is_left, self._after(at), self.high[at]))
        self._take(at, name, low, high)


def marks(words: np.ndarray, text: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window from each word on: its mark, its fingerprint, and whether it lies in
    one text."""
    windows, whole = shingles(words, text, WINDOW)
    if not len(windows):
        return windows, windows, whole
    sums = hasher.sums_of(words)
    parse, start = Parse(words, text), np.arange(len(windows))
    # Nothing settled, as in a long run: the window marks itself.
    mark = windows.copy()
    for level in range(LEVELS):
        parse.runs()
        parse.pairs(level)
        low, high = parse.low, parse.high
        name = mix(hasher.ranges(sums, np.clip(low, 0, len(words)), np.clip(high, 0, len(words))), 40 + level)
        # Symbols settled by the window's words stand in a row.
        before = np.cumsum(np.bincount(low + 1, minlength=len(words) + 2))[: len(windows) + 1]
        begin = before[start]
        end = np.cumsum(np.bincount(high, minlength=len(words) + 2))[start + WINDOW]
        best = np.zeros(len(windows), np.uint64)
        for j in range(int((end - begin).max(initial=0))):
            at = np.minimum(begin + j, len(name) - 1)
            np.maximum(best, np.where(begin + j < end, name[at], np.uint64(0)), out=best)
        mark = np.where(best > 0, best, mark)
    return mark, windows, whole


class Reader:
    """Words and windows of blocks of texts; made once per task."""

    def __init__(self) -> None:
        self.hasher = Hasher()

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of words, their text and hash, and where each text's begin."""
        starts, ends, text = word_bounds(data, at)
        words = self.hasher.ranges(self.hasher.sums(data), starts, ends)
        return starts, ends, text, words, np.searchsorted(text, np.arange(len(at)))

    def named(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id and marks of its windows."""
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                _, _, text, words, _ = self.words(data, at)
                mark, _, whole = marks(words, text, self.hasher)
                text = text[: len(mark)]
                new = whole.copy()
                new[1:] &= (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
                yield _lists(batch.column("doc_id").slice(first, last - first), text[new], mark[new], "names")

    def candidates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id and fingerprints of the windows whose mark is shared."""
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                shared = batch.column("shared").slice(first, last - first)
                _, _, text, words, begin = self.words(data, at)
                mark, windows, whole = marks(words, text, self.hasher)
                where, prints = [], []
                for i in range(last - first):
                    part = slice(begin[i], max(begin[i], min(begin[i + 1], len(mark))))
                    hit = whole[part] & np.isin(mark[part], shared[i].values.to_numpy().view(np.uint64))
                    found = np.unique(windows[part][hit])
                    where.append(np.full(len(found), i))
                    prints.append(found)
                yield _lists(
                    batch.column("doc_id").slice(first, last - first), np.concatenate(where), np.concatenate(prints), "windows"
                )

    def kept(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, counts and what is left of the text."""
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                repeats = batch.column("repeats").slice(first, last - first)
                starts, ends, text, words, begin = self.words(data, at)
                windows, whole = shingles(words, text, WINDOW)
                gone, kept = [], []
                for i in range(last - first):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    if not repeats[i].is_valid:
                        gone.append(0)
                        kept.append(b" ".join(raw.split()))
                        continue
                    part = slice(begin[i], max(begin[i], min(begin[i + 1], len(windows))))
                    hit = np.flatnonzero(whole[part] & np.isin(windows[part], repeats[i].values.to_numpy().view(np.uint64)))
                    removed = covered(hit, WINDOW, begin[i + 1] - begin[i])
                    gone.append(int(removed.sum()))
                    kept.append(b" ".join(w for w, r in zip(raw.split(), removed.tolist()) if not r))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first), pa.array(np.diff(begin).astype(np.int64)), pa.array(gone, pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept]),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )


def _lists(ids: pa.Array, row: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    """Values by row, rows in order, as one list each."""
    at = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.ascontiguousarray(values))))], ["doc_id", name])


@releasing
def repeated(plain: DataFrame) -> DataFrame:
    """r_doc and repeats: the windows it shares with a document of a smaller id."""
    named = stored(plain.mapInArrow(lambda b: Reader().named(b), "doc_id long, names array<long>"), "names")
    shared, _ = shared_names(named, 1)
    windows = plain.join(shared, plain.doc_id == shared.s_doc).select("doc_id", "text", F.col("shared.name").alias("shared"))
    windows = stored(windows.mapInArrow(lambda b: Reader().candidates(b), "doc_id long, windows array<long>"), "windows")
    each = windows.select("doc_id", F.explode("windows").alias("window"))
    first = stored(
        each.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "low"), "first"
    )
    return each.join(first, "window").where("doc_id > low").groupBy(F.col("doc_id").alias("r_doc")).agg(F.collect_set("window").alias("repeats"))


def dedupe(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeats = repeated(plain)
    found = plain.join(repeats, plain.doc_id == repeats.r_doc, "left").select("doc_id", "text", "repeats")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in Reader().kept(batches):
            yield batch if with_text else batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
