"""Ranked lexical search: per-term geometric blocking.

A query set (``items``) is ranked against all documents, exactly.  One scan of the texts
leaves, of each document, its length and the counts of those terms that some item may ask
for (a bitmap of fixed size lets through a few more).  Documents are then sorted by a code
of similarity: the length on a log scale, which settles how large weights can be, and the
signs of random projections of the terms.  So each task holds a range of like documents,
and copies lie together.

In such a range, each term's posting list is cut into blocks of up to ``MEMBERS`` documents
that follow each other, that is, into clusters of like documents.  A block stores the
coordinatewise maximum of its documents' impacts, for the coordinates that some item asks
for together with the term and that are not rarer than it.  That index is written.  A
document needs to be found only in the list of its rarest term of an item, so the sum of
weight times maximum over those coordinates bounds what any document that is to be found
there can score; a block is skipped if that bound is less than the score of the item's
current last place, and only then.  Documents of the others are scored exactly.  Each task
keeps the best of its own range, and a ranking of those gives the result.

Items are taken in sets of up to ``ITEM_TERMS`` terms, which bounds what a task is sent; a
longer item is a set of its own.  Every row of either table counts by itself, also where
ids repeat or are null (null ids come last among equal scores).  Null and empty texts hold
no term: such documents and items are in no row of the result, nor are documents without
a term of the item.  Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored
from fieldtally.llm.text import LOWER, Hasher, ascii_lower, blocks, texts_of, word_bounds

PLACES = 10
#: Bits of the map of wanted terms.
BITS = 20
#: Terms of the items searched for at once.
ITEM_TERMS = 1 << 18
#: Documents of a block, and of a segment: the part of a range that is blocked at once.
MEMBERS, SEGMENT = 64, 2048
#: Entries of a segment's table of documents by terms; beyond it the segment is halved.
AREA = 1 << 23
#: Random projections in the code of similarity.
PLANES = 24

APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x61:0x7B] = APART[0x80:] = False

_SCANNED = "doc_id long, n long, code long, terms array<string>, tfs array<int>"
_INDEX = {
    "docs": "array<long>", "sizes": "array<int>", "ids": "array<int>", "impacts": "array<int>", "terms": "array<int>",
    "members": "array<int>", "member_counts": "array<int>", "coords": "array<int>", "peaks": "array<int>", "coord_counts": "array<int>",
}


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[place])))


def _list(values, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def item_rows(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id and the distinct terms of each item."""
    terms = F.array_remove(F.array_distinct(F.split(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")
    return stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms")), "items")


def wanted_terms(items: DataFrame) -> np.ndarray:
    """The bitmap of the items' terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, at = texts_of(batch.column("term"))
            found = np.unique(_slot(hasher.ranges(hasher.sums(data), at[:-1], at[1:])))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["slot"])

    # At most 2 ** BITS rows.
    slots = items.select(F.explode("terms").alias("term")).mapInArrow(work, "slot long").distinct().toArrow()
    out = np.zeros(1 << BITS, bool)
    out[slots.column("slot").to_numpy()] = True
    return out


def scan(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), the code of similarity, wanted terms and counts."""
    packed = np.packbits(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wanted = Hasher(), np.unpackbits(packed).astype(bool)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                data, rows = LOWER[data], last - first
                start, end, text = word_bounds(data, at, APART)
                n = np.bincount(text, minlength=rows)
                hashes = hasher.ranges(hasher.sums(data), start, end)
                hit = wanted[_slot(hashes)]
                start, end, text, hashes = start[hit], end[hit], text[hit], hashes[hit]
                coded = _strings(data, start, end).dictionary_encode()
                width = max(1, len(coded.dictionary))
                pairs, where, tf = np.unique(text * width + coded.indices.to_numpy(), return_index=True, return_counts=True)
                doc, word = pairs // width, pairs % width
                code = np.floor(np.log2(n + 1)).astype(np.int64)
                weight = tf / (tf + 1.0)
                for plane in range(PLANES):
                    sign = ((hashes[where] >> np.uint64(plane)) & np.uint64(1)).astype(np.float64) * 2 - 1
                    code = 2 * code + (np.bincount(doc, weights=weight * sign, minlength=rows) > 0)
                offsets = np.searchsorted(doc, np.arange(rows + 1))
                terms = coded.dictionary.take(pa.array(word)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), pa.array(n), pa.array(code), _list(terms, offsets), _list(tf.astype(np.int32), offsets)],
                    ["doc_id", "n", "code", "terms", "tfs"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, _SCANNED)


class Items:
    """A set of items: their terms in order from rare to common, numbered; of each item
    its terms' numbers, ascending, and weights."""

    def __init__(self, rows: list[tuple[int, list[tuple[int, str, int]]]]) -> None:
        # (documents that hold it, term) orders the terms in all items alike.
        order = sorted({(df, term) for _, terms in rows for df, term, _ in terms})
        number = {entry: i for i, entry in enumerate(order)}
        self.terms = pa.array([term for _, term in order], pa.string())
        self.names = np.array([item for item, _ in rows], np.int64)
        self.of = [np.array([number[df, term] for df, term, _ in terms], np.int32) for _, terms in rows]
        self.weights = [np.array([w for *_, w in terms], np.int64) for _, terms in rows]
        # Items of each term.
        term = np.concatenate([*self.of, np.zeros(0, np.int32)])
        item = np.repeat(np.arange(len(rows)), [len(x) for x in self.of])
        self.asking = item[np.argsort(term, kind="stable")]
        self.asked = np.searchsorted(np.sort(term), np.arange(len(order) + 1))

    def with_term(self, term: int, present: np.ndarray) -> np.ndarray:
        """Those of ``present`` (sorted numbers) from ``term`` on that some item has
        beside it; where many items do, all of them, which is a bound as well."""
        later = present[np.searchsorted(present, term) :]
        asking = self.asking[self.asked[term] : self.asked[term + 1]].tolist()
        if sum(len(self.of[i]) for i in asking) > 4 * len(later):
            return later
        found = np.unique(np.concatenate([self.of[i][np.searchsorted(self.of[i], term) :] for i in asking]))
        return found[np.isin(found, later, assume_unique=True)]


class Segment:
    """Documents of a range with their impacts, and the blocks of their posting lists."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, impacts: np.ndarray) -> None:
        self.present = np.unique(ids)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.searchsorted(self.present, ids)
        self.table = np.zeros((len(sizes), len(self.present)), np.int32)
        self.table[self.doc, self.at] = impacts

    def blocks(self, items: Items) -> tuple[np.ndarray, ...]:
        """Term, member and coordinate counts of each block; members, coordinates, peaks."""
        order = np.lexsort((self.doc, self.at))
        lists = np.searchsorted(self.at[order], np.arange(len(self.present) + 1)).tolist()
        doc = self.doc[order]
        terms, counts, coords, peaks, many = [], [], [], [], []
        for i, term in enumerate(self.present.tolist()):
            members = doc[lists[i] : lists[i + 1]]
            beside = items.with_term(term, self.present)
            starts = np.arange(0, len(members), MEMBERS)
            most = np.maximum.reduceat(self.table[np.ix_(members, np.searchsorted(self.present, beside))], starts, axis=0)
            block, where = np.nonzero(most)
            terms.append(np.full(len(starts), term))
            counts.append(np.diff(np.append(starts, len(members))))
            coords.append(beside[where])
            peaks.append(most[block, where])
            many.append(np.bincount(block, minlength=len(starts)))
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)
        return join(terms), doc.astype(np.int32), join(counts), join(coords), join(peaks), join(many)


def _parts(sizes: np.ndarray, ids: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Cuts documents ``first`` to ``last`` until a table of each part fits."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    if last - first > 1 and (last - first) * len(np.unique(ids[at[first] : at[last]])) > AREA:
        middle = (first + last) // 2
        yield from _parts(sizes, ids, first, middle)
        yield from _parts(sizes, ids, middle, last)
    elif last > first:
        yield first, last


def build(ranged: DataFrame, items: Items, n_docs: int, n_terms: int) -> DataFrame:
    """The index of the items' terms: one row for each segment of like documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, SEGMENT):
                batch = whole.slice(cut, SEGMENT)
                terms, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype(np.int64)
                sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(pc.index_in(terms.flatten(), value_set=items.terms), -1).to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                m = 10 + 90 * batch.column("n").to_numpy() * n_docs // n_terms
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                known = ids >= 0
                sizes, ids, impacts = np.bincount(doc[known], minlength=len(sizes)), ids[known], impacts[known]
                at = np.concatenate([[0], np.cumsum(sizes)])
                for first, last in _parts(sizes, ids, 0, len(sizes)):
                    own = slice(at[first], at[last])
                    found = Segment(sizes[first:last], ids[own], impacts[own])
                    terms, members, counts, coords, peaks, many = found.blocks(items)
                    row = [sizes[first:last], ids[own], impacts[own], terms, members, counts, coords, peaks, many]
                    lists = [_list(c.astype(np.int32), np.array([0, len(c)])) for c in row]
                    docs = _list(batch.column("doc_id").slice(first, last - first), np.array([0, last - first]))
                    yield pa.RecordBatch.from_arrays([docs, *lists], list(_INDEX))

    return ranged.select("doc_id", "n", "terms", "tfs").mapInArrow(work, ", ".join(f"{k} {v}" for k, v in _INDEX.items()))


class Best:
    """An item's best documents so far; ``least`` is what the last place scores."""

    def __init__(self, places: int) -> None:
        self.places, self.least = places, 1
        self.scores = self.docs = np.zeros(0, np.int64)
        self.without = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, without: np.ndarray) -> None:
        good = scores >= self.least
        scores, docs, without = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.docs, docs), (self.without, without)))
        order = np.lexsort((docs, without, -scores))[: self.places]
        self.scores, self.docs, self.without = scores[order], docs[order], without[order]
        if len(order) == self.places:
            self.least = int(self.scores[-1])


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def search_segment(row: dict[str, np.ndarray], docs: np.ndarray, without: np.ndarray, items: Items, best: list[Best]) -> int:
    """Offers a segment's documents to every item; gives the number of blocks opened."""
    segment = Segment(row["sizes"], row["ids"], row["impacts"])
    local = np.full(len(items.terms), -1, np.int64)
    local[segment.present] = np.arange(len(segment.present))
    by_term = np.searchsorted(row["terms"], np.append(segment.present, np.iinfo(np.int32).max))
    coord_at, member_at = (np.concatenate([[0], np.cumsum(row[k])]) for k in ("coord_counts", "member_counts"))
    coords, peaks = local[row["coords"]], row["peaks"].astype(np.int64)
    weight = np.zeros(len(segment.present), np.int64)
    opened = 0
    for terms, weights, found in zip(items.of, items.weights, best):
        own = local[terms]
        own, weights = own[own >= 0], weights[own >= 0]
        if not len(own):
            continue
        weight[own] = weights
        asked = _spread(by_term[own], by_term[own + 1])
        place = _spread(coord_at[asked], coord_at[asked + 1])
        sums = np.concatenate([[0], np.cumsum(peaks[place] * weight[coords[place]])])
        ends = np.cumsum(coord_at[asked + 1] - coord_at[asked])
        bound = sums[ends] - sums[ends - (coord_at[asked + 1] - coord_at[asked])]
        weight[own] = 0
        order = np.argsort(-bound, kind="stable")
        asked, bound = asked[order], bound[order]
        seen = np.zeros(len(docs), bool)
        at, step = 0, 4
        while True:
            # Bounds fall: those from here on that can still matter.
            last = min(at + step, int(np.searchsorted(-bound, -found.least, side="right")))
            if last <= at:
                break
            few = asked[at:last]
            at, step, opened = last, 4 * step, opened + len(few)
            members = np.unique(row["members"][_spread(member_at[few], member_at[few + 1])])
            members = members[~seen[members]]
            seen[members] = True
            scores = segment.table[np.ix_(members, own)].astype(np.int64) @ weights
            found.add(scores, docs[members], without[members])
    return opened


def search(index: DataFrame, items: Items, places: int = PLACES) -> DataFrame:
    """item, doc_id and score of each range's best documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(places) for _ in items.of]
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {k: batch.column(k)[i].values for k in _INDEX}
                row = {k: v.to_numpy(zero_copy_only=False) for k, v in lists.items() if k != "docs"}
                without = lists["docs"].is_null().to_numpy(zero_copy_only=False)
                search_segment(row, pc.fill_null(lists["docs"], 0).to_numpy(), without, items, best)
        names = np.repeat(items.names, [len(b.scores) for b in best])
        if len(names):
            docs, scores, without = (np.concatenate([getattr(b, k) for b in best]) for k in ("docs", "scores", "without"))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(docs, mask=without), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(work, "item long, doc_id long, score long")


def _sets(queries: DataFrame) -> Iterator[Items]:
    """The items in sets, one at a time in the driver."""
    rows, size = [], 0
    for r in queries.toLocalIterator():
        if rows and size + len(r["terms"]) > ITEM_TERMS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r["item"], [tuple(t) for t in r["terms"]]))
        size += len(r["terms"])
    if rows:
        yield Items(rows)


def rank(docs: DataFrame, items: DataFrame, places: int = PLACES) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each item."""
    told = item_rows(items)
    found = stored(scan(docs, wanted_terms(told)), "terms")
    n_docs, n_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = told.select("item", F.explode("terms").alias("term"))
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    entry = F.struct("df", "term", weight.alias("w"))
    queries = stored(asked.join(held, "term").groupBy("item").agg(F.array_sort(F.collect_list(entry)).alias("terms")), "queries")
    # The row number keeps rows apart that share code and id, so that no range is hot.
    rows = found.where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id())
    ranged = stored(rows.repartitionByRange("code", "doc_id", "row").sortWithinPartitions("code", "doc_id", "row").drop("row"), "ranged")
    parts = [stored(search(stored(build(ranged, some, n_docs, n_terms), "index"), some, places), "best") for some in _sets(queries)]
    result = parts[0] if parts else found.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for part in parts[1:]:
        result = result.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)
    return ranked.join(told.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank(docs, items)
