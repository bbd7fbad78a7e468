"""Similarity join of documents by Jaccard of word shingles, filtered by several orders.

Two documents whose shingle sets are at least as similar as asked must share shingles
among the first of each under *any* global order of shingles.  Candidates have to pass several:

1. An order by hash.  Of each set, a prefix longer than necessary is taken; a document
   that has a partner shares at least ``need`` of these shingles with it, so one of which
   fewer are found in any other document has none and is out.  That leaves out nearly all
   documents without reading any pair.
2. The order by rarity, on what is left of the prefixes: of the shared shingles, all but
   the ``need`` - 1 most frequent ones are kept, so that very common passages join nothing.
3. Two more orders by other hashes, on whole sets, before they are compared.

Copies (equal sets) are one node.  Links are needed to find groups, not all pairs in
them, so work is linear in a group of near copies: in each round, a node is
compared with one other (the smallest node, in an order of the round, of the rare
shingle buckets it shares most of), as long as its buckets hold other groups.

What rounds leave open is settled exactly, without making pairs.  Of each open node, Spark
counts the shingles that some open node of another group holds: no link can rest on others,
so the count bounds how large a partner may be.  Nodes whose buckets hold no node of
another group within both bounds are done, which lowers the counts of the rest, and so on.
That ends families of texts that are near one another but under the threshold.  Nodes that
stay are dealt, with their whole sets, into blocks of bounded size; each two blocks of a
family meet in one task, where pairs must pass the bounds and share prefix shingles under
each of three orders before their sets are compared, and only links that join groups leave it.

Shingles are 64-bit hashes: within a pair of sets two different shingles are taken for
one with a probability of about 1e-13.  Null and empty texts have no shingles, are linked with
nothing and are their own group; a text of fewer words than a shingle is one shingle.
A doc_id that comes twice is one document in several rows: its rows' sets are linked by
their own texts, and all reach the same groups through it.  A row with a null doc_id
is linked with nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.graphs import components
from fieldtally.llm.tables import likely, releasing, stored
from fieldtally.llm.text import Hasher, LOWER, blocks, mix, shingles, signed, word_bounds

#: Rounds of comparisons with one other node.
ROUNDS = 3
#: Least number of shingles by which a prefix is longer than necessary: short sets are
#: taken whole, so that a common line in them joins nothing.
EXTRA = 24
#: Shingles of a block of sets.
TOGETHER = 1 << 20
#: Seeds of the orders by hash: of the prefixes, then of the checks on pairs.
ORDERS = (11, 12, 13)


def missing(n: int, percent: int) -> int:
    """Most shingles that a set of ``n`` can have outside a similar one."""
    return n - (percent * n + 99) // 100


def prefix_size(n: int, percent: int) -> int:
    return min(n, missing(n, percent) + 1 + max(n // 20, EXTRA))


class Sets:
    """Shingle sets of texts; made once per task."""

    def __init__(self, size: int) -> None:
        self.size, self.hasher = size, Hasher()

    def of(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct shingles of each text."""
        starts, ends, text = word_bounds(data, at)
        words = self.hasher.ranges(self.hasher.sums(LOWER[data]), starts, ends)
        hashes, whole = shingles(words, text, self.size)
        at_text = np.searchsorted(text, np.arange(len(at)))
        out = []
        for i in range(len(at) - 1):
            a, b = int(at_text[i]), int(at_text[i + 1])
            if b - a >= self.size:
                out.append(np.unique(hashes[a : b - self.size + 1]))
            elif b > a:
                # Fewer words than a shingle: the whole sequence as one.
                out.append(mix(np.array([b - a], np.uint64) + shingles(words[a:b], text[a:b], b - a)[0], 99))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _first(hashes: np.ndarray, number: int, order: int) -> np.ndarray:
    """The first of a set under an order, unsorted."""
    if number >= len(hashes):
        return hashes
    return hashes[np.argpartition(mix(hashes, order), number - 1)[:number]]


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), node (the set's name) and prefix of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                n, node, prefix = [], [], []
                for found in sets.of(data, at):
                    n.append(len(found))
                    # A sum over a set does not depend on its order.
                    name = mix(np.array([mix(found, 5).sum(dtype=np.uint64) + np.uint64(len(found))]), 6)
                    node.append(int(signed(name)[0]))
                    prefix.append(signed(_first(found, prefix_size(len(found), percent), ORDERS[0])))
                at_prefix = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                values = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, last - first) for c in ("doc_id", "text_hash")), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at_prefix), pa.array(values)),
                    ],
                    ["doc_id", "text_hash", "n", "node", "prefix"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(work, "doc_id long, text_hash long, n long, node long, prefix array<long>")


_COMPARED = "a long, b long, linked boolean"


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets are as similar as asked; the orders of checks come first."""
    least, most = sorted((len(x), len(y)))
    if least == 0 or 100 * least < percent * most:
        return False
    if not all(np.isin(_first(x, missing(len(x), percent) + 1, o), _first(y, missing(len(y), percent) + 1, o)).any() for o in ORDERS[1:]):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (least + most - common)


def compare(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b and linked of pairs (a, b), few of each node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                some = batch.slice(first, 64)
                x, y = ([s for _, _, data, at in blocks(some.column(c)) for s in sets.of(data, at)] for c in ("text_a", "text_b"))
                told = pa.array([linked(p, q, percent) for p, q in zip(x, y)], pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), told], ["a", "b", "linked"])

    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return stored(joined.mapInArrow(work, _COMPARED), "compared", few=True)


def whole_sets(nodes: DataFrame, size: int) -> DataFrame:
    """node, label, n and all shingles of (node, label, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                found = sets.of(data, at)
                n = np.array([len(s) for s in found], np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(signed(np.concatenate(found))))
                some = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("label"), pa.array(n), held], ["node", "label", "n", "held"])

    return nodes.select("node", "label", "text").mapInArrow(work, "node long, label long, n long, held array<long>")


class Postings:
    """Which of some sets hold a token."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.many = tokens[order], len(sets)
        self.owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def common(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set holds."""
        low, high = (np.searchsorted(self.tokens, tokens, side) for side in ("left", "right"))
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owners[at], minlength=self.many)


def joining_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between nodes of one block or of two that join all groups which any link
    between them joins."""
    node, label, n, cap, place = (rows.column(c).to_numpy() for c in ("node", "label", "n", "cap", "place"))
    held = [np.sort(s.values.to_numpy().view(np.uint64)) for s in rows.column("held").combine_chunks()]
    left, right = place == place.min(), place == place.max()
    mine, other = np.flatnonzero(left), np.flatnonzero(right)
    first = [[_first(s, missing(len(s), percent) + 1, o) for s in held] for o in ORDERS]
    by_order = [Postings([some[i] for i in other]) for some in first]
    whole = Postings([held[i] for i in other])
    names, group = np.unique(label, return_inverse=True)
    links = []
    for x in mine:
        may = (group[other] != group[x]) & (n[other] <= cap[x]) & (n[x] <= cap[other])
        for some, postings in zip(first, by_order):
            if not may.any():
                break
            may &= postings.common(some[x]) > 0
        if not may.any():
            continue
        common = whole.common(held[x])
        for y in other[may & (100 * common >= percent * (n[x] + n[other] - common))]:
            if group[y] != group[x]:
                links.append((int(node[x]), int(node[y])))
                group[group == group[y]] = group[x]
    return links


def _partnerless_gone(sets: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """node, label, n and cap of the nodes that may still have a partner of another group.

    A link of sets of n and m rests on c shared shingles with (100 + percent) * c >=
    percent * (n + m).  c is at most the number g of shingles that nodes of other groups
    hold, so m is at most cap = (100 + percent) * g / percent - n.
    """
    tokens = sets.select("node", F.explode("held").alias("token"), "label")
    foreign = stored(
        tokens.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token"), "foreign", few=True
    )
    counted = tokens.join(foreign, "token").groupBy("node").agg(F.count(F.lit(1)).alias("g"))
    sized = stored(
        sets.select("node", "label", "n").join(counted, "node")
        .withColumn("cap", F.floor((100 + percent) * F.col("g") / percent + 1e-9) - F.col("n"))
        # Partners are of this or a neighbouring band of sizes (a little wider than need be).
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent + 0.001)))),
        "sized", few=True,
    )
    stand = stored(buckets.select("token", "node").join(sized, "node"), "stand", few=True)
    # Of each bucket and band: the smallest set and the widest bound, and those of another group than theirs.
    keys = ["token", "band"]
    best = stored(stand.groupBy(*keys).agg(F.min(F.struct("n", "label")).alias("low"), F.max(F.struct("cap", "label")).alias("high")), "best", few=True)
    others = stand.join(best, keys).groupBy(*keys).agg(
        F.first("low").alias("low"), F.first("high").alias("high"),
        F.min(F.when(F.col("label") != F.col("low.label"), F.col("n"))).alias("low_other"),
        F.max(F.when(F.col("label") != F.col("high.label"), F.col("cap"))).alias("high_other"),
    )
    near = stand.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).join(stored(others, "others", few=True), keys)
    smallest = F.when(F.col("low.label") != F.col("label"), F.col("low.n")).otherwise(F.col("low_other"))
    widest = F.when(F.col("high.label") != F.col("label"), F.col("high.cap")).otherwise(F.col("high_other"))
    alive = near.where((smallest <= F.col("cap")) & (widest >= F.col("n"))).select("node").distinct()
    return sized.join(alive, "node").select("node", "label", "n", "cap")


@releasing
def open_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a and b of links that join all groups which rounds left apart."""
    here = _labelled(buckets, labels)
    tokens = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
    here = stored(here.join(stored(tokens, "open", few=True), "token"), "here", few=True)
    nodes = stored(here.select("node", "label").distinct(), "nodes", few=True)
    sets = stored(whole_sets(texts.join(nodes, "node"), size), "sets", few=True)
    many = sets.count()
    while True:
        left = stored(_partnerless_gone(sets, here, percent), "left", few=True)
        before, many = many, left.count()
        # Sets of those that stay go on; when few more go, the blocks settle the rest.
        sets = stored(sets.select("node", "held").join(left, "node").select("node", "label", "n", "held", "cap"), "sets", few=True)
        if 10 * many > 9 * before or many == 0:
            break

    stars = here.join(left.select("node"), "node")
    centers = stored(stars.groupBy("token").agg(F.min("node").alias("a")), "centers", few=True)
    edges = stars.join(centers, "token").select("a", F.col("node").alias("b")).distinct()
    family = components(edges)
    weight = stored(
        family.select("node", F.col("label").alias("family")).join(left.select("node", "n"), "node").groupBy("family").agg(F.ceil(F.sum("n") / TOGETHER).alias("blocks")),
        "weight", few=True,
    )
    place = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = stored(
        family.select("node", F.col("label").alias("family")).join(weight, "family").select("node", "family", "blocks", place.alias("place")), "placed", few=True
    )
    dealt = sets.join(placed, "node").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = [F.col("family"), F.least("place", "with").alias("i"), F.greatest("place", "with").alias("j")]

    def work(rows: pa.Table) -> pa.Table:
        links = joining_links(rows, percent)
        return pa.table([pa.array([l[k] for l in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.select(*keys, "node", "label", "n", "cap", "place", "held").groupBy("family", "i", "j").applyInArrow(work, "a long, b long")


def _round_key(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets with each node's group."""
    if labels is None:
        return buckets.withColumn("label", F.col("node"))
    return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


@releasing
def node_groups(docs: DataFrame, signed_docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node and label of the nodes that are linked with another."""
    spark = docs.sparkSession
    tokens = signed_docs.select("node", "n", F.explode("prefix").alias("token"))
    shared = stored(
        tokens.groupBy("token")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("often"))
        .where("low != high")
        .select("token", "often"),
        "shared",
    )
    found = stored(tokens.join(shared, "token").select("node", "n", "token", "often").distinct(), "found")

    # Orders 1 and 2: a partner of n shingles or of the fewest it may have shares at
    # least `need` prefix shingles; of a node's shared ones, all but need - 1 are kept,
    # the rarest first.  A window holds the prefix of one document.
    n = F.col("n")

    def need(of: Column) -> Column:
        return F.least(of, missing_sql(of) + 1 + F.greatest(F.floor(of / 20), F.lit(EXTRA))) - missing_sql(of)

    def missing_sql(of: Column) -> Column:
        return of - F.floor((percent * of + 99) / 100)

    fewest = F.floor((percent * n + 99) / 100)
    per_node = Window.partitionBy("node", "n")
    kept = (
        found.withColumn("matched", F.count(F.lit(1)).over(per_node))
        .where(F.col("matched") >= need(n))
        .withColumn("rank", F.row_number().over(per_node.orderBy("often", "token")))
        .where(F.col("rank") <= F.col("matched") - F.least(need(n), need(fewest)) + 1)
    )
    buckets = stored(kept.select("token", "node"), "buckets")

    # One text of each node; an id may stand on rows with other texts.
    nodes = buckets.select("node").distinct()
    firsts = stored(
        signed_docs.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
        .select("node", F.col("row.doc_id").alias("first_id"), F.col("row.text_hash").alias("first_hash")),
        "firsts", few=True,
    )
    told = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.xxhash64("text").alias("first_hash"), "text")
    # Few documents have a node left, and only their texts are shuffled, once.
    row = ["first_id", "first_hash"]
    texts = stored(likely(told, firsts, row).dropDuplicates(row).join(firsts, row).select("node", "text"), "texts", few=True)

    compared, labels = None, None
    for turn in range(ROUNDS):
        here = _labelled(buckets, labels)
        centers = stored(
            here.groupBy("token")
            .agg(F.min(F.struct(_round_key(F.col("node"), turn).alias("key"), "node", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"))
            .where("low != high")
            .select("token", F.col("c.node").alias("center"), F.col("c.label").alias("center_label")),
            "centers", few=True,
        )
        met = here.join(centers, "token").where("label != center_label").groupBy("node", "center").count()
        pairs = met.groupBy("node").agg(F.max(F.struct("count", "center")).alias("best")).select(
            F.least("node", "best.center").alias("a"), F.greatest("node", "best.center").alias("b")
        ).distinct()
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs", few=True)
        if pairs.isEmpty():
            break
        new = compare(pairs, texts, size, percent)
        compared = new if compared is None else stored(compared.union(new), "compared", few=True)
        labels = components(compared.where("linked"))
    if compared is None:
        return spark.createDataFrame([], "node long, label long")

    rest = open_links(buckets, labels, texts, size, percent)
    return components(compared.where("linked").select("a", "b").union(rest))


@releasing
def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reached by links."""
    rows = stored(signatures(docs, size, percent), "signatures")
    linkable = rows.where("n > 0 and doc_id is not null")
    labels = node_groups(docs, linkable, size, percent)
    filled = linkable.select("doc_id", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    filled = stored(filled.select("doc_id", "n", "label"), "filled", few=True)
    # Groups that one id stands in, with different texts, are one.
    several = filled.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("high")).where("a != high")
    edges = stored(filled.join(several, "doc_id").where("label != a").select("a", F.col("label").alias("b")).distinct(), "same_id", few=True)
    if not edges.isEmpty():
        whole = components(edges).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        filled = stored(filled.join(whole, "label", "left").select("doc_id", "n", F.coalesce("whole", "label").alias("label")), "filled", few=True)
    first = stored(filled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "first", few=True)
    alone = rows.where("n = 0 or doc_id is null")
    return (
        filled.join(first, "label")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .union(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each group, unchanged."""
    found = join(docs, size, percent)
    gone = stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", few=True)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
