"""Language-model scoring of documents.

One pass over the texts gathers the ids of each, and from those to learn from the counts of all words and of all subword
ids, and all windows of ids of each text, as stretches of many windows in a row.  A causal self-attention model (:mod:`attention`)
is trained on these windows: shards of them are trained on at the same time, and their
parameters averaged, twice.  A pass over the ids scores every text.  Both learn and score in
overlapping windows, each token once.

Beside the model's score stands that of words alone.  Counts of the ``POPULAR`` most
frequent words travel to all tasks, whatever the corpus size; those of all others are
joined by shuffle, so the sum is exact.

Null text is an empty text: it has its end only.  Repeated rows are learned from and
scored each by itself; a null doc_id counts as held out.  Without documents to learn from
all counts are 0 and the model stays as it starts.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm import attention
from fieldtally.llm.packing import Encoder, default_vocabulary
from fieldtally.llm.tables import stored
from fieldtally.llm.text import Hasher, LOWER, blocks, mix, signed, word_bounds

#: Words whose counts every task knows.
POPULAR = 1 << 16
#: Windows of a training shard, rounds, and the rate of each.
SHARD = 40_000
RATES = (0.01, 0.004)
#: Values of a parameter block that is averaged at once.
PART = 4096
#: End of a text, which also stands before its first token.
END_ID = 50256
IDS = 50257
#: Windows of a stretch, and its tokens: those that windows share are held once.
TOGETHER = 16
STRETCH = TOGETHER * (attention.LENGTH - attention.OVERLAP) + attention.OVERLAP
#: Tokens of whole texts scored at once.
SCORED = 1 << 18
#: Numbers before the ids in a stretch's record.
HEAD = 3


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _tokens(encode: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts in a row with their ends, the id before each, and lengths."""
    raw = [encode(t) + END_ID.to_bytes(4, "little") for t in texts]
    ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = END_ID
    return ids, before, lengths


def cut(ids: np.ndarray, before: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All windows of texts in a row, in stretches: keys, which deal them out, numbers of
    windows, and records: how many tokens at the front only serve as context, the id
    before them, the number of ids, the ids."""
    first, end, context = attention.window_places(lengths, STRETCH)
    size = np.minimum(end - first, STRETCH)
    number = attention.windows_in(size)
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, first, side="right")
    place = (first - ends[text] + lengths[text]).astype(np.uint64)
    head = np.stack([context, before[first], size], axis=1).astype("<u2")
    short = ids.astype("<u2")
    records = [h.tobytes() + short[f : f + n].tobytes() for h, f, n in zip(head, first, size)]
    return signed(mix(mix(names[text].view(np.uint64), 4) + place, 5)), number, records


def gather(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of kind 0 (hash and count of words), 1 (id and count), 2 (key, number of windows
    and record of a stretch of ids) and 3 (number of texts), from the texts to learn from,
    which are all but those marked by a column ``held``; and, with that column, of kind 4
    (doc_id and all ids) from every text."""
    marked = "held" in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, encode = Hasher(), Encoder(vocabulary, special=True)
        id_counts = np.zeros(IDS, np.int64)
        words, counts, size, texts = [], [], 0, 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray, records: list[bytes] | None = None) -> pa.RecordBatch:
            windows = pa.nulls(len(key), pa.binary()) if records is None else pa.array(records, pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), windows],
                ["kind", "key", "n", "ids"],
            )

        def merged() -> pa.RecordBatch:
            order = np.argsort(np.concatenate(words))
            key, n = np.concatenate(words)[order], np.concatenate(counts)[order]
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            return rows(0, signed(key[first]), np.add.reduceat(n, first))

        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False) if marked else np.zeros(batch.num_rows, bool)
            texts += int(np.count_nonzero(~held))
            for first, last, data, at in blocks(batch.column("text")):
                learned = ~held[first:last]
                starts, ends, text = word_bounds(data, at)
                counted = learned[text]
                key, n = np.unique(hasher.ranges(hasher.sums(LOWER[data]), starts[counted], ends[counted]), return_counts=True)
                if len(key):
                    words.append(key)
                    counts.append(n)
                    size += len(key)
                if size > 1_500_000:
                    yield merged()
                    words, counts, size = [], [], 0
                some = batch.slice(first, last - first)
                ids, before, lengths = _tokens(encode, pc.fill_null(some.column("text"), "").to_pylist())
                if marked:
                    short, to = ids.astype("<u2"), np.cumsum(lengths)
                    whole = pa.array([short[e - n : e].tobytes() for n, e in zip(lengths, to)], pa.binary())
                    kinds = pa.array(np.full(len(lengths), 4, np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, some.column("doc_id"), pa.array(lengths), whole], ["kind", "key", "n", "ids"])
                    there = np.repeat(learned, lengths)
                    some, ids, before, lengths = some.filter(pa.array(learned)), ids[there], before[there], lengths[learned]
                id_counts += np.bincount(ids, minlength=IDS)
                if len(lengths):
                    names = some.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield rows(2, *cut(ids, before, lengths, names))
        if words:
            yield merged()
        seen = np.flatnonzero(id_counts)
        yield rows(1, seen, id_counts[seen])
        yield rows(3, np.zeros(1, np.int64), np.array([texts], np.int64))

    return docs.mapInArrow(work, "kind int, key long, n long, ids binary")


def _windows(raw: bytes, vocabulary: attention.Vocabulary) -> tuple[np.ndarray, ...]:
    """Rows, rows of the next ids, their classes, and which places hold tokens to predict,
    of all windows of stretches' records one after another.  The windows are mixed, so
    that neighbours do not make a batch."""
    record, heads, at = np.frombuffer(raw, "<u2"), [], 0
    while at < len(record):
        heads.append(at)
        at += HEAD + int(record[at + 2])
    heads = np.array(heads, np.int64)
    size = record[heads + 2].astype(np.int64)
    stretch = np.repeat(np.arange(len(heads)), attention.windows_in(size))
    nth = np.arange(len(stretch)) - np.searchsorted(stretch, stretch)
    order = np.argsort(mix(np.arange(len(stretch), dtype=np.uint64), 7))
    stretch, nth = stretch[order], nth[order]
    first = heads[stretch] + HEAD + nth * (attention.LENGTH - attention.OVERLAP)
    left = (heads + HEAD + size)[stretch] - first
    context = np.where(nth > 0, attention.OVERLAP, record[heads[stretch]])
    place = np.arange(attention.LENGTH)
    real = (place < left[:, None]) & (place >= context[:, None])
    # Each window with the id before it, in two bytes an id.
    longer = np.concatenate([record, np.zeros(attention.LENGTH, "<u2")])
    ids = np.lib.stride_tricks.sliding_window_view(longer, attention.LENGTH + 1)[first - 1]
    begin = np.flatnonzero(nth == 0)
    ids[begin, 0] = record[heads[stretch[begin]] + 1]
    short = np.flatnonzero(left < attention.LENGTH)
    ids[short, 1:] *= place < left[short, None]
    row = vocabulary.row[ids]
    return row[:, :-1], row[:, 1:], vocabulary.of[ids[:, 1:]], real


def _texts(batch: pa.RecordBatch, encode: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of kind 4 in blocks: first row, row after the last, bytes of the texts and
    their offsets, and ids with the id before each and lengths.  Ids settle their text."""
    records = batch.column("ids").to_pylist()
    at = np.cumsum([0, *(len(r) // 2 for r in records)])
    first = 0
    while first < len(records):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SCORED, side="right")) - 1)
        ids = np.frombuffer(b"".join(records[first:last]), "<u2").astype(np.int64)
        lengths = np.diff(at[first : last + 1])
        start = np.cumsum(lengths) - lengths
        before = np.append(0, ids[:-1])
        before[start] = END_ID
        raw = [encode.encoding.decode_bytes(ids[a : a + n - 1].tolist()) for a, n in zip(start, lengths)]
        yield first, last, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ids, before, lengths
        first = last


def _parts(found: np.ndarray, weight: int) -> pa.Table:
    """A flat array in parts that Spark can average apart."""
    cuts = range(0, len(found), PART)
    return pa.table(
        {
            "part": pa.array(cuts, pa.int64()),
            "weight": pa.array([float(weight)] * len(cuts)),
            "found": pa.array([found[c : c + PART] for c in cuts], pa.list_(pa.float32())),
        }
    )


def _joined(table: pa.Table) -> pa.Table:
    """A shard as one row: its stretches' records in the order of their keys."""
    table = table.sort_by([("key", "ascending"), ("ids", "ascending")])
    return pa.table({"number": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), "ids": pa.array([b"".join(table.column("ids").to_pylist())], pa.binary())})


def _profiler(id_counts: np.ndarray):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = attention.Vocabulary(id_counts), 0.0
        for batch in batches:
            for raw in batch.column("ids"):
                rows, nexts, _, real = _windows(raw.as_py(), known)
                total = total + attention.profiles(rows, nexts, real).ravel().astype(np.float64)
        if np.ndim(total):
            yield from _parts(total.astype(np.float32), 1).to_batches()

    return profile


def _trainer(start: np.ndarray, rate: float, id_counts: np.ndarray, of_rows: np.ndarray):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, weight = attention.Vocabulary(id_counts, of_rows), 0.0, 0
        for batch in batches:
            for number, raw in zip(batch.column("number").to_pylist(), batch.column("ids")):
                rows, _, classes, real = _windows(raw.as_py(), known)
                total = total + attention.train(start, rows, classes, real, rate).astype(np.float64) * number
                weight += number
        if weight:
            yield from _parts((total / weight).astype(np.float32), weight).to_batches()

    return train


def _average(table: pa.Table) -> pa.Table:
    weight, found = table.column("weight").to_numpy(), table.column("found").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    mean = weight @ found / weight.sum()
    return pa.table({"part": table.column("part").slice(0, 1), "mean": pa.array([mean], pa.list_(pa.float64())), "weight": pa.array([weight.sum()])})


def _averaged(parts: DataFrame) -> tuple[np.ndarray, float]:
    """The mean of flat arrays and their weight; as many values come to the driver as one
    of them has."""
    means = stored(parts, "parts").groupBy("part").applyInArrow(_average, "part long, mean array<double>, weight double").orderBy("part").collect()
    return np.concatenate([r["mean"] for r in means]).astype(np.float32), means[0]["weight"]


def learn(windows: DataFrame, id_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters trained on stretches of windows (key, n, ids), and the classes of rows: in
    shards, averaged after each round."""
    flat = attention.fresh()
    shards = -(-(windows.agg(F.sum("n")).first()[0] or 0) // SHARD)
    if not shards:
        return flat, np.zeros(attention.ROWS, np.int64)
    groups = windows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard")
    dealt = stored(groups.applyInArrow(_joined, "number long, ids binary"), "shards", "zstd")
    schema = "part long, weight double, found array<float>"
    around, tasks = _averaged(dealt.mapInArrow(_profiler(id_counts), schema))
    of_rows = attention.cluster((around * np.float32(tasks)).reshape(attention.ROWS, -1))
    for rate in RATES:
        flat, _ = _averaged(dealt.mapInArrow(_trainer(flat, rate, id_counts, of_rows), schema))
    return flat, of_rows


def score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stored(gather(plain.withColumn("held", held_out(F.col("doc_id"))), path), "gathered", "zstd")
    words = stored(told.where("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "words")
    # At most as many rows as the vocabulary has ids.
    id_counts = np.zeros(IDS)
    for r in told.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():
        id_counts[r["key"]] = r["n"]
    windows = told.where("kind = 2").select("key", "n", "ids")
    # The end id may also stand inside texts, so they are counted apart.
    texts = told.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    flat, of_rows = learn(windows, id_counts)

    totals = words.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    tokens = (totals["n"] or 0) + texts
    distinct = totals["v"] + (texts > 0)
    popular = words.orderBy(F.desc("c"), "word").limit(POPULAR).toArrow()
    order = np.argsort(popular.column("word").to_numpy())
    known_words = popular.column("word").to_numpy()[order]
    known_logs = np.log10(popular.column("c").to_numpy()[order] + 0.1)
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    end_log = float(np.log10(texts + 0.1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, encode = Hasher(), Encoder(path, special=True)
        p, ids_known = attention.views(flat), attention.Vocabulary(id_counts, of_rows)
        for batch in batches:
            for first, last, data, at, ids, before, lengths in _texts(batch, encode):
                some = batch.slice(first, last - first)
                starts, ends, text = word_bounds(data, at)
                key = signed(hasher.ranges(hasher.sums(LOWER[data]), starts, ends))
                place = np.minimum(np.searchsorted(known_words, key), max(0, len(known_words) - 1))
                hit = known_words[place] == key if len(known_words) else np.zeros(len(key), bool)
                logs = np.where(hit, known_logs[place] if len(known_logs) else 0.0, -1.0)
                size = last - first
                number = np.bincount(text, minlength=size)
                base = np.bincount(text, weights=logs, minlength=size) + end_log - (number + 1) * norm
                known = np.bincount(text[hit], minlength=size) + int(texts > 0)
                rest, rest_text = key[~hit], text[~hit]
                cuts = np.searchsorted(rest_text, np.arange(size + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("key"), pa.array(number.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(rest))),
                        pa.array(attention.score(p, ids_known, ids, before, lengths)),
                    ],
                    ["doc_id", "n_tokens", "known", "base", "rest", "score"],
                )

    schema = "doc_id long, n_tokens long, known long, base double, rest array<long>, score double"
    scored = stored(told.where("kind = 4").select("key", "ids").mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words of which the popular ones are none stand at count 0 so far.
    more = (
        scored.select("row", F.explode("rest").alias("word"))
        .join(words, "word")
        .groupBy(F.col("row").alias("m_row"))
        .agg(F.sum(F.log10(F.col("c") + 0.1) + 1).alias("more"), F.count(F.lit(1)).alias("found"))
    )
    return scored.drop("rest").join(stored(more, "more"), F.col("row") == F.col("m_row"), "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
