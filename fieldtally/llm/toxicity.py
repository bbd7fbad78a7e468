"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a run of letters, lower-cased; its vector is the mean of the vectors of its
character n-grams, so a misspelling unseen in training shares most of a known word's.
The words of a segment (24 in a row, each half overlapping the next) are averaged into
a softmax over two classes, and a document's odds are the sum of its segments' odds: a
few words decide, however long the document.  Vectors and softmax are trained jointly
in numpy.

Learning uses at most ``SAMPLE`` labelled documents of each class, those with the
smallest hashes of their ids among the rows to learn from.  Null text is an empty text
and gets the score of a document without words.  Rows without a label, and labels
without a document, teach nothing; labels given twice count as toxic if one says so.
Repeated rows are scored each by itself; an empty table gives an empty result.  Only the
id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.text import LOWER, blocks, mix

SAMPLE = 2000
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 16
SEGMENT = 24
#: An n-gram found in fewer than one in so many training documents is not learned.
RARE = 250
#: Weight of the vectors' squared size beside the loss.
DECAY = 3e-6

APART = np.ones(256, bool)
APART[0x61:0x7B] = False
APART[0x80:] = False


def _padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with 0 for what is no letter and around each text; start, end and text of
    the words."""
    rows = len(at) - 1
    own = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros(len(data) + rows + 1, np.uint8)
    low = LOWER[data]
    low[APART[low]] = 0
    out[np.arange(len(data)) + own + 1] = low
    letter = out > 0
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    return out, starts, ends, np.searchsorted(at + np.arange(rows + 1), starts - 1, side="right") - 1


def _codes(padded: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each place on."""
    size = max(0, len(padded) - n + 1)
    code = np.zeros(size, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | padded[j : j + size]
    return (mix(code, n) % np.uint64(BUCKETS)).astype(np.int64)


def word_scores(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Mean of the n-grams' values for each word, with its edges as characters."""
    total, number = np.zeros(len(starts)), np.zeros(len(starts))
    for n in SIZES:
        running = np.concatenate([[0.0], np.cumsum(value[_codes(padded, n)], dtype=np.float64)])
        # A word of fewer bytes has none, also where it ends the block.
        first = np.minimum(starts - 1, len(running) - 1)
        last = np.maximum(ends + 2 - n, first)
        total += running[last] - running[first]
        number += last - first
    return total / np.maximum(number, 1)


def segment_bounds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last and text of each segment, for texts with so many
    words in a row; a text without words has one empty segment."""
    half = SEGMENT // 2
    number = np.maximum(1, -(-(words - half) // half))
    text = np.repeat(np.arange(len(words)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.concatenate([[0], np.cumsum(words)])
    first = begin[text] + nth * half
    return first, np.minimum(first + SEGMENT, begin[text + 1]), text


class Model:
    def __init__(self, value: np.ndarray, bias: float) -> None:
        #: Product of each n-gram's vector with the difference of the softmax weights.
        self.value, self.bias = value, bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        padded, starts, ends, text = _padded(data, at)
        words = word_scores(padded, starts, ends, self.value)
        first, last, owner = segment_bounds(np.bincount(text, minlength=len(at) - 1))
        running = np.concatenate([[0.0], np.cumsum(words)])
        odds = np.exp(np.clip((running[last] - running[first]) / np.maximum(last - first, 1) + self.bias, -50, 50))
        total = np.bincount(owner, weights=odds, minlength=len(at) - 1)
        return total / (1 + total)


def train(texts: list[bytes], toxic: np.ndarray, steps: int = 100, rate: float = 0.1) -> Model:
    """Full-batch Adam on the mean log-loss, clean documents weighing three times as
    much as toxic ones: what is flagged goes."""
    if not len(texts) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(texts) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    rng = np.random.default_rng(7)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    padded, starts, ends, text = _padded(np.frombuffer(b"".join(texts), np.uint8), at)
    # Each distinct word once, as its n-grams in a row.
    spelled = [padded[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    index: dict[bytes, int] = {}
    word = np.array([index.setdefault(w, len(index)) for w in spelled], np.int64)
    own, w_start, w_end, _ = _padded(np.frombuffer(b" ".join(index), np.uint8), np.array([0, sum(map(len, index)) + max(0, len(index) - 1)]))
    grams, of_word = [], []
    for n in SIZES:
        number = np.maximum(w_end + 3 - n - w_start, 0)
        which = np.repeat(np.arange(len(w_start)), number)
        place = w_start[which] - 1 + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        grams.append(_codes(own, n)[place])
        of_word.append(which)
    gram, which = np.concatenate(grams), np.concatenate(of_word)
    size = np.maximum(np.bincount(which, minlength=len(index)), 1)
    # A rare n-gram is left at zero: it could only be learned by heart.
    pairs = np.unique(word * len(texts) + text) // len(texts)
    in_texts = np.bincount(pairs, minlength=len(index))
    often = np.bincount(gram, weights=in_texts[which], minlength=BUCKETS) >= max(3, len(texts) / RARE)
    learned = np.flatnonzero(often)
    which = which[often[gram]]
    gram = np.searchsorted(learned, gram[often[gram]])
    first, last, owner = segment_bounds(np.bincount(text, minlength=len(texts)))
    length = np.maximum(last - first, 1)
    weight = np.where(toxic == 1, 0.25 / (toxic == 1).sum(), 0.75 / (toxic == 0).sum())
    vectors = rng.normal(0, 0.1, (len(learned), WIDTH)).astype(np.float32)
    soft = rng.normal(0, 1, WIDTH).astype(np.float32)
    bias = -3.0
    held = [np.zeros_like(vectors), 0.0, np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0]
    for step in range(1, steps + 1):
        value = vectors @ soft
        of = np.bincount(which, weights=value[gram], minlength=len(index)) / size
        running = np.concatenate([[0.0], np.cumsum(of[word])])
        odds = np.exp(np.clip((running[last] - running[first]) / length + bias, -50, 50))
        total = np.bincount(owner, weights=odds, minlength=len(texts))
        error = weight * (total / (1 + total) - toxic)
        by_segment = error[owner] * odds / total[owner]
        # Back through segments, words and n-grams: one number each.
        share = by_segment / length
        change = np.bincount(first, weights=share, minlength=len(word) + 1)
        change -= np.bincount(last, weights=share, minlength=len(word) + 1)
        by_word = np.bincount(word, weights=np.cumsum(change[:-1]), minlength=len(index)) / size
        by_gram = np.bincount(gram, weights=by_word[which], minlength=len(learned))
        d_soft = by_gram @ vectors + 1e-5 * soft
        d_bias = by_segment.sum()
        # A vector's gradient is its n-gram's number times the softmax weights.
        d_vectors = np.outer(by_gram, soft).astype(np.float32) + DECAY * vectors
        held[0] = 0.9 * held[0] + 0.1 * d_vectors
        held[1] = 0.99 * held[1] + 0.01 * float((d_vectors**2).sum()) / max(1, len(learned))
        held[2] = 0.9 * held[2] + 0.1 * d_soft
        held[3] = 0.99 * held[3] + 0.01 * d_soft**2
        held[4] = 0.9 * held[4] + 0.1 * d_bias
        held[5] = 0.99 * held[5] + 0.01 * d_bias**2
        one, two = 1 - 0.9**step, 1 - 0.99**step
        vectors -= rate * (held[0] / one) / (np.sqrt(held[1] / two) + 1e-7)
        soft -= (rate * (held[2] / one) / (np.sqrt(held[3] / two) + 1e-7)).astype(np.float32)
        bias -= rate * (held[4] / one) / (np.sqrt(held[5] / two) + 1e-7)
    value = np.zeros(BUCKETS, np.float32)
    value[learned] = vectors @ soft
    return Model(value, float(bias))


def learn(docs: DataFrame, labels: DataFrame, use: F.Column) -> Model:
    """From labelled documents for which ``use`` (an expression on doc_id) holds."""
    told = labels.where(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE)
    # At most SAMPLE rows a class, so one task holds them; the scan before it stays spread out.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sorted((d, t or "", y) for b in batches for d, t, y in zip(*(c.to_pylist() for c in b.columns)))
        model = train([t.encode() for _, t, _ in told], np.array([y for *_, y in told], float))
        yield pa.RecordBatch.from_arrays([pa.array([model.value.tobytes()]), pa.array([model.bias])], ["value", "bias"])

    found = rows.select("doc_id", "text", F.col("toxic").cast("double")).repartition(1).mapInArrow(work, "value binary, bias double").first()
    if found is None:
        return train([], np.zeros(0))
    return Model(np.frombuffer(found["value"], np.float32), found["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    value, bias = model.value.astype(np.float32), model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(value, bias)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text"), 1 << 19):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(model.score(data, at))], ["doc_id", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def fold(doc_id: F.Column, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; 1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
