"""Quality rules by weak supervision.

Each rule votes on a document: good, bad, or it abstains.  The votes of all
documents are counted by vote pattern (at most 3 to the number of rules, whatever
the corpus size); expectation-maximisation on those counts estimates how often each
rule votes on good and on bad documents and how often it is right; the posterior
probability of quality then decides, in place of a filter that every rule must pass.

Null text is an empty text.  Empty and very short texts fail the base rule.  Ties and
repeated rows are judged row by row; an empty table gives an empty result.  Columns of
the input other than the id and the text are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import SPACE, Hasher, blocks, covered, mix, shingles, word_bounds
from fieldtally.session import durable

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0xC0:] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
SHOUT = np.zeros(256, bool)
SHOUT[ord("!")] = True

#: Posterior probability of quality from which a document stays.
KEEP = 0.5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_upper", "n_letters", "n_stops",
    "n_shouts",
)
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All \\n-split lines of all texts; an empty text is one empty line."""
    cut = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([at[:-1], cut + 1])
    text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, cut, side="right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.concatenate([starts[1:] - 1, [0]])
    last = np.concatenate([text[1:] != text[:-1], [True]])
    ends[last] = at[1:][text[last]]
    return starts, ends, text


def _found_before(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one of their text."""
    order = np.lexsort((np.arange(len(key)), key, text))
    before = np.zeros(len(key), bool)
    before[order[1:]] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    return before


def _found_twice(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which keys are in their text twice or more."""
    own = mix(key ^ mix(text.astype(np.uint64)))
    ranked = np.sort(own)
    many = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(many):
        return np.zeros(len(key), bool)
    return many[np.minimum(np.searchsorted(many, own), len(many) - 1)] == own


def measure_block(hasher: Hasher, data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the texts of one block."""
    rows = len(at) - 1
    per = lambda which: np.bincount(which, minlength=rows).astype(np.int64)

    def bytes_that(mask: np.ndarray) -> np.ndarray:
        running = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=running[1:])
        return running[at[1:]] - running[at[:-1]]

    starts, ends, text = word_bounds(data, at)
    sums = hasher.sums(data)
    words = hasher.ranges(sums, starts, ends)
    key, whole = shingles(words, text, 8)
    at8 = np.flatnonzero(whole)
    twice = _found_twice(key[at8], text[at8])
    repeated = covered(at8[twice], 8, len(words)) if len(words) else np.zeros(0, bool)
    l_start, l_end, l_text = _line_bounds(data, at)
    filled = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_text = l_start[filled], l_end[filled], l_text[filled]
    before = _found_before(hasher.ranges(sums, l_start, l_end), l_text)
    inside = ~SPACE[data] & ((data & 0xC0) != 0x80)
    return {
        "n_words": per(text),
        "word_chars": bytes_that(inside),
        "n_symbols": bytes_that(SYMBOLS[data]),
        "n_dup_lines": per(l_text[before]),
        "n_repeat_words": per(text[repeated]),
        "n_lines": per(l_text),
        "n_bytes": np.diff(at),
        "n_upper": bytes_that(UPPER[data]),
        "n_letters": bytes_that(LETTER[data]),
        "n_stops": bytes_that(STOPS[data]),
        "n_shouts": bytes_that(SHOUT[data]),
    }


def measures(docs: DataFrame) -> DataFrame:
    """One row of counts per document, over its whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                found = measure_block(hasher, data, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first)] + [pa.array(found[m]) for m in MEASURES],
                    ["doc_id", *MEASURES],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, _SCHEMA)


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: F.Column | None, good: F.Column | None = None) -> F.Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def votes() -> dict[str, F.Column]:
    """Rules: -1 bad, 1 good, 0 abstains.  Ratios are compared as products, so an
    empty text divides by nothing.  Rules that look for one defect abstain where they
    do not find it: its absence says little."""
    c = F.col
    return {
        "v_length": _vote(c("n_words") < 20, c("n_words") >= 50),
        "v_repeats": _vote(100 * c("n_repeat_words") > 25 * c("n_words")),
        "v_symbols": _vote(100 * c("n_symbols") > 20 * c("n_words")),
        "v_lines": _vote(100 * c("n_dup_lines") > 30 * c("n_lines")),
        "v_word_size": _vote(
            (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
            c("word_chars").between(4 * c("n_words"), 8 * c("n_words")),
        ),
        "v_capitals": _vote(100 * c("n_upper") > 25 * c("n_letters")),
        "v_shouts": _vote(100 * c("n_shouts") > 20 * c("n_words")),
        "v_stops": _vote(c("n_stops") * 100 < c("n_words"), c("n_stops").between(c("n_words") / 50, c("n_words") / 2)),
    }


#: Votes (bad, abstain, good) before anything is learned: of good documents, and of bad
#: ones by the rule that names their defect and by the others.
GOOD, NAMED, OTHER = (0.005, 0.5, 0.495), (0.9, 0.08, 0.02), (0.05, 0.6, 0.35)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation on vote patterns (rows of -1, 0, 1) with counts.

    Bad documents come in kinds, one for each rule to start with: defects exclude one
    another more often than they meet, which two classes alone can't say.  Gives the
    shares of the classes (0 good, then the kinds of bad), the probabilities
    ``[class, rule, vote]`` (vote 0 bad, 1 abstain, 2 good) and the probability that a
    document with each pattern is good.  Pseudo-counts keep probabilities off 0 and 1.
    """
    rules = patterns.shape[1]
    vote = patterns + 1
    start = np.empty((1 + rules, rules, 3))
    start[0], start[1:] = GOOD, OTHER
    start[np.arange(1, 1 + rules), np.arange(rules)] = NAMED
    share = np.array([0.8] + [0.2 / rules] * rules)
    table, posterior = start.copy(), np.zeros(len(counts))
    hits = np.stack([vote == v for v in range(3)]).astype(float)  # vote, pattern, rule
    for _ in range(rounds):
        like = np.log(table[:, np.arange(rules), vote]).sum(axis=2) + np.log(share)[:, None]
        like = np.exp(like - like.max(axis=0))
        like /= like.sum(axis=0)
        done = np.abs(like[0] - posterior).max(initial=0) < 1e-9
        posterior, weight = like[0], like * counts
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 1 + rules)
        table = np.einsum("kp,vpj->kjv", weight, hits) + 2 * start
        table /= table.sum(axis=2, keepdims=True)
        if done:
            break
    return share, table, posterior


def judge(docs: DataFrame) -> DataFrame:
    """Measures, votes, posterior probability of quality and verdict per document."""
    spark = docs.sparkSession
    rules = votes()
    measured = durable(measures(docs))  # small: counts instead of texts
    voted = measured.select("*", *[v.alias(k) for k, v in rules.items()])
    # At most 3 ** 8 patterns, whatever the number of documents.
    seen = voted.groupBy(*rules).count().collect()
    patterns = np.array([[r[k] for k in rules] for r in seen], dtype=np.int64).reshape(len(seen), len(rules))
    _, _, posterior = fit(patterns, np.array([r["count"] for r in seen], float))
    known = spark.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, posterior)],
        ", ".join(f"{k} int" for k in rules) + ", posterior double",
    )
    return (
        voted.join(F.broadcast(known), list(rules), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= KEEP))
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
