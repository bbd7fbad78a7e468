"""Language identification by Bayesian fusion of evidence.

Per text and language, in logarithms:

* the text's likelihood under character trigrams, learned from labelled documents;
  trigrams overlap, so the sum over a text of n of them counts as sqrt(n) of them;
* the declared language (markup), the address suffix: how often each value goes with
  each language, from grouped sums of the text posteriors over all rows;
* the host's prior: its own sums, smoothed towards its domain's, these towards those of
  all rows.  A row's own share is taken out, so no text votes for itself.

Null text is an empty text: only the other evidence speaks.  A null address or
declaration is a value of its own ("").  A text without letters, or one whose best
language stays under ``CONFIDENT``, is rejected.  Repeated rows are judged each by
itself; equal posteriors go to the language first in the alphabet.  An empty table gives
an empty result; without labelled documents nothing can be told: the language is null and
nothing is rejected.  Other input columns are left alone by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.tables import unused
from fieldtally.llm.text import blocks
from fieldtally.session import durable

#: Labelled documents of each language that the trigram model is learned from: those
#: with the smallest hashes of their ids.
SAMPLE = 500
#: Posterior under which a text is rejected.
CONFIDENT = 0.6
#: Rows' worth of weight of the wider group in a smoothed prior.
STRENGTH = 5.0

#: Classes of bytes: 0 apart, 1-26 letters, the others by their value.
CLASS = np.zeros(256, np.int64)
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = np.arange(1, 27)
CLASS[0x80:] = 27 + np.arange(128) % 37
GRAMS = 64**3


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the trigram at each byte, and whether it counts: it starts with a
    letter, or with the space before one, and lies in one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    c = CLASS[data]
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return c[:-2] * 4096 + c[1:-1] * 64 + c[2:], (c[1:-1] > 0) & (own[:-2] == own[2:])


class Model:
    """Logarithms of trigram probabilities, ``[language, trigram]``."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table

    def likelihoods(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: likelihoods ``[text, language]`` and counted trigrams."""
        gram, counts = trigrams(data, at)
        total = np.zeros((len(at) - 1, len(self.languages)))
        ends = np.minimum(at, len(gram))

        def sums(x: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            return running[ends[1:]] - running[ends[:-1]]

        for k in range(len(self.languages)):
            total[:, k] = sums(self.table[k][gram] * counts)
        return total, sums(counts)


def learn(docs: DataFrame) -> Model:
    """From ``SAMPLE`` labelled documents a language."""
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", F.col("lang").alias("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).drop("rank")
    # At most SAMPLE rows a language.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").collect()
    languages = sorted({r["label"] for r in texts})
    table = np.full((max(1, len(languages)), GRAMS), 0.05)
    for r in texts:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        gram, counts = trigrams(data, np.array([0, len(data)]))
        table[languages.index(r["label"])] += np.bincount(gram[counts], minlength=GRAMS)
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, table)


def visible(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(html, r"<[^>]*>", " ")


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """Posterior of each row of (id, text, declared, host).

    Gives id, language, confidence, text_language, n_grams and rejected.
    """
    spark, names, table = rows.sparkSession, model.languages, model.table
    each = range(len(names))
    if not names:
        return rows.select(
            F.col("id").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("language", "string"), ("confidence", "double"), ("text_language", "string"), ("n_grams", "long"))],
            F.lit(False).alias("rejected"),
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(names, table)
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                like, grams = model.likelihoods(data, at)
                like /= np.sqrt(np.maximum(grams, 1))[:, None]
                like -= like.max(axis=1, keepdims=True, initial=-np.inf) if len(names) else 0
                kept = [batch.column(n).slice(first, last - first) for n in ("id", "declared", "host")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(grams.astype(np.int64)), *(pa.array(like[:, k]) for k in each)],
                    ["id", "declared", "host", "n_grams", *(f"t{k}" for k in each)],
                )

    declared = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), "^([A-Za-z]*)", 1))
    plain = rows.select(
        F.col("id").cast("long"),
        F.when(declared.isin(names), declared).otherwise(F.when(declared == "", "").otherwise("?")).alias("declared"),
        F.lower(F.coalesce("host", F.lit(""))).alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "id long, declared string, host string, n_grams long, " + ", ".join(f"t{k} double" for k in each)
    scored = plain.mapInArrow(work, schema.rstrip(", "))
    total = sum((F.exp(f"t{k}") for k in each), F.lit(0.0))
    scored = scored.select("*", *[(F.exp(f"t{k}") / total).alias(f"p{k}") for k in each])
    scored = durable(
        scored.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1)).withColumn(
            "domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
        )
    )

    def sums(prefix: str) -> list[Column]:
        return [F.sum(f"p{k}").alias(f"{prefix}{k}") for k in each]

    # One row a host, domain and suffix; grouped first in each task, so a host with a
    # third of the rows is a row a task.
    hosts = scored.groupBy("host", "domain", "suffix").agg(*sums("h"))
    domains = scored.groupBy(F.col("domain").alias("d_domain")).agg(*sums("d"))
    suffixes = scored.groupBy(F.col("suffix").alias("s_suffix")).agg(*sums("s"))
    known = durable(
        hosts.join(domains, hosts.domain == domains.d_domain)
        .join(suffixes, hosts.suffix == suffixes.s_suffix)
        .select(F.col("host").alias("k_host"), *[f"{x}{k}" for x in "hds" for k in each])
    )
    # As many rows as languages and two more.
    spoken = {r["declared"]: [r[f"c{k}"] for k in each] for r in scored.groupBy("declared").agg(*sums("c")).collect()}
    overall = [sum(v[k] for v in spoken.values()) for k in each]
    everything = sum(overall) or 1.0

    joined = scored.join(known, scored.host == known.k_host)
    own = [F.col(f"p{k}") for k in each]

    def prior(prefix: str, wider: list[Column]) -> list[Column]:
        left = [F.greatest(F.lit(0.0), F.col(f"{prefix}{k}") - own[k]) for k in each]
        size = sum(left, F.lit(0.0))
        return [(left[k] + STRENGTH * wider[k]) / (size + STRENGTH) for k in each]

    world = [F.lit((overall[k] + 1) / (everything + len(names))) for k in each]
    host_prior = prior("h", prior("d", world))
    evidence = []
    for k in each:
        said = F.lit(0.0)
        for value, found in spoken.items():
            share = (found[k] + 0.5) / (overall[k] + 0.5 * (len(names) + 2))
            said = F.when(F.col("declared") == value, F.lit(float(np.log(share)))).otherwise(said)
        ending = F.log((F.greatest(F.lit(0.0), F.col(f"s{k}") - own[k]) + 0.5) / (overall[k] + 1.0))
        evidence.append(F.col(f"t{k}") + said + ending + F.log(host_prior[k]))
    joined = joined.select("id", "declared", "n_grams", *own, *[e.alias(f"e{k}") for k, e in enumerate(evidence)])

    def best(prefix: str) -> Column:
        top = F.greatest(*[F.col(f"{prefix}{k}") for k in each]) if len(names) > 1 else F.col(f"{prefix}0")
        return F.coalesce(*[F.when(F.col(f"{prefix}{k}") == top, F.lit(names[k])) for k in each])

    top = F.greatest(*[F.col(f"e{k}") for k in each]) if len(names) > 1 else F.col("e0")
    confidence = 1 / sum((F.exp(F.col(f"e{k}") - top) for k in each), F.lit(0.0))
    return joined.select(
        "id", best("e").alias("language"), confidence.alias("confidence"), best("p").alias("text_language"), "n_grams"
    ).withColumn("rejected", (F.col("n_grams") == 0) | (F.col("confidence") < CONFIDENT))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    return identify(
        pages.select(
            F.col("page_id").alias("id"),
            visible(F.col("html")).alias("text"),
            F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
            host_of(F.col("url")).alias("host"),
        ),
        model,
    )


def _row_key() -> Column:
    """A name of a row by all that is judged of it and its id.  Rows that share an id, or
    have none, are rows of their own; equal rows are judged alike."""
    names = ("doc_id", "text", "lang", "source")
    return F.xxhash64(*names, *[F.col(n).isNull() for n in names])


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is clear, unchanged.  Rows are judged one by one, also
    where ids repeat or are null."""
    found = identify(docs.select(_row_key().alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")), learn(docs))
    rejected = durable(found.where("rejected").select(F.col("id").alias("rejected_id")).distinct())
    key = unused(docs, "rejected_key")
    return docs.withColumn(key, _row_key()).join(rejected, F.col(key) == rejected["rejected_id"], "left_anti").drop(key)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    model = learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).withColumnRenamed("id", "page_id")
