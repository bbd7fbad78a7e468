"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ten words, and every text into the shingles (three
words in a row) that start at each word.  A window occurs only where all its shingles do,
so joining one of them is enough: its necessary prefix under the order by rarity in
the documents is the rarest one, and a window with a shingle that no document has is
dropped.  The shingle's place fixes where the window would lie (positional bound), which
must be inside the document (length bound); there the words are compared, exactly.

The shingles of the benchmark reach the documents by a join whose side Spark broadcasts
only if the stored table is under its threshold, and by shuffle beyond it.

Null texts, and texts without words, have no windows and no hits.  A row is judged by its
own text: rows are told apart by id and a hash of the text, so rows that share an id, or
have none, keep their own hits (equal rows have equal ones).
Items with equal windows are all counted; an item id that comes twice counts once, a null
item id is left out.  Empty tables on either side give no hits.  Other columns are not
carried along by :func:`contamination` and kept as they are by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import releasing, stored, unused
from fieldtally.llm.text import ascii_lower

WINDOW = 10
SHINGLE = 3
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART, -1), "")


def _row() -> list[Column]:
    """What tells rows apart."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def _shingles(hashes: Column, size: int) -> Column:
    """Hashes of ``size`` words in a row, from each word on."""
    last = F.size(hashes) - size
    one = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id and words of each window, once for an item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return (
        items.where(F.col("item_id").isNotNull() & (F.size("w") > 0))
        .select("item_id", "w", F.explode(starts).alias("start"))
        .select("item_id", F.slice("w", F.col("start"), WINDOW).alias("window"))
        .distinct()
    )


@releasing
def matches(docs: DataFrame, of_items: DataFrame) -> DataFrame:
    """doc_id, text_hash, start (from 0) and window of each occurrence; ``of_items`` has
    item_id and window."""
    spark = docs.sparkSession
    each = of_items.select("window").distinct()
    each = each.withColumn("k", F.least(F.size("window"), F.lit(SHINGLE)))
    hashed = F.transform("window", lambda w: F.xxhash64(w))
    # At most SHINGLE sizes; all items but those under three words have the same.
    sizes = sorted(r["k"] for r in each.select("k").distinct().collect())
    parts = [
        each.where(F.col("k") == k)
        .select("window", hashed.alias("h"))
        .select("window", F.posexplode(_shingles(F.col("h"), k)).alias("offset", "shingle"))
        .withColumn("k", F.lit(k))
        for k in sizes
    ]
    if not parts:
        return spark.createDataFrame([], "doc_id long, text_hash long, start int, window array<string>")
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.unionByName(part)
    wanted = stored(wanted, "shingles")
    keys = stored(wanted.select("k", "shingle").distinct(), "keys")
    texts = docs.select(*_row(), words(F.col("text")).alias("w"))
    hashes = texts.select("doc_id", "text_hash", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    found = None
    for k in sizes:
        some = (
            hashes.select("doc_id", "text_hash", F.size("h").alias("n"), F.posexplode(_shingles(F.col("h"), k)).alias("place", "shingle"))
            .join(keys.where(F.col("k") == k), "shingle")
            .select("doc_id", "text_hash", "n", "place", "k", "shingle")
        )
        found = some if found is None else found.unionByName(some)
    found = stored(found, "found")
    frequency = found.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("frequency"))
    ranked = wanted.join(frequency, ["k", "shingle"], "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "shingle", "offset", "k")).alias("rarest")
    )
    prefix = stored(
        ranked.where(F.col("rarest.frequency") > 0).select("window", "rarest.shingle", "rarest.offset", "rarest.k"), "prefix"
    )
    candidates = (
        found.join(prefix, ["k", "shingle"])
        .select("doc_id", "text_hash", "n", (F.col("place") - F.col("offset")).alias("start"), "window")
        .where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n")))
    )
    by_doc = candidates.groupBy(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash")).agg(F.collect_set(F.struct("start", "window")).alias("c"))
    by_doc = stored(by_doc, "candidates")
    # Whole texts are dealt by id, and cut into words after.
    whole = docs.select(*_row(), "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash")))
    verified = whole.select("doc_id", "text_hash", "c", words(F.col("text")).alias("w")).select(
        "doc_id",
        "text_hash",
        F.explode(
            F.filter("c", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["window"])) == c["window"])
        ).alias("m"),
    )
    return verified.select("doc_id", "text_hash", F.col("m.start").alias("start"), F.col("m.window").alias("window")).distinct()


@releasing
def hits_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """h_doc, h_hash, hit (words) and found (sorted item ids) of the documents with a match."""
    of_items = stored(windows(benchmark), "windows")
    found = matches(docs, of_items)
    hits = found.groupBy(F.col("doc_id").alias("h_doc"), F.col("text_hash").alias("h_hash")).agg(
        F.size(F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("start", "window")), lambda m: F.sequence(m["start"], m["start"] + F.size(m["window"]) - 1))))).alias("hit")
    )
    items = (
        found.select("doc_id", "text_hash", "window")
        .distinct()
        .join(of_items, "window")
        .groupBy(F.col("doc_id").alias("i_doc"), F.col("text_hash").alias("i_hash"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("found"))
    )
    same = F.col("h_doc").eqNullSafe(F.col("i_doc")) & (F.col("h_hash") == F.col("i_hash"))
    return hits.join(items, same).select("h_doc", "h_hash", "hit", "found")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted item ids), contaminated."""
    per_doc = hits_of(docs, benchmark)
    return (
        docs.select(*_row(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
        .join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("text_hash") == F.col("h_hash")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.col("hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("found").cast("long"), F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("found", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


@releasing
def hit_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """hit_doc and hit_hash of the documents with a match."""
    found = matches(docs, stored(windows(benchmark), "windows"))
    return found.select(F.col("doc_id").alias("hit_doc"), F.col("text_hash").alias("hit_hash")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, unchanged."""
    hit = hit_rows(docs, benchmark)
    key = unused(docs, "text_key")
    same = docs["doc_id"].cast("long").eqNullSafe(hit["hit_doc"]) & (F.col(key) == hit["hit_hash"])
    return docs.withColumn(key, F.xxhash64("text")).join(hit, same, "left_anti").drop(key)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )
