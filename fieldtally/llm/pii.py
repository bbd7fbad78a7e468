"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IP, card, phone) come from patterns and checks.  Other
identifiers are found by what stands around them.  Values stand in lexical contexts: the two
words before them, the two words after them, a name with "=" or ":" before them, or their own
first four characters if they are written in capitals and digits.  Contexts and values form a
graph.  Seeds are the values that look random (long, letters and digits mixed) or hold a base
entity; a context is as sure as its values are on average, a value as sure as its surest
context, in turns; other values without a digit or shorter than ``LEAST`` count against a context.  Between words a value
is a run of tokens that hold a digit or "@", and each time another word stands in its place
counts against the words.  The values of contexts that end up sure, and are met with at
least ``SUPPORT`` different values, are reported as identifiers, random-looking or not.

Positions are code points.  Null text is an empty text without spans.  A doc_id that comes
twice is searched row by row, and each row is returned with the spans of its own text.  An
empty table gives an empty result.  Other columns are left alone by :func:`masked`.

No pattern backtracks over a long run: runs are matched possessively, and only from
where a run begins or the match before ended, which is where the leftmost match starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.tables import releasing, stored, unused

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NAMED = r"""(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]*+\x20?[=:]\x20?"?[A-Za-z0-9][A-Za-z0-9_+/.=~-]{5,}+"""
CAPITALS = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Z])(?=[A-Z]*+[0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])"
#: Tokens with a digit or "@", a space apart.
WORDED = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

KINDS = ("email", "ip", "card", "phone")
#: Confidence and number of different values from which a context is believed.
SURE = 0.8
SUPPORT = 3
TURNS = 4
#: Shortest identifier.
LEAST = 6
#: Most contexts that all tasks know by their keys.
KNOWN = 100_000

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(kind: str, needed: Column, text: Column, pattern: str) -> Column:
    """Each match of a kind in order, with the length of the gap before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    one = lambda g, v: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value"))
    empty = F.array().cast("array<struct<kind:string,gap:int,size:int,value:string>>")
    return F.when(needed, F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, one)).otherwise(empty)


def _with_worded(found: DataFrame) -> DataFrame:
    """``found`` (with the text ``t``) and ``worded``: as :func:`_matches`, with the end of the
    text before each match (backwards) and the begin of the text after it, up to two words of
    either: one pattern match a gap.

    Matches and gaps are columns of their own first, so that the texts are searched once for
    each, and only those with a digit or "@" are.
    """
    text, needed = F.col("t"), F.col("t").rlike("[0-9@]")
    found = found.withColumns({
        "w_found": F.when(needed, F.regexp_extract_all(text, F.lit(WORDED), F.lit(0))), "w_gaps": F.when(needed, F.split(text, WORDED, -1)),
    })
    matches, gaps = F.col("w_found"), F.col("w_gaps")
    pair = lambda t: F.regexp_extract(t, r"^\s*+\S++(?:\s++\S++)?", 0)
    one = lambda g, v: F.struct(
        F.lit("worded").alias("kind"), F.length(g).alias("gap"), F.length(v).alias("size"), v.alias("value"), pair(F.reverse(g)).alias("ahead")
    )
    both = lambda m, g: F.struct(*[m[n].alias(n) for n in ("kind", "gap", "size", "value", "ahead")], pair(g).alias("behind"))
    worded = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, one), F.slice(gaps, F.lit(2), F.size(matches)), both)
    return found.withColumn("worded", worded).drop("w_found", "w_gaps")


def _with_contexts(worded: DataFrame) -> DataFrame:
    """The two words before and after each match as contexts; "" stands for a word that is
    missing as the text or another value is there."""
    words = lambda t: F.split(F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), " ")
    return worded.withColumns({"ahead": words(F.reverse("ahead")), "behind": words(F.col("behind"))}).withColumns(
        {"ahead": _context("b", *_two(F.col("ahead"), True)), "behind": _context("a", *_two(F.col("behind"), False))}
    )


def _two(words: Column, last: bool) -> tuple[Column, Column]:
    """Two words of at most two; a missing one is the one further from the value."""
    lone = F.size(words) < 2
    if last:
        return F.when(lone, "").otherwise(words[0]), F.when(lone, words[0]).otherwise(F.try_element_at(words, F.lit(2)))
    return words[0], F.when(lone, "").otherwise(F.try_element_at(words, F.lit(2)))


def _context(side: str, one: Column, two: Column) -> Column:
    """Two words as a context; null without words."""
    return F.when((one != "") | (two != ""), F.concat_ws(" ", F.lit(f"{side}:"), one, two))


def _against(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, against: how often a plain word stands where a value would, for the
    worded ones of ``contexts``.

    Words are counted by the 64-bit key of their context before contexts are joined, so that
    the join has one row a context and none for a place in a text.  The keys of few contexts
    are known to all tasks, which count no others.
    """
    worded = contexts.where("context like 'a: %' or context like 'b: %'").select("context").distinct()
    words = F.split(F.substring("context", 4, 1 << 30), " ", -1)
    wanted = stored(worded.select("context", F.xxhash64(F.substring("context", 1, 1), words[0], words[1]).alias("key")), "wanted")
    known = [r["key"] for r in wanted.select("key").limit(KNOWN + 1).collect()]

    tokens = F.regexp_extract_all("t", F.lit(r"\S++"), F.lit(0))
    plain = F.transform(tokens, lambda w: F.when(w.rlike("[0-9@]"), "").otherwise(F.lower(w)))
    edge = F.array(F.lit(""))
    padded = docs.select(F.concat(edge, plain, edge).alias("w")).where(F.size("w") > 3)
    three = padded.select(F.inline(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.size("w")).alias("y"), F.slice("w", F.lit(3), F.size("w")).alias("z"))))
    sides = F.array(
        F.when(F.col("z") != "", F.xxhash64(F.lit("b"), F.col("x"), F.col("y"))), F.when(F.col("x") != "", F.xxhash64(F.lit("a"), F.col("y"), F.col("z")))
    )
    each = three.toDF("x", "y", "z").where("y != ''").select(F.explode(sides).alias("key")).where("key is not null")
    if len(known) <= KNOWN:
        each = each.where(f"key in ({', '.join(map(str, known))})" if known else "false")
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("against"))
    return stored(counted.join(wanted, "key").select("context", "against"), "against")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's checks."""
    size = F.length(_digits(value))
    card = F.when(size.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    ip = value.rlike(f"^{PART}(?:\\.{PART}){{3}}$")
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", size.between(9, 15)).otherwise(F.lit(True))


def _all_matches(text: Column) -> Column:
    digit = text.rlike("[0-9]")
    has = lambda c: F.contains(text, F.lit(c))
    return F.concat(
        _matches("email", has("@"), text, EMAIL),
        _matches("ip", digit & has("."), text, IP),
        _matches("card", digit, text, CARD),
        _matches("phone", has("+"), text, PHONE),
        _matches("named", has("=") | has(":"), text, NAMED),
        _matches("capitals", text.rlike("[A-Z0-9]{16}"), text, CAPITALS),
    )


def _near(placed: DataFrame, worded: DataFrame) -> DataFrame:
    """row, start, end, value and context of what may be an identifier."""
    told = F.regexp_replace("value", '^[A-Za-z0-9_-]+ ?[=:] ?"?', "")
    # Full stops at the end are the sentence's.
    value = F.rtrim(told, F.lit("."))
    name = F.regexp_replace(F.lower(F.regexp_extract("value", "^[A-Za-z0-9_-]+ ?[=:]", 0)), " ", "")
    named = placed.where("kind = 'named'").where(F.length(value) >= LEAST).select(
        "row", (F.col("end") - F.length(told)).alias("start"), (F.col("end") - F.length(told) + F.length(value)).alias("end"), value.alias("value"), name.alias("context")
    )
    capitals = placed.where("kind = 'capitals'").select("row", "start", "end", "value", F.substring("value", 1, 4).alias("context"))
    # Brackets, quotes and points around a value are the sentence's, a name before it is none of it.
    left = F.regexp_replace("value", "^[\"'(\\[<]*+(?:[A-Za-z_][A-Za-z0-9_-]*+[=:]\"?)?", "")
    inner = F.rtrim(left, F.lit(".,;:!?\"')]>"))
    inner = worded.withColumn("start", F.col("end") - F.length(left)).withColumn("value", inner).where("value != ''")
    inner = inner.withColumn("end", F.col("start") + F.length("value"))
    sides = [inner.select("row", "start", "end", "value", F.col(side).alias("context")).where(F.col(side).isNotNull()) for side in ("ahead", "behind")]
    return named.union(capitals).union(sides[0]).union(sides[1])


def _known(near: DataFrame, base: DataFrame) -> DataFrame:
    """``near`` with whether a row overlaps a base span: the furthest end of the spans
    that start before its own end, in one pass over each text's rows."""
    near = near.withColumn("at", F.col("end")).withColumn("base_end", F.lit(None).cast("int"))
    spans_ = base.select("row", "start", "end", F.lit("").alias("value"), F.lit("").alias("context"), F.col("start").alias("at"), F.col("end").alias("base_end"))
    before = Window.partitionBy("row").orderBy("at", F.col("base_end").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = near.union(spans_).withColumn("furthest", F.max("base_end").over(before))
    known = F.coalesce(F.col("furthest") > F.col("start"), F.lit(False))
    return every.where("base_end is null").select("row", "start", "end", "value", "context", known.alias("known"))


def _random_looking(value: Column) -> Column:
    digits = F.length(_digits(value))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return (F.length(value) >= 16) & (digits >= 2) & (letters >= 2)


def score(graph: DataFrame, against: DataFrame) -> DataFrame:
    """Contexts that are sure.  ``graph``: context, value, seed, one row an edge;
    ``against``: context and how often something else stood there.

    Each turn groups the edges by context and joins the result back, then by value.
    """
    edges = graph.withColumn("sure", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0))).withColumn(
        "plain", ~F.col("seed") & (~F.col("value").rlike("[0-9]") | (F.length("value") < LEAST))
    )
    for _ in range(TURNS):
        contexts = stored(
            edges.groupBy("context")
            .agg(F.sum(F.when(F.col("plain"), 0.0).otherwise(F.col("sure"))).alias("total"), F.count(F.lit(1)).alias("support"))
            .join(against, "context", "left")
            .select("context", (F.col("total") / (F.col("support") + F.coalesce("against", F.lit(0)) + 0.5)).alias("context_sure"), "support"),
            "contexts",
        )
        values = stored(
            edges.join(contexts, "context").groupBy("value").agg(F.max("context_sure").alias("value_sure")), "values"
        )
        edges = stored(
            edges.join(values, "value").select("context", "value", "seed", "plain", F.greatest(F.when(F.col("seed"), 1.0).otherwise(0.0), "value_sure").alias("sure")),
            "edges",
        )
    return contexts.where((F.col("context_sure") >= SURE) & (F.col("support") >= SUPPORT)).select("context")


@releasing
def spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the text's hash and the spans of each kind, identifiers last
    (``other``), without those that overlap a base span."""
    text = F.col("t")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = _with_worded(found).select("doc_id", F.xxhash64("t").alias("text_hash"), _all_matches(text).alias("m"), "worded")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "matches")
    # Gaps and matches take turns; a window holds the matches of one text and kind.
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = found.where(F.size("m") > 0).select("row", F.posexplode("m").alias("pos", "m")).select("row", "pos", "m.*")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    placed = each.where(_valid(F.col("kind"), F.col("value"))).select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")
    placed = stored(placed, "placed")
    span = F.struct("start", "end", "value")
    by_row = placed.where(F.col("kind").isin(*KINDS)).groupBy(F.col("row").alias("b_row")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, span))).alias(k) for k in KINDS]
    )
    by_row = stored(by_row, "base")
    worded = found.where(F.size("worded") > 0).select("row", F.posexplode("worded").alias("pos", "m")).select("row", "pos", "m.*")
    worded = worded.withColumn("kind", F.lit("worded")).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    near = stored(_known(_near(placed, _with_contexts(worded)), placed.where(F.col("kind").isin(*KINDS))), "near")
    graph = near.groupBy("context", "value").agg(F.max(F.col("known") | _random_looking(F.col("value"))).alias("seed"))
    # Words around too few values are never believed, and lift no value either.
    graph = stored(graph, "graph")
    hopeful = graph.groupBy("context").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    hopeful = stored(hopeful.select("context"), "hopeful")
    words = F.col("context").like("a: %") | F.col("context").like("b: %")
    graph = stored(graph.where(~words).union(graph.where(words).join(hopeful, "context", "left_semi")), "graph")
    against = _against(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")), hopeful)
    sure = stored(score(graph, against), "sure")
    other = (
        near.where(~F.col("known") & (F.length("value") >= LEAST))
        .join(sure, "context")
        .groupBy(F.col("row").alias("o_row"))
        .agg(F.sort_array(F.collect_set(span)).alias("other"))
    )
    none = F.array().cast(_SPAN)
    whole = found.select("row", "doc_id", "text_hash").join(by_row, F.col("row") == F.col("b_row"), "left")
    return whole.join(stored(other, "other"), F.col("row") == F.col("o_row"), "left").select(
        "doc_id", "text_hash", *[F.coalesce(k, none).alias(k) for k in (*KINDS, "other")]
    )


def _told(kinds: tuple[str, ...]) -> Column:
    one = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.concat_ws(",", *[one(k) for k in kinds])


def masked(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, and ``n_chars``,
    if there is one, as it is then."""
    found = spans(docs)

    def tags_of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    tagged = F.concat(*[tags_of(k) for k in (*KINDS, "other")])
    # Rows that share an id are told apart by their text's hash.
    per_doc = found.select(F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_hash"), tagged.alias("tags"))
    per_doc = stored(per_doc.where(F.size("tags") > 0).dropDuplicates(["s_doc", "s_hash"]), "tags")
    # Names that the documents do not have.
    own_id, own_hash, s_doc, s_hash, tags = (unused(docs, n) for n in ("own_id", "own_hash", "s_doc", "s_hash", "tags"))
    per_doc = per_doc.toDF(s_doc, s_hash, tags)
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), s["tag"])
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"),
        )

    changed = F.aggregate(F.sort_array(tags), start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    out = keyed.join(per_doc, F.col(own_id).eqNullSafe(F.col(s_doc)) & (F.col(own_hash) == F.col(s_hash)), "left")
    out = out.withColumn("text", F.when(F.col(s_hash).isNull(), F.col("text")).otherwise(changed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s_hash).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_told(KINDS), 256).alias("base_sha256"),
        _told((*KINDS, "other")).alias("spans"),
    )
