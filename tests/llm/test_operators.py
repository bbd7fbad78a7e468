"""Operators on small tables against plain versions, and on awkward rows."""

import collections
import math
import os
import random
import re
import tracemalloc
import zlib

import brute
import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import (
    attention, decontamination, graphs, jaccard, language, merging, packing, pii, quality, scoring, substrings, suffixes, toxicity,
)
from fieldtally.llm import tables
from fieldtally.llm import text as text_module
from fieldtally.llm.queries import ORACLE_SQL, QUERIES

LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
OTHER = "Some quite different words stand here, so that a text has a begin and an end of its own, " * 3
LONG = " ".join(f"w{i * i % 4001}" for i in range(60_000))

#: doc_id, text, lang, source, n_chars
AWKWARD = [
    (1, LINE, "en", "a", 1),
    (2, LINE, "en", "a", 1),
    (3, "before it " + LINE.upper() + "\nand after", "en", "a", 1),
    (4, "before it " + LINE + "\nand after", None, None, None),
    (5, None, "en", "a", None),
    (6, "", "en", None, 0),
    (7, " \n\t ", "de", "b", 4),
    (8, OTHER + LINE + OTHER, "de", "b", 9),
    (8, OTHER + LINE + OTHER, "de", "b", 9),
    (9, "ab " * 300, "fr", "b", 9),
    (10, LONG, "fr", "c", 9),
    (11, LONG + " end", "fr", "c", 9),
    (12, "é ß 你好 mail a.b@c.de, 10.0.0.1, +1 (555) 123-4567 or 4111 1111 1111 1111 and 300.1.1.1", "es", "c", 9),
    (None, LINE + " without id", "es", "c", 9),
    (14, "7" * 40_000, "es", "c", 9),
    (15, "a@b.c_d@e.f x@y 1.2.3.4.5 " + "4111-1111 1111-1111 " * 3, "es", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = [
    "row", "label", "start", "end", "n", "node", "token", "shared", "bucket", "name", "part", "s_doc", "s_hash", "gone", "hit_doc", "id",
    "rejected_id", "tags", "text_hash", "names", "windows", "repeats", "length", "piece", "score", "kind", "key", "word", "w", "h",
]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def known(rows=AWKWARD):
    return [(d, t) for d, t, *_ in rows if d is not None]


def by_id(df, columns):
    """Rows by id; rows of one id must agree."""
    out = {}
    for r in df.select("doc_id", *columns).collect():
        assert out.setdefault(r[0], tuple(r[1:])) == tuple(r[1:])
    return out


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    assert compare.differences(QUERIES[name](spark, folder), compare.connect(folder), ORACLE_SQL[name]) is None


def test_substrings(spark, awkward, none):
    found = substrings.dedupe(awkward)
    expected = brute.op1(known())
    got = by_id(found, ["n_words", "n_removed", "kept_sha256"])
    assert {k: v for k, v in got.items() if k is not None} == expected
    assert got[None][1] == 0
    assert found.where("doc_id = 4").first()["kept"] == "before it and after"
    assert substrings.dedupe(none).count() == 0


def test_marks_agree_on_equal_windows():
    rng = random.Random(3)
    hasher = substrings.Hasher()
    for _ in range(30):
        shared = [rng.choice("abcde") * rng.choice((1, 1, 1, 2)) for _ in range(20)]
        found = []
        for _ in range(2):
            words = [rng.choice("abcde") for _ in range(rng.randint(0, 9))]
            at = len(words)
            words += shared + [rng.choice("abcde") for _ in range(rng.randint(0, 9))]
            raw = np.frombuffer(" ".join(words).encode(), np.uint8)
            _, _, text, hashes, _ = substrings.Reader().words(raw, np.array([0, len(raw)]))
            mark, _, _ = substrings.marks(hashes, text, hasher)
            found.append(mark[at : at + 8].tolist())
        assert found[0] == found[1]


@pytest.mark.parametrize("share", [40_000, 4])
def test_suffixes(spark, awkward, none, share, monkeypatch):
    monkeypatch.setattr(suffixes, "MERGED", share)  # 4: nearly every gram is dealt over several groups
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = by_id(suffixes.dedupe(awkward, with_text=False), columns)
    assert {k: v for k, v in got.items() if k is not None} == brute.op3(dict(known()).items())
    assert got[None][1] == 0
    assert suffixes.dedupe(none).count() == 0


def test_merge_never_loses_order():
    rng = random.Random(1)
    for _ in range(60):
        runs, everything = [], []
        for _ in range(rng.randint(1, 6)):
            strings = sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 20)))
            matrix = np.zeros((len(strings), 12), np.uint8)
            for i, s in enumerate(strings):
                matrix[i, : len(s)] = list(s)
            sizes = np.array([len(s) for s in strings])
            shared, rest = merging.front_code(matrix, sizes)
            runs.append(merging.Run(shared, sizes, rest))
            everything += strings
        _, shared, strings = merging.merge(runs)
        assert strings == sorted(everything)
        assert all(s == len(os.path.commonprefix([a, b])) for s, a, b in zip(shared[1:], strings, strings[1:]))


def test_decontamination(spark, awkward, none):
    items = [("b", LINE), ("a", "x " + LINE), ("c", "and after"), ("d", None), ("e", ""), (None, LINE), ("f", "mail"), ("g", "nowhere to be seen"), ("c", "and after")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.contamination(awkward, benchmark)
    expected = brute.op4(known(), [i for i in items if i[0] is not None])
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    got = by_id(found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated"), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert {k: v for k, v in got.items() if k is not None} == expected
    assert got[None][-1]
    kept = decontamination.clean(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in expected.items() if not v[-1]}
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(awkward, benchmark.limit(0)).where("contaminated").count() == 0


def test_rows_that_share_an_id_or_have_none_are_judged_apart(spark):
    """One hit beside clean rows: decontamination and language."""
    other = "the and of with that this from have are not but they which you all were her there been one"
    rows = [(None, LINE), (None, "quite clean words here"), (3, LINE + " more"), (3, "quite other clean words"), (4, "clean as well"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", LINE)], "item_id string, text string")
    found = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in decontamination.contamination(docs, benchmark).collect()}
    assert found == {(None, 16): 16, (None, 4): 0, (3, 17): 16, (3, 4): 0, (4, 3): 0, (None, 0): 0}
    kept = decontamination.clean(docs.withColumn("text_key", F.lit(1)), benchmark)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((d or 0, t or "") for d, t in rows if LINE not in (t or ""))
    told = [(i, f"{other} {i}", "en", "a.x.org") for i in range(30)] + [(i, f"der die das und nicht mit von ist auf ein {i}", "de", "b.y.de") for i in range(30, 60)]
    odd = [(None, "7 7 7", "en", "a.x.org"), (None, other, "en", "a.x.org"), (5, "9 9", "en", "a.x.org"), (5, None, None, None)]
    docs = spark.createDataFrame(told + odd, "doc_id long, text string, lang string, source string")
    kept = [(r["doc_id"], r["text"]) for r in language.accepted(docs).collect()]
    assert (None, other) in kept and (5, told[5][1]) in kept
    assert not {(None, "7 7 7"), (5, "9 9"), (5, None)} & set(kept) and len(kept) == 61


@pytest.mark.parametrize("shared, expected", [(1, {1: {1}, 2: {1}, 3: {1}, 9: {9}}), (5, {5: {2}, 2: {2}, 3: {2}, 9: {9}})])
def test_one_id_with_two_texts_is_linked_by_both(spark, shared, expected):
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(shared, words("a")), (shared, words("b")), (2, words("a", 39)), (3, words("b", 39)), (9, words("c"))]
    for order in (rows, rows[::-1]):
        found = collections.defaultdict(set)
        for r in jaccard.join(spark.createDataFrame(order, "doc_id long, text string"), 4, 85).collect():
            found[r["doc_id"]].add(r["component_id"])
        assert dict(found) == expected


def similar_texts():
    """Families of near copies of several sizes and distances, and a line in all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out, line = [], " ".join(word() for _ in range(9))
    for family in range(12):
        original = [word() for _ in range(rng.choice((6, 30, 120)))]
        for _ in range(rng.choice((1, 2, 12, 30))):
            copy = list(original)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy) + ("\n" + line if family % 2 else ""))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard(spark, awkward, none, size, percent):
    rows = [(d + 100, t) for d, t in similar_texts()] + [r for r in known() if r[0] != 8 or True]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(jaccard.join(docs, size, percent), ["n_shingles", "component_id"])
    assert got == brute.op5(dict(rows).items(), size, percent)


def test_first_of_each(spark, awkward, none):
    kept = jaccard.first_of_each(awkward)
    groups = brute.op5(dict(known()).items(), 5, 80)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in groups.items() if c == d} | {None}
    assert jaccard.first_of_each(none).count() == 0


def test_packing(spark, awkward, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encode = packing.Encoder(packing.default_vocabulary())
    odd = ["a  b", "a \n b", "\n\n", "  lead", "tail ", "a\n\nb", "it's\r\nok", "", "é\u0085b 你好", "x　 y", "<|endoftext|>", "a\x00b"]
    for text in odd + [t for _, t in known() if t]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    packed = packing.sequences(awkward).collect()
    texts = collections.defaultdict(list)
    for r in packed:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] <= 2048
        texts[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids"]))
    for d, t, *_ in AWKWARD:
        pieces = sorted(set(texts[d]))
        assert [p[1] for p in pieces] == np.cumsum([0] + [p[2] for p in pieces])[:-1].tolist()
        assert all(p[2] == 2048 for p in pieces[1:])
        assert b"".join(p[3] for p in pieces) == encode(t or "") + b"\0\0\0\0"
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(none)).count() == 0


def test_added_tokens_are_one_id(spark):
    """Ids equal the tokenizer's as it comes, also where a text holds the end id's own name."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext|", "x<|endoftext|>y  ", "plain  text "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pieces(docs, with_ids=True).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    # An end id inside a text is no further text to the word scores.
    known = spark.createDataFrame([(1, "one two"), (2, "one <|endoftext|> two <|endoftext|>")], "doc_id long, text string")
    assert {r["train_tokens"] for r in scoring.score(known).collect()} == {sum(len(t.split()) + 1 for d, t in ((1, "one two"), (2, "one <|endoftext|> two <|endoftext|>")) if zlib.crc32(str(d).encode()) % 10)}


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 300))]
        plan = packing.best_fit(dict(collections.Counter(lengths)), 50)
        fill, left = collections.Counter(), collections.Counter(lengths)
        for length, _, ranks, first, offset, per in plan.tolist():
            for i in range(ranks):
                assert fill[first + i // per] == offset + i % per * length
                fill[first + i // per] += length
            left[length] -= ranks
        assert not any(left.values()) and max(fill.values(), default=0) <= 50
        rooms = []
        for length in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(50 - length)
        assert sorted(rooms) == sorted(50 - f for f in fill.values())


def test_personal_data(spark, folder, rows, awkward, none):
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert by_id(QUERIES["op7_pii"](spark, folder), names) == brute.op7(rows)
    found = pii.spans(awkward)
    assert by_id(found.select("doc_id", *[F.size(k).alias(k) for k in pii.KINDS]), pii.KINDS)[12] == (1, 1, 1, 1)
    assert {d: v[:4] for d, v in brute.op7(known()).items()} == {
        k: v for k, v in by_id(found.select("doc_id", *[F.size(k).alias(k) for k in pii.KINDS]), pii.KINDS).items() if k is not None
    }
    masked = pii.masked(awkward)
    assert masked.columns == awkward.columns and masked.count() == len(AWKWARD)
    text = masked.where("doc_id = 12").first()
    assert text["text"] == "é ß 你好 mail [EMAIL], [IP], [PHONE] or [CARD] and 300.1.1.1" and text["n_chars"] == len(text["text"])
    assert masked.where("doc_id = 4").first()["n_chars"] is None
    assert pii.masked(none).count() == 0 and pii.spans(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(4)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "1a"
    texts = [f"Then secret={value(20)} stood there" for _ in range(20)] + ["But secret=hunter22 is short", "and note=nothing or note=something-else", "plain words: nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["other"]] for r in pii.spans(docs).collect()}
    assert got[20] == ["hunter22"] and got[21] == [] and got[22] == []


def test_words_around_base_entities_find_unseen_values(spark):
    texts = []
    for i in range(12):
        texts += [f"Then call me at +49 30 12345{i:02d} or so", f"the server ip: 192.168.10.{i} went down", f"mail from john{'abcdefghijkl'[i]}@example.com reached us today"]
    unseen = ["Then call me at 030-7654321, please", "or write, as mail from jane@localhost reached us today", "which 12-34-56 went down"]
    plain = ["some 17 went home and some 18 went home", "then 19 or so went home", "a mail from nobody came"]
    docs = spark.createDataFrame(list(enumerate(texts + unseen + plain)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["other"]] for r in pii.spans(docs).collect()}
    assert [got[len(texts) + i] for i in range(2)] == [["030-7654321"], ["jane@localhost"]]
    assert all(not got[len(texts) + len(unseen) + i] for i in range(len(plain))) and not any(got[i] for i in range(len(texts)))


def test_long_keys_long_names_and_dotted_tokens_are_found_whole(spark):
    rng = random.Random(7)
    value = lambda n, of: "".join(rng.choice(of) for _ in range(n - 2)) + "A1"
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdef0123456789"
    long_name = "very_" * 12 + "long_name"
    texts, wanted = [], []
    for _ in range(9):
        key, named = "QXZV" + value(96, capitals), value(20, small)
        token = ".".join(value(12, small) for _ in range(3)) + "=="
        texts += [f"Here {key} stood", f"and {long_name}={named} too", f"and token={token} or so", f"then token={token}."]
        wanted += [key, named, token, token]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["other"]] for r in pii.spans(docs).collect()}
    assert got == {i: [w] for i, w in enumerate(wanted)}
    assert {r["text"] for r in pii.masked(docs).where("doc_id = 2 or doc_id = 3").collect()} == {"and token=[OTHER] or so", "then token=[OTHER]."}


def test_language(spark, folder, awkward, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = QUERIES["op8_language_id"](spark, folder)
    declared = pages.select("page_id", F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("said"))
    both = found.join(declared, "page_id")
    assert both.count() == pages.count()
    assert both.where("language = said").count() >= 0.98 * pages.count()
    alone = language.identify(docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host")), language.learn(docs))
    right = alone.join(docs, alone.id == docs.doc_id).where("language = lang").count()
    assert right >= 0.97 * docs.count()
    kept = language.accepted(awkward)
    assert kept.columns == awkward.columns
    gone = {d for d, *_ in AWKWARD} - {r["doc_id"] for r in kept.collect()}
    assert {5, 6, 7, 14} <= gone and not gone & {1, 2, 8, None}
    assert language.accepted(none).count() == 0
    assert language.of_pages(pages.limit(0), language.learn(docs)).count() == 0


def test_language_fusion_against_plain_sums(spark):
    """Two hosts of one domain: priors, with the row's own share taken out."""
    texts = [("der die das und nicht ", "de"), ("the and of with that ", "en")]
    docs = spark.createDataFrame([(i, t * 5, name) for i, (t, name) in enumerate(texts * 5)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    rows = [(i, "der und die nicht das", "", "a.x.org") for i in range(9)] + [(9, "qq", "", "a.x.org"), (10, "qq", "en", "b.y.net")]
    found = {r["id"]: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), model).collect()}
    assert all(found[i]["language"] == "de" for i in range(10)) and found[10]["language"] == "en"


def test_quality(spark, folder, rows, awkward, none):
    def measured(text):
        words = [w.decode() for w in (text or "").encode().split()]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        many = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        base = len(words) < 20 or 100 * len(many) > 30 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(many), base

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    query = QUERIES["op9_quality_rules"](spark, folder)
    assert by_id(query, names) == {d: measured(t) for d, t in rows}
    assert query.where("kept and base_failed").count() == 0
    judged = quality.judge(awkward)
    assert {k: v for k, v in by_id(judged, names).items() if k is not None} == {d: measured(t) for d, t in known()}
    assert quality.judge(none).count() == 0


def test_quality_finds_what_labels_say(spark, folder):
    folder = f"{os.path.dirname(folder)}/sf0.1"
    found = QUERIES["op9_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    told = {(r["quality"], r["kept"]): r["count"] for r in found.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert told.get((1, True), 0) >= 0.97 * (told.get((1, True), 0) + told.get((1, False), 0))
    assert told.get((0, False), 0) >= 0.8 * (told.get((0, True), 0) + told.get((0, False), 0))


def test_toxicity(spark, folder, none, awkward):
    folder = f"{os.path.dirname(folder)}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op6_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert set(found["held_out"]) == {True}
    order = np.argsort(found["score"].to_numpy(), kind="stable")
    toxic = found["toxic"].to_numpy()[order]
    ranks, ones = np.arange(1, len(toxic) + 1), int(toxic.sum())
    area = (ranks[toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(toxic) - ones))
    # 352 toxic documents to learn from give 0.93 here; 1700, as at five times this size, 0.99.
    assert area > 0.9
    model = toxicity.train([b"a good word", b"some idiot word"] * 10, np.array([0.0, 1.0] * 10))
    assert toxicity.score(none, model).count() == 0
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(awkward, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[5] == scores[6] == scores[7]
    untold = toxicity.learn(awkward, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(awkward, untold).where("score between 0 and 1").count() == len(AWKWARD)


def test_toxicity_of_texts_of_any_length_at_the_end_of_a_block(spark):
    """Scores equal sums over each word's n-grams, letter by letter."""
    value = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(value, -0.5)

    def plain(text):
        words = "".join(c if c.islower() else " " for c in text.lower()).split()
        means = []
        for w in words:
            spelled = np.frombuffer(b"\0" + w.encode() + b"\0", np.uint8)
            found = [value[toxicity._codes(spelled, n)] for n in toxicity.SIZES]
            found = np.concatenate(found)
            means.append(float(found.sum()) / max(1, len(found)))
        odds = math.exp((sum(means) / len(means) if means else 0.0) - 0.5)
        return odds / (1 + odds)

    ends = ["vitamin c", "plan b", "", *("abcdefgh"[:n] for n in range(9)), *("word " + "abcdefgh"[:n] for n in range(9)), *("7" * n for n in range(4)), "a b", "a 1", "1 a"]
    for last in ends:
        for before in ([], ["some words"], [""]):
            texts = [*before, last]
            raw, at = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
            assert model.score(np.frombuffer(raw, np.uint8), at) == pytest.approx([plain(t) for t in texts], rel=1e-5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ends)], "doc_id long, text string").repartition(len(ends))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()} == pytest.approx({i: plain(t) for i, t in enumerate(ends)}, rel=1e-5)


def test_misspelled_words_share_ngrams():
    clean = [f"some words of text number{i} and more of it here".encode() for i in range(60)]
    model = toxicity.train(clean + [t.replace(b"more", b"disgusting") for t in clean], np.array([0.0] * 60 + [1.0] * 60))
    raw = b"some words of disgustinng text here"
    fine = b"some words of plainly good text here"
    bad, good = (model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (raw, fine))
    assert bad > 0.5 > good


def test_lm_base_scores(spark, folder, rows, awkward, none):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for docs, told in ((spark.read.parquet(f"{folder}/documents.parquet"), rows), (awkward, known())):
        tokens = lambda t: [*(t or "").translate(lower).encode().split(), None]
        held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
        counts = collections.Counter(w for d, t in told if not held(d) for w in tokens(t))
        n, v = sum(counts.values()), len(counts)
        got = by_id(scoring.score(docs), ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        for d, t in told:
            words = tokens(t)
            assert got[d][:4] == (held(d), len(words), sum(counts[w] > 0 for w in words), n)
            assert got[d][4] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
            assert got[d][5] < 0
    assert scoring.score(none).count() == 0


def test_words_beyond_the_popular_ones_are_counted(spark, folder, rows, monkeypatch):
    whole = by_id(scoring.score(spark.read.parquet(f"{folder}/documents.parquet")), ["n_known", "base_score"])
    monkeypatch.setattr(scoring, "POPULAR", 10)
    few = by_id(scoring.score(spark.read.parquet(f"{folder}/documents.parquet")), ["n_known", "base_score"])
    assert whole.keys() == few.keys()
    assert all(whole[d][0] == few[d][0] and whole[d][1] == pytest.approx(few[d][1], rel=1e-9) for d in whole)


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300).astype(float)
    words = attention.Vocabulary(counts, rng.integers(0, attention.CLASSES, attention.ROWS))
    p = attention.views(attention.fresh())
    length = 70
    ids = rng.integers(0, 300, length)
    before = np.concatenate([[299], ids[:-1]])

    def each(ids, before):
        first, end, context = attention.window_places(np.array([len(ids)]))
        place = np.arange(attention.LENGTH)
        out, seen = np.zeros(len(ids)), np.zeros(len(ids), int)
        for f, e, c in zip(first, end, context):
            where = f + place
            wanted = ((where < e) & (place >= c))[None]
            target = where[wanted[0]]
            seen[target] += 1
            out[target] = attention.class_scores(p, words.row[before[np.minimum(where, len(ids) - 1)]][None], wanted, words.of[ids[target]])
        assert (seen == 1).all()
        return out + words.within[ids]

    scores = each(ids, before)
    assert attention.score(p, words, ids, before, np.array([length]))[0] == pytest.approx(scores.sum(), rel=1e-5)
    # A later id changes nothing before it.
    changed = ids.copy()
    changed[40] = (changed[40] + 1) % 300
    assert np.allclose(each(changed, np.concatenate([[299], changed[:-1]]))[:40], scores[:40], atol=1e-5)
    # The last id's probabilities over all ids sum to one.
    total = sum(10 ** each(np.append(ids[:-1], i), before)[-1] for i in range(300))
    assert total == pytest.approx(1, abs=1e-4)


def test_attention_gradient():
    rng = np.random.default_rng(1)
    flat = attention.fresh().astype(np.float64)
    rows, classes = rng.integers(0, 50, (3, attention.LENGTH)), rng.integers(0, attention.CLASSES, (3, attention.LENGTH))
    real = np.ones(rows.shape, bool)
    real[2, 20:] = False
    found, spare = np.zeros(attention.SIZE), np.zeros(attention.SIZE)
    attention.gradient(attention.views(flat), rows, classes, real, attention.views(found))
    at = 0
    for name, shape in attention.SHAPES.items():
        i = at + (int(rows[0, 3]) * attention.WIDTH + 2 if name == "embed" else 5)
        at += int(np.prod(shape))
        sides = []
        for step in (1e-5, -1e-5):
            flat[i] += step
            sides.append(attention.gradient(attention.views(flat), rows, classes, real, attention.views(spare)))
            flat[i] -= step
        assert found[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-9)


def test_every_token_is_learned_from_once(spark):
    """The windows to learn from cover long texts to their ends."""
    docs = spark.createDataFrame([(d, t) for d, t, *_ in AWKWARD if d is not None], "doc_id long, text string")
    told = scoring.gather(docs, packing.default_vocabulary()).where("kind = 2").select("ids").collect()
    words = attention.Vocabulary(np.ones(scoring.IDS))
    words.row = np.arange(scoring.IDS)
    _, nexts, _, real = scoring._windows(b"".join(bytes(r["ids"]) for r in told), words)
    encode = packing.Encoder(packing.default_vocabulary())
    ids = np.concatenate([np.append(np.frombuffer(encode(t or ""), "<u4"), scoring.END_ID) for d, t, *_ in AWKWARD if d is not None])
    assert np.array_equal(np.bincount(nexts[real], minlength=scoring.IDS), np.bincount(ids, minlength=scoring.IDS))


def test_model_learns_what_follows_what(spark):
    """Trained on texts in which each word settles the next, the model beats counts."""
    order = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(6)
    texts = []
    for _ in range(400):
        at = rng.randrange(8)
        texts.append(" ".join(order[(at + i) % 8] for i in range(30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = scoring.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert told[0] > 0.6 * told[1]


def test_families_about_the_threshold(spark):
    """Near copies of which most have their partner just above or just under the
    threshold, in two sizes, and copies of copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for words in (40, 200):
        original = [word() for _ in range(words)]
        for _ in range(60):
            copy = list(original)
            for _ in range(rng.randint(words // 50, words // 25)):
                copy[rng.randrange(len(copy))] = word()
            again = copy[: -rng.randint(1, words // 10)]
            again[rng.randrange(len(again))] = word()
            out += [" ".join(copy), " ".join(again)]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    expected = brute.op5(rows, 4, 85)
    assert 10 < len({c for _, c in expected.values()}) < len(rows) - 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard.join(docs, 4, 85), ["n_shingles", "component_id"]) == expected


def test_blocks_join_what_brute_force_joins():
    """All links between groups are followed, whichever two blocks of a family meet."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    held = []
    for _ in range(40):
        some = base.copy()
        some[rng.choice(60, rng.integers(0, 6), replace=False)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        held.append(np.unique(some))
    rows = pa.table({
        "node": list(range(40)), "label": list(range(40)), "n": [len(s) for s in held], "cap": [10**6] * 40, "place": [0] * 40,
        "held": pa.array([s.view(np.int64).tolist() for s in held], pa.list_(pa.int64())),
    })

    def groups(links):
        label = list(range(40))
        for a, b in links:
            label = [label[a] if v == label[b] else v for v in label]
        return {frozenset(i for i in range(40) if label[i] == v) for v in label}

    every = [(a, b) for a in range(40) for b in range(a) if jaccard.linked(held[a], held[b], 85)]
    found = jaccard.joining_links(rows, 85)
    assert groups(found) == groups(every) and set(map(frozenset, found)) <= set(map(frozenset, every)) and len(found) < 40


def test_tables_made_on_the_way_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "new_folder", lambda spark, label: f"{tmp_path}/{label}-{random.getrandbits(64):x}")
    docs = spark.createDataFrame([(1, LINE), (2, LINE + " more"), (3, OTHER)], "doc_id long, text string")
    found = jaccard.join(docs, 4, 85)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["join"]
    assert found.count() == 3


def test_texts_under_one_id_lose_their_own_repeats(spark):
    """One id on rows with different texts: a text found nowhere else stays whole."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, u, v = text(300), text(250), text(400), text(120)
    rows = [(1, a), (2, u), (2, v + a), (2, v + a), (2, b), (2, None), (2, ""), (3, b + u)]
    found = sorted((r["n_bytes"], r["n_removed"]) for r in suffixes.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 2)
    assert found == [(0, 0), (0, 0), (250, 0), (400, 0), (420, 300), (420, 300)]
    last = [r for r in suffixes.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 3]
    assert [(r["n_bytes"], r["n_removed"]) for r in last] == [(650, 650)]


def test_hashes_of_patterns_differ():
    """The Thue-Morse pattern and its opposite agree in every polynomial modulo 2^64."""
    morse = np.array([bin(i).count("1") & 1 for i in range(1024)])
    words = np.concatenate([np.array([ord("a"), ord("b")], np.uint8)[m] for m in (morse, 1 - morse)])
    hasher = text_module.Hasher()
    wrapped, prime = hasher.sums(words)
    start, end = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(((wrapped[end] - wrapped[start]) * hasher.inverses[start]).tolist())) == 1
    assert len(set(hasher.ranges((wrapped, prime), start, end).tolist())) == 2
    # A range hashes alike wherever it stands.
    twice = hasher.sums(np.tile(words, 3))
    assert len(set(hasher.ranges(twice, np.array([5, 2053, 4101]), np.array([905, 2953, 5001])).tolist())) == 1


@pytest.mark.parametrize("known", [100_000, 0])
def test_words_against_contexts_are_counted_before_they_are_joined(spark, monkeypatch, known):
    texts = ["Call 12 the Office  on\tÉCOLE now", "the office on", "the office on the Office\non x@y the", "one", "", " the ", "on on on on 7", "ΟΔΟΣ the ΟΔΟΣ, off"] * 3
    plain = [["" if re.search("[0-9@]", w) else w.lower() for w in re.findall(r"[^ \t\n\x0b\f\r]+", t)] for t in texts]
    want = collections.Counter()
    for x, y, z in ((x, y, z) for words in plain for x, y, z in zip(["", *words], words, [*words[1:], ""])):
        want.update([f"b: {x} {y}"] * bool(y and z) + [f"a: {y} {z}"] * bool(y and x))
    contexts = [*sorted(want)[::2], "b: never met", "a: on ", "b:  nothing", "name=", "AB12"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    monkeypatch.setattr(pii, "KNOWN", known)
    monkeypatch.setattr(pii, "stored", lambda df, label="": df)
    found = pii._against(docs, spark.createDataFrame([(c,) for c in contexts], "context string"))
    got = {r["context"]: r["against"] for r in found.collect()}
    assert got == {c: want[c] for c in contexts if c in want}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Join") == 1


def test_texts_are_searched_for_words_with_digits_once(spark):
    docs = spark.createDataFrame([(1, "no digit"), (2, "a 12 b c3 d"), (3, ""), (4, "x@y z")], "doc_id long, t string")
    found = pii._with_worded(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1
    got = {r["doc_id"]: [(m["gap"], m["value"], m["ahead"][::-1].strip(), m["behind"].strip()) for m in r["worded"] or []] for r in found.collect()}
    assert got == {1: [], 2: [(2, "12", "a", "b"), (3, "c3", "b", "d")], 3: [], 4: [(0, "x@y", "", "z")]}


@pytest.mark.parametrize("words", [1 << 19, 1])
def test_rows_that_a_join_needs_are_likely(spark, monkeypatch, words):
    """None is lost, also where all bits are set; few others pass where they are not."""
    monkeypatch.setattr(tables, "FILTER", words)
    rows = [(i, -i, f"text {i}") for i in range(2000)] + [(None, 1, "no id"), (7, -7, "again"), (7, 0, "other hash")]
    docs = spark.createDataFrame(rows, "doc_id long, hash long, place string")
    wanted = spark.createDataFrame([(i, -i) for i in range(0, 2000, 7)], "doc_id long, hash long")
    passed = [tuple(r) for r in tables.likely(docs, wanted, ["doc_id", "hash"]).collect()]
    needed = {r for r in rows if r[0] is not None and r[0] % 7 == 0 and r[1] == -r[0]}
    assert needed <= set(passed) and len(passed) == len(set(passed)) <= (len(needed) + 10 if words > 1 else len(rows))


def test_texts_without_a_partner_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    near = text()
    rows = [(i, text()) for i in range(300)] + [(300, near), (301, near + " more"), (302, near + " more"), (302, near + " more")]
    passed = []

    def spied(df, wanted, keys):
        found = tables.likely(df, wanted, keys)
        passed.append((df.columns, found.count()))
        return found

    monkeypatch.setattr(jaccard, "likely", spied)
    got = by_id(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85), ["component_id"])
    assert got == {d: (min(d, 300),) for d, _ in rows}
    assert passed and all("text" in columns and 2 <= n < 10 for columns, n in passed)


def test_windows_of_stretches_are_those_of_texts():
    """Every window of every text comes out of the stretches, whatever the text's length,
    and tokens that windows share are held once."""
    rng = np.random.default_rng(2)
    lengths = np.array([1, 8, 9, 31, 32, 33, 56, 57, 391, 392, 393, 776, 777, 4000])
    ids = rng.integers(0, scoring.IDS, lengths.sum())
    ids[:40] = scoring.END_ID
    before = np.concatenate([[0], ids[:-1]])
    before[np.cumsum(lengths) - lengths] = scoring.END_ID
    key, number, records = scoring.cut(ids, before, lengths, np.arange(len(lengths)))
    words = attention.Vocabulary(np.ones(scoring.IDS))
    words.row = np.arange(scoring.IDS)
    rows, nexts, _, real = scoring._windows(b"".join(records), words)
    first, end, context = attention.window_places(lengths)
    place = np.arange(attention.LENGTH)
    where = first[:, None] + place
    wanted = (where < end[:, None]) & (place >= context[:, None])
    seen = lambda before, after, real: sorted((tuple(b[: r.nonzero()[0][-1] + 1]), tuple(a[r])) for b, a, r in zip(before, after, real))
    at = np.minimum(where, len(ids) - 1)
    assert seen(rows, nexts, real) == seen(before[at], ids[at], wanted)
    assert number.sum() == len(rows) == len(first) and len(set(key.tolist())) == len(key) == len(records)
    # 68 bytes for each 24 tokens before.
    assert sum(map(len, records)) < 2.1 * lengths.sum()


def test_equal_texts_score_alike_wherever_they_stand():
    rng = np.random.default_rng(7)
    words = attention.Vocabulary(rng.integers(0, 50, 300).astype(float), rng.integers(0, attention.CLASSES, attention.ROWS))
    p = attention.views(attention.fresh())
    one = rng.integers(0, 300, 100)
    found = set()
    for ahead in (*range(40), *range(2980, 3080, 4)):
        ids = np.concatenate([rng.integers(0, 300, ahead + 1), one, rng.integers(0, 300, 3)])
        before = np.concatenate([[299], ids[:-1]])
        before[[0, ahead + 1, ahead + 101]] = 299
        found.add(float(attention.score(p, words, ids, before, np.array([ahead + 1, 100, 3]))[1]))
    assert len(found) == 1


def test_small_tables_of_groups_have_few_files(spark, monkeypatch):
    """A file takes its time, so a small table has no file for each partition of a shuffle;
    a larger one has more."""
    held = {}

    def counted(session, path):
        held[path.split("/")[-1].split("-")[0], path] = len(session.read.parquet(path).inputFiles())
        remove(session, path)

    remove = tables._remove
    monkeypatch.setattr(tables, "_remove", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 3000, 2)], "a long, b long").localCheckpoint()
    shared = tables.stored(links)
    least = 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = graphs.components(shared)
        assert {r["node"]: r["label"] for r in found.collect()} == {i: i - i % 2 for i in range(3000)}
        assert {k for k, _ in held} == {"edges", "lowest"} and max(held.values()) <= least < 64
        assert len(found.inputFiles()) <= least
        monkeypatch.setattr(tables, "FILE", 200)
        assert tables.files_for(shared) > 2 * least and len(graphs.components(shared).inputFiles()) > least
        assert tables.files_for(links) > 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_profiles_and_steps_are_plain_ones_without_copies():
    """What stands around a row is summed by distinct pairs, without a projection for each
    token, and steps of Adam need no copies of all parameters."""
    rng = np.random.default_rng(3)
    rows, nexts = (rng.integers(0, 50, (8000, 32)) for _ in range(2))
    real = rng.random(rows.shape) < 0.8
    tracemalloc.start()
    found = attention.profiles(rows, nexts, real)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 * real.sum()
    sketch = np.random.default_rng(9).normal(0, 1, (attention.ROWS, attention.SKETCH)).astype(np.float32).astype(float)
    want = np.zeros((attention.ROWS, 2 * attention.SKETCH + 1))
    np.add.at(want[:, : attention.SKETCH], nexts[real], sketch[rows[real]])
    np.add.at(want[:, attention.SKETCH : -1], rows[real], sketch[nexts[real]])
    want[:, -1] = np.bincount(nexts[real], minlength=attention.ROWS)
    assert np.allclose(found, want, rtol=1e-4, atol=1e-2)

    flat, first, second = rng.normal(size=attention.SIZE).astype(np.float32), *np.zeros((2, attention.SIZE), np.float32)
    plain, m, s = flat.astype(float), np.zeros(attention.SIZE), np.zeros(attention.SIZE)
    for step in (1, 2, 3):
        change = rng.normal(size=attention.SIZE).astype(np.float32)
        m, s = 0.9 * m + 0.1 * change, 0.99 * s + 0.01 * change.astype(float) ** 2
        plain -= 0.01 * m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        tracemalloc.start()
        attention._moved(flat, change, first, second, 0.01, step)
        assert tracemalloc.get_traced_memory()[1] < attention.SIZE
        tracemalloc.stop()
    assert np.allclose(flat, plain, atol=1e-5)


def test_context_asks_nothing_and_steps_need_no_new_room(monkeypatch):
    """Windows with and without context get plain attention's loss, gradient and scores,
    and a step after the first makes few arrays anew."""
    rng = np.random.default_rng(4)
    flat = attention.fresh().astype(np.float64)
    flat[-attention.CLASSES :] = rng.normal(size=attention.CLASSES)
    p = attention.views(flat)
    rows, classes = rng.integers(0, 50, (64, attention.LENGTH)), rng.integers(0, attention.CLASSES, (64, attention.LENGTH))
    real = np.ones(rows.shape, bool)
    real[::3, : attention.OVERLAP] = False
    real[1, 20:] = real[3, 20:] = False

    def plain() -> np.ndarray:
        x = p["embed"][rows] + p["place"]
        a = x @ p["q"] @ (x @ p["k"]).transpose(0, 2, 1) * attention.WIDTH**-0.5
        a = np.where(np.tri(attention.LENGTH, dtype=bool), np.exp(a), 0)
        logits = (x + a / a.sum(axis=2, keepdims=True) @ (x @ p["v"]) @ p["o"]) @ p["out"] + p["bias"]
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return np.take_along_axis(logits, classes[:, :, None], 2)[:, :, 0][real]

    assert attention.class_scores(p, rows, real, classes[real]) == pytest.approx(plain() / math.log(10), rel=1e-5)
    found = np.zeros(attention.SIZE)
    assert attention.gradient(p, rows, classes, real, attention.views(found)) == pytest.approx(-plain().mean(), rel=1e-6)
    at = 0
    for name, shape in attention.SHAPES.items():
        i = at + (int(rows[0, 3]) * attention.WIDTH + 2 if name == "embed" else 5)
        at += int(np.prod(shape))
        sides = []
        for step in (1e-5, -1e-5):
            flat[i] += step
            sides.append(-plain().mean())
            flat[i] -= step
        assert found[i] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-9)

    start, most, moved = flat.astype(np.float32), [], attention._moved

    def watched(*args) -> None:
        most.append(tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0])
        moved(*args)
        tracemalloc.reset_peak()

    monkeypatch.setattr(attention, "_moved", watched)
    tracemalloc.start()
    attention.train(start, rows, classes, real, 0.01, least=3)
    tracemalloc.stop()
    assert len(most) == 3 and max(most[1:]) < 1 << 19


def test_rows_move_as_all_parameters_do():
    """Embeddings move as if each step changed all of them, across puttings in of the decay,
    and a step writes to the moments of the rows it meets alone."""
    rng = np.random.default_rng(8)
    embed = rng.normal(size=(attention.ROWS, attention.WIDTH)).astype(np.float32)
    plain, first, second = embed.ravel().copy(), *np.zeros((2, embed.size), np.float32)
    moving = attention.Rows(embed)
    for step in range(1, 2 * moving.DECAY + 20):
        met = np.unique(rng.integers(0, 200, 40) ** 2 // 8)
        found = rng.normal(size=(len(met), attention.WIDTH)).astype(np.float32) * np.float32(1e-3)
        change = np.zeros_like(embed)
        change[met] = found
        attention._moved(plain, change.ravel(), first, second, 0.01, step)
        before = moving.first.copy()
        moving.move(met, found, 0.01, step)
        if step != moving.DECAY + 1 and step != 2 * moving.DECAY + 1:
            assert set(np.flatnonzero((before != moving.first).any(axis=1))) <= set(met)
    assert np.abs(embed.ravel() - plain).max() < 2e-5


def test_texts_are_encoded_once(spark):
    """One pass keeps the ids of every text, which give the text back, and learns from those
    that are not held out."""
    docs = spark.createDataFrame([(d, t) for d, t, *_ in AWKWARD], "doc_id long, text string")
    told = scoring.gather(docs.withColumn("held", scoring.held_out(F.col("doc_id"))), packing.default_vocabulary()).collect()
    whole = pa.table({"key": pa.array([r["key"] for r in told if r["kind"] == 4], pa.int64()), "ids": pa.array([bytes(r["ids"]) for r in told if r["kind"] == 4], pa.binary())})
    encode = packing.Encoder(packing.default_vocabulary(), special=True)
    found = []
    for first, last, data, at, ids, before, lengths in scoring._texts(whole.to_batches()[0], encode):
        assert np.array_equal(np.concatenate([np.append(np.frombuffer(encode(data[a:b].tobytes().decode()), "<u4"), scoring.END_ID) for a, b in zip(at, at[1:])]), ids)
        assert lengths.sum() == len(ids) == len(before) and (before[np.cumsum(lengths) - lengths] == scoring.END_ID).all()
        found += [(k, data[a:b].tobytes().decode()) for k, a, b in zip(whole.column("key").to_pylist()[first:last], at, at[1:])]
    assert sorted(found, key=str) == sorted(((d, t or "") for d, t, *_ in AWKWARD), key=str)
    learned = scoring.gather(docs.where(~scoring.held_out(F.col("doc_id"))), packing.default_vocabulary()).collect()
    for kind in (0, 1, 2, 3):
        counts = [collections.Counter() for _ in range(2)]
        for rows, count in zip((told, learned), counts):
            for r in rows:
                if r["kind"] == kind:
                    count[kind == 3 or r["key"], bytes(r["ids"] or b"")] += r["n"]
        assert +counts[0] == +counts[1]
